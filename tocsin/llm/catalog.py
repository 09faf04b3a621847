"""Registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import (
    block_names,
    decision_lists,
    jaccard_join,
    language_codes,
    licence_scan,
    packing,
    prefix_trie,
    secret_scan,
    sentence_pieces,
    sharding,
    token_alignment,
    toxicity,
    vantage_search,
)
from tocsin.llm.common import table, tokenizer


def op1_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.find_licences(table(spark, sf_dir, "documents"))


def op2_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_groups(table(spark, sf_dir, "documents"))


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_confirmed_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents")).drop("masked_text")


def op5_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_search.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op6_size_aware_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op7_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentence_pieces.encode(docs, tokenizer("piece_bpe_32k.model"), with_ids=False).drop("ids")


def op9_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleaved_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op10_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_codes.identify(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    )


def op13_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_lists.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_licence_dice": op1_licence_dice,
    "op2_block_names": op2_block_names,
    "op3_ftrl_toxicity": op3_ftrl_toxicity,
    "op4_confirmed_secrets": op4_confirmed_secrets,
    "op5_vantage_trees": op5_vantage_trees,
    "op6_size_aware_join": op6_size_aware_join,
    "op7_dominance_packing": op7_dominance_packing,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_interleave": op9_interleave,
    "op10_output_codes": op10_output_codes,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_decision_lists": op13_decision_lists,
}

ORACLES = {
    "op2_block_names": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op5_vantage_trees": """
        WITH e AS (SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                   GROUP BY vec_id),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
              FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
                     vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op11_prefix_trie": """
        WITH RECURSIVE t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS said
            FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS pos FROM t),
        -- crc32 of the decimal id, bit by bit; its last two bits are inverted ones of the register
        c AS (SELECT conv_id, count(*) AS own,
                     xor(list_reduce(list_transform(range(length(conv_id::VARCHAR)), lambda i: ord(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT),
                         lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0],
                             lambda x, y: xor(x >> 1, (x & 1) * 3988292384)), 4294967295), 4294967295) % 4 AS h
              FROM o GROUP BY conv_id),
        r AS (SELECT c.conv_id, o.pos, o.said, o.text FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= c.h
              UNION ALL SELECT c.conv_id, o.pos, o.said, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h),
        p AS (SELECT conv_id, text, said, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS len
              FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
        k AS (SELECT conv_id, depth, len, text, md5(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM p
              UNION ALL SELECT c.conv_id, 0, coalesce(max(p.len), 0), '', '' FROM c LEFT JOIN p USING (conv_id) GROUP BY c.conv_id),
        f AS (SELECT k.*, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM k),
        n AS (SELECT depth, node, max(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
                     len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len), '')) AS ends_sha256
              FROM f GROUP BY depth, node),
        m AS (SELECT n.*, u.conv_id AS parent_conv_id,
                     (SELECT count(*) FROM n AS d WHERE d.depth = n.depth + 1 AND d.above = n.node) AS n_children
              FROM n LEFT JOIN n AS u ON u.depth = n.depth - 1 AND u.node = n.above),
        -- every node sends its own values to itself and to all nodes above it
        s AS (SELECT depth, node, above, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * words AS saved FROM m
              UNION ALL SELECT m.depth, m.node, m.above, s.leaf, s.saved
              FROM s JOIN m ON m.depth = s.depth - 1 AND m.node = s.above),
        g AS (SELECT depth, node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM s GROUP BY depth, node)
        SELECT m.conv_id, m.depth, m.parent_conv_id, m.n_convs, m.n_children, g.n_leaves, g.saved_tokens, m.ends_sha256
        FROM m JOIN g USING (depth, node)""",
}
