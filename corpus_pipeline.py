"""A corpus pipeline in stages; each works on all rows that the one before kept.

A stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import block_names, jaccard_join, language_codes, packing, secret_scan
from tocsin.llm.common import ascii_lower, tokenizer
from tocsin.runtime import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; ambiguous ones stay, and all with letters if no language could be learnt."""
    found = language_codes.identify(docs, carry=COLUMNS)
    told = F.col("lang_pred") != language_codes.UNDETERMINED
    return found.filter(told | F.col("carried.text").rlike(r"\p{L}")).select("carried.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z one stays, with the largest id; null texts count as empty."""
    kept = block_names.exact_groups(docs).filter("kept").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text_sha256").alias("_sha")
    )
    text = ascii_lower(F.coalesce("text", F.lit("")))
    marked = docs.select(
        *COLUMNS, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.sha2(text, 256).alias("_sha")
    )
    # Rows that repeat id and text are alike to the join; they already lie together for the last step.
    return marked.join(kept, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least id stays; a null id counts as the largest.

    Rows are told apart by a code of id and text, so several texts of one id
    and rows without id are compared like others, and of rows that repeat
    both one stays.
    """
    coded = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    groups = jaccard_join.jaccard_groups(coded, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    least = (
        groups.distinct().join(coded.select("_row", "doc_id").distinct(), "_row")
        .groupBy("component_id").agg(F.min(rank).alias("_first"))
        .select(F.col("_first._row").alias("_row"))
    )
    return coded.join(least, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    found = secret_scan.find_secrets(docs, masked=True, carry=("lang", "source", "n_chars"))
    changed = F.col("spans") != ""
    return found.select(
        "doc_id", F.col("masked_text").alias("text"), "carried.lang", "carried.source",
        F.when(changed, F.char_length("masked_text").cast("long")).otherwise(F.col("carried.n_chars")).alias("n_chars"),
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document has its place in a sequence."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("copies", drop_copies),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the language model nor the tokenizer; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
