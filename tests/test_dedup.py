import numpy as np
import pytest
from pyspark.sql import functions as F

from oracles import sliding_window
from tocsin.functions.vectors import to_matrix, with_word_codes
from tocsin.operators.clean import clean_messages
from tocsin.operators.dedup import cluster_summary, deduplicate, window_count, with_matched_text


def chained(rows, dim, seed, copies):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(rows, dim))
    for i in range(1, rows):
        kind = rng.random()
        if kind < copies:
            vectors[i] = vectors[max(0, i - rng.integers(1, 12))]
        elif kind < copies + 0.3:
            vectors[i] = vectors[i - 1] + 0.25 * rng.normal(size=dim)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@pytest.mark.parametrize("rows, window, threshold, block, copies", [
    (400, 10, 0.8, 10, 0.2),
    (400, 7, 0.6, 16, 0.0),
    (400, 7, 0.3, 33, 0.5),
    (300, 500, 0.85, None, 0.3),
    (300, 20, 0.9, None, 0.33),
])
def test_matches_sequential_answer(spark, rows, window, threshold, block, copies):
    vectors = chained(rows, 6, rows + window, copies)
    df = spark.createDataFrame(
        [(1000 + i, 3 * i - 50, v.tolist()) for i, v in enumerate(vectors)],
        "message_id long, arrival_seq long, vector array<double>",
    ).repartition(5)
    got = {
        r.message_id - 1000: r
        for r in deduplicate(df, text_col=None, window=window, threshold=threshold, block_rows=block).collect()
    }
    want = sliding_window(vectors, window, threshold)
    assert len(got) == rows
    for i, (duplicate, cluster, best, matched) in enumerate(want):
        assert got[i].is_duplicate == duplicate
        assert got[i].cluster_id == f"cluster_{cluster:06d}"
        assert got[i].similarity == pytest.approx(best, abs=1e-4)
        assert got[i].matched_id == (None if matched is None else matched + 1000)
    assert any(w[0] for w in want)


def test_one_long_chain_of_copies(spark):
    """A hot message: every row is a copy, the chain crosses all blocks."""
    df = spark.range(500).select(
        F.col("id").alias("message_id"), F.col("id").alias("arrival_seq"),
        F.array(F.lit(1.0), F.lit(0.0)).alias("vector"),
    )
    rows = deduplicate(df, text_col=None, window=5, threshold=0.85, block_rows=16)
    counts = rows.groupBy("cluster_id", "is_duplicate").count().collect()
    assert {(r.cluster_id, r.is_duplicate): r["count"] for r in counts} == {
        ("cluster_000000", True): 499, ("cluster_000000", False): 1,
    }


def test_blank_messages_and_text(spark):
    texts = ["Flood in the north bridge area", "  ", "flood in the north bridge area", "All calm at the harbour today", ""]
    df = clean_messages(spark.createDataFrame(
        [(i, i, t) for i, t in enumerate(texts)], "message_id long, arrival_seq long, text string"))
    df = with_word_codes(df, "cleaned_text")
    result = with_matched_text(deduplicate(df), df)
    rows = {r.message_id: r for r in result.collect()}
    assert [rows[i].is_duplicate for i in range(5)] == [False, False, True, False, False]
    assert [rows[i].cluster_id for i in range(5)] == [
        "cluster_000000", None, "cluster_000000", "cluster_000001", None]
    assert rows[2].matched_text == texts[0] and rows[3].matched_text is None
    assert window_count(df).first()[0] == 3
    assert window_count(df, window=2).first()[0] == 2
    summary = cluster_summary(df.join(result, "message_id"))
    assert {(r.cluster_id, r.messages, r.first_text) for r in summary.collect()} == {
        ("cluster_000000", 2, texts[0]), ("cluster_000001", 1, texts[3])}
    assert deduplicate(df, skip=True).where("cluster_id is not null or is_duplicate").count() == 0
