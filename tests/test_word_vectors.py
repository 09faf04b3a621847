"""Learnt message vectors."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.functions.vectors import to_matrix, with_word_codes
from tocsin.operators import word_vectors
from tocsin.operators.dedup import deduplicate

BOAT, PLACE, DOES = ("boat", "ship", "ferry"), ("harbour", "dock", "pier"), ("sinks", "drowns", "founders")
CAKE, OVEN, COOKS = ("cake", "bread", "bun"), ("oven", "stove", "grill"), ("bakes", "roasts", "browns")
FILL = ("the", "a", "now", "again", "slowly", "today")


def made_texts(rows, seed=3):
    rng = np.random.default_rng(seed)
    for i in range(rows):
        thing, where, does = (BOAT, PLACE, DOES) if i % 2 else (CAKE, OVEN, COOKS)
        yield " ".join(str(rng.choice(x)) for x in (FILL, thing, does, FILL, where, FILL))


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t) for i, t in enumerate(made_texts(3000))] + [(-1, None), (-2, " "), (-3, "zebra")]
    return spark.createDataFrame(rows, "message_id long, cleaned_text string").repartition(5)


@pytest.fixture(scope="module")
def learnt(texts):
    return word_vectors.learn_word_vectors(texts, size=8, vocabulary=200)


def test_counts_and_directions(spark, texts):
    """Against a plain count and a dense decomposition."""
    known = [r.word for r in texts.select(F.explode(word_vectors.words_of(F.col("cleaned_text"))).alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").collect()]
    want = Counter()
    for text in made_texts(3000):
        words = text.split()
        for i, j in itertools.permutations(range(len(words)), 2):
            if abs(i - j) <= 4:
                want[words[i], words[j]] += 1
    size, total = len(known), sum(want.values())
    counts = np.array([[want[a, b] for b in known] for a in known], float)
    context = counts.sum(0) ** 0.75
    with np.errstate(divide="ignore", invalid="ignore"):
        dense = np.log(counts / counts.sum(1, keepdims=True) / (context / context.sum()))
    dense = np.where(np.isfinite(dense) & (dense > 0), dense, 0.0)
    left, values, _ = np.linalg.svd(dense)
    found = word_vectors.learn_word_vectors(texts, size=8, vocabulary=200, half_weight=1e9)
    assert found.words == known and total > 0
    ours, theirs = found.vectors @ found.vectors.T, (left[:, :8] * values[:8]) @ left[:, :8].T
    assert np.allclose(ours, theirs, atol=1e-2 * abs(theirs).max())
    assert found.vectors.shape == (size, 8)


def test_reworded_pairs_are_closer(spark, learnt):
    pairs = [("the boat sinks at a pier", "now a ferry drowns by the dock"), ("a cake bakes in the oven", "the bread roasts on a grill")]
    rows = [(i, t) for i, t in enumerate(itertools.chain(*pairs))]
    df = spark.createDataFrame(rows, "message_id long, cleaned_text string")
    vectors = np.array([r.vector for r in learnt.embed(df).orderBy("message_id").collect()])
    hashed = to_matrix(with_word_codes(df, "cleaned_text").orderBy("message_id").select("vector").toArrow()["vector"])
    near, plain = vectors @ vectors.T, hashed @ hashed.T
    for a, b in ((0, 1), (2, 3)):
        assert near[a, b] > 0.85 and near[a, b] > plain[a, b] + 0.3
    assert near[0, 2] < 0.5 and near[1, 3] < 0.5


def test_duplicates_by_learnt_vectors(spark, learnt):
    texts = ["the boat sinks at a pier", "a cake bakes in the oven", "now a ferry drowns by the dock", "", "zebra"]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "message_id long, arrival_seq long, cleaned_text string")
    rows = {r.message_id: r for r in deduplicate(learnt.embed(df)).collect()}
    assert [rows[i].is_duplicate for i in range(5)] == [False, False, True, False, False]
    assert rows[2].matched_id == 0


def test_edges(spark, texts, learnt, tmp_path):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "zzz"), (4, "boat " * 200_000)], "id long, cleaned_text string")
    rows = {r.id: np.array(r.vector) for r in learnt.embed(odd).collect()}
    assert all(not rows[i].any() and len(rows[i]) == 8 for i in (1, 2, 3)) and np.linalg.norm(rows[4]) == pytest.approx(1)
    none = word_vectors.learn_word_vectors(texts.limit(0), size=8)
    assert none.words == [] and not np.array(none.embed(odd).first().vector).any()
    learnt.save(spark, str(tmp_path / "words"))
    again = word_vectors.WordVectors.load(spark, str(tmp_path / "words"))
    assert again.words == learnt.words and np.array_equal(again.vectors, learnt.vectors)
