"""Words hashed in tasks, trigrams counted without rows of their own, and cleaning done once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tocsin.functions import text as X
from tocsin.functions.vectors import CODE_DIM, folded, with_word_codes, with_word_counts, xxhash64
from tocsin.operators import language

TEXTS = [
    "Fire, fire near  Lyon!", "", None, "   ", "...", "a", " a\tb\n\nc ", "Türkiye café, İSTANBUL Straße ΟΔΟΣ", "東京 and 大阪、神戸",
    "x_1 y-2 z.3", "q" * 100 + " " + "r" * 37 + "," + "s" * 32 + "-" + "t" * 31, " no break wide", "\U0001F525\U0001F198 SOS",
    "one two " * 3000, "a" * 5000,
]


def test_stretches_are_hashed_as_by_the_sql_function(spark):
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in range(100)]
    data = np.frombuffer("".join(words).encode() + bytes(8), np.uint8)
    sizes = np.array([len(w) for w in words])
    got = xxhash64(data, np.cumsum(sizes) - sizes, sizes).astype(np.int64).tolist()
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", F.xxhash64("w").alias("h")).orderBy("i")
    assert got == [r.h for r in rows.collect()]


@pytest.mark.parametrize("part", [1, 4000, 1 << 17])
def test_counts_are_the_folded_codes(spark, monkeypatch, part):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").coalesce(1)
    codes = with_word_codes(rows, "t")
    want = [r.v for r in codes.select("i", folded(codes).alias("v")).orderBy("i").collect()]
    assert [r.vector for r in with_word_counts(rows, "t").orderBy("i").collect()] == want
    monkeypatch.setattr("tocsin.functions.vectors.WORD_BYTES", part)
    from tocsin.functions import vectors

    words = [None if t is None else " ".join(t.split()) for t in ("a b a", None, "", "c " * 50, "d")]
    whole = vectors._hashed_words(pa.array(words, pa.string()))
    assert vectors._word_counts.func(pa.array(words, pa.string())).to_pylist() == [
        None if w is None else c.tolist() for w, c in zip(words, whole, strict=True)
    ]
    assert whole.shape == (5, CODE_DIM)


def test_trigrams_are_counted_within_lines():
    lines = pa.array([" ab ", None, "", " a ", "xy", "\U0001F525" * 4, "x"])
    codes, sizes = language.trigram_codes(lines)
    points = [[ord(c) for c in line or ""] for line in lines.to_pylist()]
    want = [(a * 961 + b * 31 + c) % language.BUCKETS for p in points for a, b, c in zip(p, p[1:], p[2:], strict=False)]
    assert codes.tolist() == want and sizes.tolist() == [2, 0, 0, 1, 0, 2, 0]


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_counted_trigrams_do_not_grow_with_the_text(monkeypatch, cells):
    monkeypatch.setattr(language, "MOST_CELLS", cells)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "fr", "en"], "line": [" the cat " * 5000, " le chat ", " the dog "]})
    rows = [r for b in language._counted(iter([batch])) for r in b.to_pylist()]
    assert len(rows) < 60 and sum(r["n"] for r in rows) == 9 * 5000 - 2 + 7 + 7
    assert len({(r["lang"], r["code"]) for r in rows}) == len(rows)


def test_dense_and_sparse_scores_are_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([("the cat sat", "en"), ("le chat noir", "fr"), ("der hund", "de")], "text string, lang string")
    model = language.train_language_model(rows)
    codes, sizes = language.trigram_codes(pa.array(["", " the chat ", " der hund sat ", None]))
    dense = model.scores(codes, sizes)
    monkeypatch.setattr(language, "DENSE_LANGUAGES", 0)
    assert np.array_equal(dense, model.scores(codes, sizes))
    assert np.array_equal(model.scores(codes[:0], np.zeros(2, int)), np.array([model.log_prior] * 2))


def test_spaces_collapse_to_one_blank(spark):
    texts = ["a b", " a  b\t", "\n\n", "a b  c  d", "x\r\n\r\ny ", "　z", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.collapse_spaces(F.col("t")).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == ["a b", "a b", "", "a b c d", "x y", "z", "", None]


def test_texts_are_cleaned_once_for_the_models(spark, sf_dir, monkeypatch):
    from checks import catalog
    from tocsin.plans import analysis

    calls = []
    real = catalog.clean_messages
    for module in (catalog, analysis):
        monkeypatch.setattr(module, "clean_messages", lambda df, **o: calls.append(1) or real(df, **o))
    results = catalog.q_analyze_models(spark, sf_dir)
    assert len(calls) == 1 and results.count() == catalog.tables.messages(spark, sf_dir).count()


def test_normal_form_is_made_in_parts_of_a_batch():
    import tracemalloc

    texts = pa.array(["é word " * 1000 + "\U0001F525"] * 4000, pa.string())  # 36 MB, 4 bytes a character in Python
    tracemalloc.start()
    try:
        made = X._nfc.func(texts)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert len(made) == 4000 and made[3999].as_py() == "é word " * 1000 + "\U0001F525"
    assert peak < 60
