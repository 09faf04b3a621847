"""Urgency, event types, relevance and language rules."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin import config as C
from tocsin.functions.vectors import learn_prototypes, with_word_codes
from tocsin.operators.event_types import label_event_types, scores_to_arrays
from tocsin.operators.language import (
    BUCKETS,
    detect_language,
    load_language_model,
    save_language_model,
    train_language_model,
)
from tocsin.operators.relevance import decide_relevance, score_with_model, score_with_prototypes
from tocsin.operators.training import area_under_roc, load_model, save_model, train_relevance
from tocsin.operators.urgency import matched_keywords, score_urgency


def urgency_rows(spark, rows):
    df = spark.createDataFrame(
        [(i, t, s) for i, (t, s) in enumerate(rows)], "message_id long, cleaned_text string, urgency_scores array<double>"
    )
    df = df.withColumn("kw", matched_keywords(F.lower("cleaned_text")))
    return score_urgency(df).orderBy("message_id").collect()


def test_urgency(spark):
    rows = urgency_rows(spark, [
        ("People TRAPPED, urgente: help us", [0.7, 0.2, 0.1, 0.0]),
        ("calm day", [0.0, 0.0, 0.0, 1.0]),
        ("  ", [1.0, 0.0, 0.0, 0.0]),
        ("no scores, fire", None),
        ("trapped dying drowning buried collapsed fire bleeding", [1.0, 0.0, 0.0, 0.0]),
        (None, None),
    ])
    # "urgente" holds "urgent" as well
    assert rows[0].kw == ["trapped", "help us", "urgent", "urgente"]
    assert rows[0].keyword_boost == 0.75
    assert rows[0].urgency_score == round(0.7 * 0.9 + 0.3 * 0.75, 4)
    assert [r.urgency_level for r in rows] == ["CRITICAL", "LOW", "LOW", "MEDIUM", "CRITICAL", "LOW"]
    assert rows[1].urgency_score == 0.175
    assert (rows[2].urgency_score, rows[2].keyword_boost) == (0.0, 0.0)
    assert (rows[3].urgency_score, rows[3].keyword_boost) == (0.5, 0.0)
    assert (rows[4].urgency_score, rows[4].keyword_boost) == (1.0, 1.0)


def test_event_types(spark):
    short = [s for _, s in C.EVENT_TYPES]
    base = [0.1] * 8
    two = [0.1, 0.9, 0.1, 0.40, 0.1, 0.39999, 0.1, 0.1]
    none = [0.1, 0.2, 0.1, 0.3, 0.1, 0.3, 0.1, 0.1]
    df = spark.createDataFrame(
        [(0, "x", two), (1, "x", none), (2, " ", base), (3, "x", None), (4, "x", two)],
        "message_id long, cleaned_text string, type_scores_raw array<double>",
    )
    rows = label_event_types(df, gate=F.col("message_id") < 4).orderBy("message_id").collect()
    assert rows[0].event_types == [short[1], short[3]] and rows[0].top_label == short[1]
    assert rows[0].type_scores[short[5]] == 0.4 and len(rows[0].type_scores) == 8
    assert rows[1].event_types == [short[3]] and rows[1].top_score == 0.3
    assert rows[2].event_types == [] and rows[2].type_scores == {} and rows[2].top_label == "UNKNOWN"
    assert rows[3].event_types == ["UNKNOWN"] and rows[3].top_score == 0.0
    assert rows[4].event_types == []


def test_score_tables_become_arrays(spark):
    df = spark.createDataFrame([(1, "b", 0.2), (1, "a", 0.1), (2, "a", 0.3)], "message_id long, label string, score double")
    rows = {r.message_id: r.s for r in scores_to_arrays(df, ["a", "b"], "s").collect()}
    assert rows == {1: [0.1, 0.2], 2: [0.3, None]}


def test_relevance_decision_and_fallback(spark):
    df = spark.createDataFrame(
        [(0, "x", 0.2, False, 0.9), (1, "x", None, None, 0.65), (2, "x", None, None, 0.6499), (3, "", 0.9, True, 0.9),
         (4, "x", None, None, None), (5, "x", 0.51, True, 0.1)],
        "message_id long, cleaned_text string, p double, f boolean, s double",
    )
    rows = decide_relevance(df, model_score="p", model_flag="f", label_score="s").orderBy("message_id").collect()
    assert [r.is_relevant for r in rows] == [False, True, False, False, False, True]
    assert [r.relevance_confidence for r in rows] == [0.2, 0.65, 0.6499, 0.0, 0.0, 0.51]
    assert rows[1].relevance_label == "RELEVANT" and rows[4].relevance_label == "NOT_RELEVANT"


def test_prototypes(spark):
    df = spark.createDataFrame(
        [(0, "flood rescue boats flood"), (1, "pizza and sunset"), (2, "flood rescue now"), (3, "sunset pizza wine")],
        "label_id long, cleaned_text string",
    ).withColumn("kind", F.col("label_id") % 2)
    df = with_word_codes(df, "cleaned_text")
    centres = learn_prototypes(df, "kind", "vector", [0, 1])
    assert centres.shape == (2, 256) and np.allclose(np.linalg.norm(centres, axis=1), 1)
    scored = score_with_prototypes(df, centres, scale=10.0).orderBy("label_id").collect()
    assert [r.label_score > 0.65 for r in scored] == [True, False, True, False]
    with pytest.raises(ValueError):
        learn_prototypes(df, "kind", "vector", [0, 7])


def test_language(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train_language_model(docs.where("doc_id % 2 = 0"))
    save_language_model(model, spark, str(tmp_path / "lm"))
    again = load_language_model(spark, str(tmp_path / "lm"))
    assert again.languages == model.languages and np.allclose(again.floor, model.floor)
    assert all((getattr(again, x) == getattr(model, x)).all() for x in ("starts", "columns", "weights"))
    rows = detect_language(docs.where("doc_id % 2 = 1"), again, text_col="text").collect()
    right = sum(r.lang == r.lang_code for r in rows)
    assert right / len(rows) > 0.95
    assert all(0 < r.lang_confidence <= 1 and r.lang_method == "trigram" for r in rows)
    blank = spark.createDataFrame([(1, ""), (2, None), (3, "a")], "id int, text string")
    got = detect_language(blank, again, text_col="text").orderBy("id").collect()
    assert [(r.lang_code, r.lang_confidence, r.lang_method) for r in got[:2]] == [("und", 0.0, "none")] * 2
    assert got[2].lang_method == "trigram"


def plain_shares(train, texts):
    """Posterior of the best language by add-one smoothed trigram buckets, in plain Python."""
    def codes(text):
        points = [ord(c) for c in " " + text.lower().replace("\n", " ").strip(" ") + " "]
        return [(a * 961 + b * 31 + c) % BUCKETS for a, b, c in zip(points, points[1:], points[2:])]

    counts, rows = {}, {}
    for text, lang in train:
        counts.setdefault(lang, Counter()).update(codes(text))
        rows[lang] = rows.get(lang, 0) + 1
    for text in texts:
        scores = {
            lang: math.log(rows[lang] / len(train))
            + sum(math.log((seen[c] + 1) / (seen.total() + BUCKETS)) for c in codes(text))
            for lang, seen in counts.items()
        }
        best = max(sorted(scores), key=scores.get)
        yield best, 1 / sum(math.exp(s - scores[best]) for s in scores.values())


def test_language_confidence_equals_dense_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("trim(text) <> ''")
    train = [(r.text, r.lang) for r in docs.where("doc_id % 2 = 0").select("text", "lang").collect()]
    pieces = docs.where("doc_id % 2 = 1").select("doc_id", F.substring("text", 1, 12).alias("text")).where("trim(text) <> ''")
    model = train_language_model(spark.createDataFrame(train, "text string, lang string"))
    rows = detect_language(pieces, model, text_col="text").orderBy("doc_id").collect()
    want = list(plain_shares(train, [r.text for r in rows]))
    assert len(rows) > 80 and [r.lang_code for r in rows] == [w[0] for w in want]
    assert max(abs(r.lang_confidence - w[1]) for r, w in zip(rows, want, strict=True)) < 0.01


def test_many_languages_stay_small(spark):
    rng = np.random.default_rng(5)
    made = ["".join(x) for x in zip(*[iter("".join(chr(97 + i // 26) + chr(97 + i % 26) for i in range(176)))] * 2)]
    words = {lang: ["".join(map(chr, rng.integers(0x100, 0x250, 6))) for _ in range(300)] for lang in made}
    def text(lang):
        return " ".join(rng.choice(words[lang], 60))
    train = spark.createDataFrame([(text(lang), lang) for lang in made for _ in range(20)], "text string, lang string")
    model = train_language_model(train)
    assert len(model.languages) == 176 and model.nbytes < 20 << 20
    held = spark.createDataFrame([(lang, text(lang)) for lang in made for _ in range(3)], "lang string, text string")
    assert detect_language(held, model, text_col="text").where("lang = lang_code").count() == held.count()
    small = train_language_model(train, max_bytes=176 * 4 * 400)
    assert np.bincount(small.columns).max() == 400
    assert detect_language(held, small, text_col="text").where("lang = lang_code").count() > 0.95 * held.count()
    with pytest.raises(ValueError):
        train_language_model(train, max_bytes=1000)


def test_dirty_labels_make_no_languages(spark):
    rows = [("some english words", "EN"), ("more english words", "en-GB"), ("english too", " en_us "), ("unas palabras", "es")]
    junk = [(f"text {i}", x) for i, x in enumerate(["", "12", "unknown!", "https://x.y", "und", None, "e", "english"])]
    model = train_language_model(spark.createDataFrame(rows + junk, "text string, lang string"))
    assert model.languages == ("en", "es") and np.allclose(np.exp(model.log_prior), [0.75, 0.25])
    none = train_language_model(spark.createDataFrame(junk, "text string, lang string"))
    found = detect_language(spark.createDataFrame(rows, "text string, lang string"), none, text_col="text").collect()
    assert none.languages == () and {(r.lang_code, r.lang_method) for r in found} == {("und", "failed")}


def test_training(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "doc_id", "text", "text AS cleaned_text", "CASE WHEN lang = 'en' THEN 'rescue' ELSE 'Not_Humanitarian' END AS label"
    )
    train, held = docs.where("doc_id % 4 > 0"), docs.where("doc_id % 4 = 0")
    model, metrics = train_relevance(train, held, features=1 << 12)
    row = metrics.first()
    assert row.f1 > 0.9 and row.n_samples == held.count()
    losses = [e.loss for e in row.history]
    assert row.loss == min(losses) and row.epoch == losses.index(min(losses)) + 1
    assert len(losses) == 12 or len(losses) == row.epoch + 2
    assert area_under_roc(model, held) > 0.95
    save_model(model, str(tmp_path / "model"))
    first = score_with_model(held, model).orderBy("doc_id").collect()
    second = score_with_model(held, load_model(str(tmp_path / "model"))).orderBy("doc_id").collect()
    assert first == second and all((r.model_score > 0.5) == r.model_flag for r in first)
    short, _ = train_relevance(train, held, features=1 << 12, max_tokens=128)
    assert score_with_model(held, short).count() == held.count()


def test_training_goes_on_after_its_last_epoch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "text", "CASE WHEN lang = 'en' THEN 'rescue' ELSE 'not_humanitarian' END AS label"
    )
    settings = {"features": 1 << 10, "patience": 9}
    whole, first = train_relevance(docs, epochs=3, folder=str(tmp_path / "a"), **settings)
    train_relevance(docs, epochs=1, folder=str(tmp_path / "b"), **settings)
    kept = (tmp_path / "b/penalty=1e-05/epoch=1").stat().st_mtime_ns
    again, second = train_relevance(docs, epochs=3, folder=str(tmp_path / "b"), **settings)
    assert (tmp_path / "b/penalty=1e-05/epoch=1").stat().st_mtime_ns == kept
    one, two = first.first(), second.first()
    assert [e.epoch for e in two.history] == [1, 2, 3]
    assert np.allclose([e.loss for e in one.history], [e.loss for e in two.history])
    assert np.allclose(whole.stages[-1].coefficients.toArray(), again.stages[-1].coefficients.toArray())


def test_word_weights_come_from_training_rows(spark):
    rows = spark.createDataFrame([("flood rescue", "rescue"), ("pizza wine", "not_humanitarian")] * 4, "text string, label string")
    other = spark.createDataFrame([("flood unseen", "rescue"), (None, None)], "text string, label string")
    model, metrics = train_relevance(rows, other, features=1 << 8, epochs=2)
    assert model.stages[3].numDocs == 8 and metrics.first().n_samples == 2
