"""Text statistics against plain Python, and rules learnt from labelled rows."""

from __future__ import annotations

import re
import zlib

import pytest
from pyspark.sql import functions as F

from tocsin.llm import decision_lists

SCHEMA = "doc_id long, text string, rule string, _text int, n_words string"
TEXTS = [
    None, "", " ", "\n\n", "one", "a b c", "a b c a b c", "a b c a b c a b", "x x x x x", "# a* $b %c &d |e <f> ##",
    "same line\nsame line\n\n  \nsame line \nother", " lead and trail ", "tab\tvt\x0bff\x0cnb\xa0sp", "日本 語 日本 語 日本 語",
    "word " * 60, " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i % 30}" for i in range(90)), "UPPER 123 " * 30,
    " ".join(f"w{i % 997} x{i}" for i in range(30_000)), "\r\n".join(["l1 l2 l3"] * 4), "a b c d e f a b c",
]


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, places = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places.update(j for i in at for j in (i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places),
    )


def base_failed(n):
    return n[0] < 50 or 100 * n[4] > 50 * n[0]


def rows_of():
    rows = [(i, t, "r", 1, "n") for i, t in enumerate(TEXTS)]
    return [*rows, rows[5], (None, "no id at all", "r", 1, "n"), (None, None, "r", 1, "n")]


def test_statistics_against_plain_python(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = decision_lists.judge(df, decision_lists.DecisionList(())).collect()
    expected = [(r[0], *statistics(r[1]), base_failed(statistics(r[1])), not base_failed(statistics(r[1]))) for r in rows]
    assert sorted((tuple(r)[:8] for r in found), key=str) == sorted(expected, key=str)


def test_statistics_of_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = decision_lists.judge(df, decision_lists.DecisionList(())).collect()
    texts = dict(tuple(r) for r in df.select("doc_id", "text").collect())
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r)[1:6] == statistics(texts[r["doc_id"]])


def test_long_repetitive_text(spark):
    df = spark.createDataFrame([(1, "la " * 200_000, "r", 1, "n")], SCHEMA)
    row = decision_lists.judge(df, decision_lists.DecisionList(())).first()
    assert row["n_words"] == row["n_repeat_words"] == 200_000 and not row["kept"]


def features(spark, rows):
    """Rows of (feature values by name, bad): the others are constant."""
    names = decision_lists.FEATURES
    data = [(*[float(values.get(n, 1.0)) for n in names], bad, i % 3 == 0) for i, (values, bad) in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{n} double" for n in names) + ", _bad boolean, _prune boolean").cache()


def test_rules_cover_conjunctions_in_order(spark):
    rows = [({"symbol_share": s / 100, "mean_word": m}, s > 30 or (m < 4 and s > 10)) for s in range(60) for m in (2, 3, 5, 6, 7)]
    rules = decision_lists.learn_rules(features(spark, rows))
    assert 2 <= len(rules.rules) <= 4
    df = features(spark, rows).withColumn("rule", rules.column())
    wrong = df.filter(F.col("_bad") != (F.col("rule") > 0)).count()
    assert wrong <= 0.05 * len(rows)
    assert rules.sql().startswith("CASE WHEN ") and rules.sql().endswith("ELSE 0 END")


def test_rules_that_do_not_hold_elsewhere_are_pruned(spark):
    noise = [({"words": i, "mean_word": (i * 7919) % 101, "upper_share": (i * 104729) % 97}, (i * 31337) % 11 == 0) for i in range(900)]
    assert decision_lists.learn_rules(features(spark, noise)).rules == ()


def test_no_rule_without_both_kinds(spark):
    good = [({"words": i}, False) for i in range(30)]
    assert decision_lists.learn_rules(features(spark, good)).sql() == "0"
    assert decision_lists.learn_rules(features(spark, [])).rules == ()


def test_quality_on_empty_tables_and_odd_labels(spark):
    docs = spark.createDataFrame(rows_of(), SCHEMA)
    labels = spark.createDataFrame([(1, None), (None, 0), (2, 7), (15, 0), (15, 1), (15, 1)], "doc_id long, quality int")
    found = decision_lists.quality(docs, labels).collect()
    assert len(found) == len(rows_of()) and {r["rule"] for r in found} == {0}
    assert decision_lists.quality(docs.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    found = decision_lists.quality(docs, labels)
    assert not any("Python" in x or "Arrow" in x for x in found._jdf.queryExecution().executedPlan().toString().split())
    rows = found.join(labels, "doc_id").filter("NOT base_failed").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good = [r for r in rows if r["quality"] == 1]
    held_bad = [r for r in rows if r["quality"] == 0 and r["held_out"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in held_bad) >= 0.8 * len(held_bad)
