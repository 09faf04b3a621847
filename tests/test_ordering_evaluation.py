import random

import pytest
from pyspark.sql import functions as F

from tocsin.operators import evaluation as E
from tocsin.operators.ordering import with_row_index, with_running_totals, with_totals_before


def test_row_index_and_totals(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 400), rng.randint(1, 9), rng.randint(0, 2)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, seq long, v long, lead int").repartition(6)
    got = {r.id: r.n for r in with_row_index(df, "seq", "n", tie_cols=("id",)).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    led = {r.id: r.n for r in with_row_index(df, "seq", "n", lead_col="lead", tie_cols=("id",), slots=5).collect()}
    assert led == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[3], r[1], r[0])))}
    keyed = {r.id: r.n for r in with_row_index(df, "seq", "n", by=("lead",), tie_cols=("id",)).collect()}
    for lead in range(3):
        mine = sorted((r for r in rows if r[3] == lead), key=lambda r: (r[1], r[0]))
        assert [keyed[r[0]] for r in mine] == list(range(len(mine)))
    by_seq = df.groupBy("seq").agg(F.sum("v").alias("v"))
    down = {r.seq: r.t for r in with_running_totals(by_seq, "seq", {"t": F.col("v")}, descending=True).collect()}
    assert all(down[s] == sum(r[2] for r in rows if r[1] >= s) for s in down)


def test_index_of_nothing_and_of_one_value(spark):
    empty = spark.createDataFrame([], "seq long")
    assert with_row_index(empty, "seq").collect() == []
    same = spark.range(20).select(F.lit(7).alias("seq"), "id")
    assert sorted(r.row_index for r in with_row_index(same, "seq", tie_cols=("id",)).collect()) == list(range(20))


def test_totals_before(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    got = {r.id: r.b for r in with_totals_before(df, "id", "v", "b", fanout=4).collect()}
    assert got == {i: sum(2 * j for j in range(i)) for i in range(50)}


def test_gold_rules(spark):
    labels = ["rescue", "NOT_CRISIS", "Not_Humanitarian", "", "notice", None, "nan"]
    df = spark.createDataFrame(list(enumerate(labels)), "i int, label string")
    rows = df.select("i", E.gold_by_substring(F.col("label")).alias("a"), E.gold_by_name(F.col("label")).alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == [True, False, False, True, False, True, True]
    assert [r.b for r in rows] == [True, True, False, True, True, True, True]


def scored(seed, n, levels):
    rng = random.Random(seed)
    return [(rng.randint(0, levels) / levels, rng.random() < 0.4) for _ in range(n)]


@pytest.mark.parametrize("seed, levels", [(1, 7), (2, 1000)])
def test_curves(spark, seed, levels):
    data = scored(seed, 300, levels)
    df = spark.createDataFrame(data, "score double, gold_relevant boolean").repartition(5)
    points = E.score_points(df)
    pos, neg = [s for s, g in data if g], [s for s, g in data if not g]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert E.auc(points).first().auc == pytest.approx(pairs / len(pos) / len(neg), abs=1e-4)

    cuts = sorted({s for s, _ in data}, reverse=True)
    tp = [sum(s >= c for s in pos) for c in cuts]
    fp = [sum(s >= c for s in neg) for c in cuts]
    roc = sorted((r.fpr, r.tpr) for r in E.roc_curve(points).collect())
    assert roc == sorted([(0.0, 0.0)] + [(f / len(neg), t / len(pos)) for f, t in zip(fp, tp)])
    pr = sorted((r.recall, r.precision) for r in E.precision_recall_curve(points).collect())
    assert pr == sorted([(0.0, 1.0)] + [(t / len(pos), t / (t + f)) for f, t in zip(fp, tp)])
    steps = [(t - t0) / len(pos) * t / (t + f) for t0, t, f in zip([0, *tp], tp, fp)]
    assert E.average_precision(points).first().average_precision == pytest.approx(sum(steps), abs=1e-4)


def test_counts_and_ratios(spark):
    data = [("a", True, True)] * 3 + [("a", True, False)] + [("a", False, True)] * 2 + [("b", False, False)] * 4
    df = spark.createDataFrame(data, "lang string, pred_relevant boolean, gold_relevant boolean")
    row = E.quality(E.confusion(df)).first()
    assert (row.tp, row.fp, row.fn, row.tn, row.n_samples) == (3, 1, 2, 4, 10)
    assert (row.precision, row.recall, row.accuracy) == (0.75, 0.6, 0.7)
    assert row.f1 == pytest.approx(2 * 0.75 * 0.6 / 1.35, abs=1e-4)
    by = {r.lang: r for r in E.quality(E.confusion(df, by=("lang",))).collect()}
    assert by["b"].precision == 0.0 and by["b"].f1 == 0.0 and by["b"].accuracy == 1.0
    nothing = E.quality(E.confusion(df.where("false"))).first()
    assert (nothing.precision, nothing.accuracy, nothing.n_samples) == (0.0, 0.0, 0)


def test_agreement(spark):
    pairs = [("x", "x")] * 5 + [("x", "y")] * 2 + [("y", "y")] * 3 + [("z", "x")]
    matrix = E.confusion_matrix(spark.createDataFrame(pairs, "gold string, pred string"))
    f1 = [2 * 5 / (7 + 6), 2 * 3 / (3 + 5), 0.0]
    assert E.macro_f1(matrix).first().macro_f1 == pytest.approx(sum(f1) / 3, abs=1e-4)
    observed, expected = 8 / 11, (7 * 6 + 3 * 5 + 1 * 0) / 121
    assert E.kappa(matrix).first().kappa == pytest.approx((observed - expected) / (1 - expected), abs=1e-4)
