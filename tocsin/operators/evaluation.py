"""Evaluation of a binary classifier: gold flags, counts, ratios, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.functions.numbers import ratio
from tocsin.operators.ordering import with_running_totals

# Fixed value: the label of irrelevant rows.
NEGATIVE_LABEL = "not_humanitarian"


def gold_by_substring(label: Column) -> Column:
    """Positive unless the label holds "not" in any case."""
    return ~F.contains(F.lower(F.coalesce(label, F.lit(""))), F.lit("not"))


def gold_by_name(label: Column) -> Column:
    """Positive unless the label is the irrelevant one, in any case."""
    return F.lower(F.coalesce(label, F.lit(""))) != NEGATIVE_LABEL


def flag_by_score(score: Column, cut: float = 0.5) -> Column:
    return score >= cut


def evaluation_rows(
    df: DataFrame, *, text_col: str = "text", label_col: str = "label", flag_col: str = "is_relevant", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Shortened text, gold label, both flags and whether they agree."""
    gold = gold_by_substring(F.col(label_col))
    return df.select(
        *keep,
        F.concat(F.substring(text_col, 1, 80), F.lit("...")).alias("text"),
        F.col(label_col).alias("gold"),
        F.col(flag_col).alias("pred_relevant"),
        gold.alias("gold_relevant"),
        (F.col(flag_col) == gold).alias("match"),
    )


def confusion(df: DataFrame, *, by: tuple[str, ...] = (), flag_col: str = "pred_relevant", gold_col: str = "gold_relevant") -> DataFrame:
    """True and false positives and negatives, one row (per group)."""
    flag, gold = F.col(flag_col), F.col(gold_col)
    return df.groupBy(*by).agg(
        F.count_if(flag & gold).alias("tp"),
        F.count_if(flag & ~gold).alias("fp"),
        F.count_if(~flag & gold).alias("fn"),
        F.count_if(~flag & ~gold).alias("tn"),
    )


def quality(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    staged = counts.withColumns({
        "_p": ratio(tp, tp + fp), "_r": ratio(tp, tp + fn), "_a": ratio(tp + tn, n), "n_samples": n,
    })
    staged = staged.withColumn("_f", ratio(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")))
    names = {"precision": "_p", "recall": "_r", "f1": "_f", "accuracy": "_a"}
    return staged.select(
        *[c for c in counts.columns if c not in ("tp", "fp", "fn", "tn")],
        *[F.round(v, 4).alias(k) for k, v in names.items()],
        "n_samples", "tp", "fp", "fn", "tn",
    )


def confusion_matrix(df: DataFrame, *, gold_col: str = "gold", pred_col: str = "pred") -> DataFrame:
    """Row counts by gold and predicted label, for any number of labels."""
    return df.groupBy(F.col(gold_col).alias("gold"), F.col(pred_col).alias("pred")).agg(F.count("*").alias("n"))


def macro_f1(matrix: DataFrame) -> DataFrame:
    """Unweighted mean of F1 over all labels of a confusion matrix."""
    sides = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), "n",
                         F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), "n",
                         F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    per_label = sides.groupBy("label").agg(
        F.sum(F.col("n") * F.col("g")).alias("gold_n"), F.sum(F.col("n") * F.col("p")).alias("pred_n"),
        F.sum("hit").alias("hits"),
    )
    return per_label.agg(
        F.round(F.avg(ratio(2 * F.col("hits"), F.col("gold_n") + F.col("pred_n"))), 4).alias("macro_f1")
    )


def kappa(matrix: DataFrame) -> DataFrame:
    """Agreement beyond chance between gold and predicted labels."""
    side = F.struct
    sides = matrix.select(
        F.explode(F.array(
            side(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p"),
                 F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
            side(F.col("pred").alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("hit")),
        )).alias("s")
    ).select("s.*")
    per_label = sides.groupBy("label").agg(F.sum("g").cast("double").alias("g"), F.sum("p").cast("double").alias("p"), F.sum("hit").alias("hit"))
    sums = per_label.agg(F.sum("g").alias("n"), F.sum("hit").alias("agree"), F.sum(F.col("g") * F.col("p")).alias("both"))
    observed = ratio(F.col("agree"), F.col("n"))
    expected = ratio(F.col("both"), F.col("n") * F.col("n"))
    return sums.select(F.round(ratio(observed - expected, 1.0 - expected), 4).alias("kappa"))


def recall_of_places(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the gold places that were found."""
    hits = gold.select(*keys).distinct().join(found.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return hits.agg(F.round(ratio(F.count("_hit"), F.count("*")), 4).alias("place_recall"), F.count("*").alias("places"))


def score_points(df: DataFrame, *, score_col: str = "score", gold_col: str = "gold_relevant") -> DataFrame:
    """Running counts by descending distinct score.

    Equal scores are aggregated first: the points are as many as there are
    distinct scores, and a score that many rows share is one row here.
    """
    by_score = df.groupBy(F.col(score_col).alias("score")).agg(
        F.count_if(F.col(gold_col)).alias("pos"), F.count_if(~F.col(gold_col)).alias("neg")
    )
    return with_running_totals(
        by_score, "score", {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True
    )


def _class_sizes(points: DataFrame) -> tuple[Column, Column]:
    """Positives and negatives in all, two numbers."""
    row = points.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
    return F.lit(row["pos"] or 0), F.lit(row["neg"] or 0)


def _with_end(rates: DataFrame, first: str, second: str, start: tuple[float, float]) -> DataFrame:
    end = rates.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(start[0]).alias(first), F.lit(start[1]).alias(second)
    )
    return rates.unionByName(end)


def roc_curve(points: DataFrame) -> DataFrame:
    """False and true positive rate by threshold, starting at the origin."""
    all_pos, all_neg = _class_sizes(points)
    rates = points.select(
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), all_neg).alias("fpr"),
        ratio(F.col("tp"), all_pos).alias("tpr"),
    )
    return _with_end(rates, "fpr", "tpr", (0.0, 0.0))


def auc(points: DataFrame) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule.

    A point and the one before it differ by the point's own counts, so no
    neighbour has to be looked up.
    """
    width = F.col("neg").cast("double")
    height = F.col("tp") - F.col("pos") / F.lit(2.0)
    return points.agg(
        ratio(F.sum(width * height), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    ).select(F.round("auc", 4).alias("auc"))


def precision_recall_curve(points: DataFrame) -> DataFrame:
    """Precision and recall by threshold, ending at recall 0, precision 1."""
    all_pos, _ = _class_sizes(points)
    rates = points.select(
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), all_pos).alias("recall"),
    )
    return _with_end(rates, "precision", "recall", (1.0, 0.0))


def average_precision(points: DataFrame) -> DataFrame:
    """Sum of recall steps times precision."""
    step = F.col("pos").cast("double") * ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return points.agg(
        F.round(ratio(F.sum(step), F.sum("pos").cast("double")), 4).alias("average_precision")
    )


__all__ = [
    "auc", "average_precision", "confusion", "confusion_matrix", "evaluation_rows", "flag_by_score",
    "gold_by_name", "gold_by_substring", "kappa", "macro_f1", "precision_recall_curve", "quality",
    "recall_of_places", "roc_curve", "score_points",
]
