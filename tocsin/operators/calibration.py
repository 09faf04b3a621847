"""Event type scores that are probabilities: one model against the rest for each type, then isotonic calibration.

A logistic model ranks messages by type but its numbers are no shares of
right answers.  On rows that no model was fitted on, its scores are counted
in a fixed number of equal bins, and the rising step function that fits the
bins best replaces them.  A score of 0.40 then means that about 40 of 100
such messages are of the type, which is what the type threshold asks for.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.operators.event_types import SHORT_LABELS
from tocsin.operators.training import TEXT, token_stages
from tocsin.runtime import materialise

#: Bins of a model's score; what is gathered for a type is two numbers for each.
BINS = 256


def rising_fit(positives: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rising shares that fit the bins' counts best in least squares; bins without rows lie between their neighbours.

    Neighbouring bins are pooled while a share is above the one behind it.
    """
    filled = np.flatnonzero(rows)
    if not len(filled):
        return np.full(len(rows), np.nan)
    pools: list[list[float]] = []
    for right, count in zip(positives[filled].tolist(), rows[filled].tolist(), strict=True):
        pools.append([right, count, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    shares = np.repeat([right / count for right, count, _ in pools], [int(width) for *_, width in pools])
    return np.interp(np.arange(len(rows)), filled, shares)


def score_bin(score: Column, bins: int = BINS) -> Column:
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")


def bin_counts(df: DataFrame, scores_col: str, gold_col: str, labels: list[str], bins: int = BINS) -> DataFrame:
    """``pos, bin, rows, positives`` by label position; one aggregate over all labels, bounded in size.

    ``scores_col`` is an array by label position, ``gold_col`` the names of
    the types that a row has; null scores are left out.
    """
    names = F.array(*[F.lit(x) for x in labels])
    flags = F.transform(names, lambda x: F.coalesce(F.array_contains(gold_col, x), F.lit(False)))
    pairs = df.select(F.posexplode(F.arrays_zip(F.col(scores_col).alias("score"), flags.alias("hit"))).alias("pos", "_p"))
    return (
        pairs.where("_p.score is not null")
        .groupBy("pos", score_bin(F.col("_p.score"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("_p.hit").alias("positives"), F.sum("_p.score").alias("total"))
    )


def calibration_error(
    df: DataFrame, scores_col: str, gold_col: str, labels: list[str] = SHORT_LABELS, bins: int = 10
) -> DataFrame:
    """By label how far scores are from shares: ``label, rows, positives, error``.

    The error is the mean distance of a bin's mean score from its share of
    right rows, weighted by rows.  Labels without scored rows have no row.
    """
    counts = bin_counts(df, scores_col, gold_col, labels, bins)
    far = F.abs(F.col("total") - F.col("positives"))
    found = counts.groupBy("pos").agg(
        F.sum("rows").alias("rows"), F.sum("positives").alias("positives"), (F.sum(far) / F.sum("rows")).alias("error")
    )
    return found.select(F.get(F.array(*[F.lit(x) for x in labels]), F.col("pos")).alias("label"), "rows", "positives", "error")


@dataclass(frozen=True)
class TypeModels:
    """Text features with a model for each label, and the share that stands for each bin of its scores."""

    model: PipelineModel
    labels: tuple[str, ...]
    shares: np.ndarray

    def raw_scores(self, df: DataFrame, *, text_col: str = "cleaned_text", name: str = "type_scores_raw") -> DataFrame:
        """Add the models' own scores by label position."""
        scored = self.model.transform(df.withColumn(TEXT, F.coalesce(text_col, F.lit(""))))
        each = [vector_to_array(F.col(f"_probability_{i}"))[1] for i in range(len(self.labels))]
        return scored.select(*[c for c in df.columns if c != name], F.array(*each).alias(name))

    def scores(self, df: DataFrame, *, text_col: str = "cleaned_text", name: str = "type_scores_raw") -> DataFrame:
        """Add calibrated scores by label position, for ``label_event_types``; a projection, also on a stream.

        A null or blank text has the score of a text without words.
        """
        raw = self.raw_scores(df, text_col=text_col, name=name)
        tables = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in self.shares])
        calibrated = F.transform(name, lambda s, i: F.get(F.get(tables, i), score_bin(s, self.shares.shape[1])))
        return raw.withColumn(name, calibrated)

    def save(self, path: str) -> None:
        """Write the models and, beside them, the labels and shares."""
        self.model.write().overwrite().save(f"{path}/models")
        rows = [(i, label, json.dumps(row.tolist())) for i, (label, row) in enumerate(zip(self.labels, self.shares, strict=True))]
        SparkSession.active().createDataFrame(rows, "pos int, label string, shares string").coalesce(1).write.mode("overwrite").parquet(f"{path}/shares")

    @classmethod
    def load(cls, path: str) -> TypeModels:
        rows = SparkSession.active().read.parquet(f"{path}/shares").orderBy("pos").collect()
        return cls(PipelineModel.load(f"{path}/models"), tuple(r.label for r in rows), np.array([json.loads(r.shares) for r in rows]))


def train_type_models(
    df: DataFrame,
    *,
    text_col: str = "cleaned_text",
    gold_col: str = "event_types",
    labels: list[str] = SHORT_LABELS,
    features: int = 1 << 14,
    steps: int = 20,
    penalty: float = 1e-3,
    max_tokens: int | None = None,
    bins: int = BINS,
    seed: int = 7,
) -> TypeModels:
    """Fit one model for each label on about two thirds of the texts and calibrate it on the others.

    ``gold_col`` is an array of the types that a message has, none, one or
    several; null rows teach nothing.  Equal texts lie on one side of the
    split.  A label that no fitted row has has one score for all texts, its
    share of the other third; without rows there the models' scores stay.
    Without any row to fit on, Spark raises.
    """
    rows = df.where(F.col(gold_col).isNotNull()).select(
        F.coalesce(text_col, F.lit("")).alias(TEXT),
        *[F.array_contains(gold_col, x).cast("double").alias(f"_target_{i}") for i, x in enumerate(labels)],
        F.col(gold_col).alias("_gold"),
    )
    held = F.pmod(F.xxhash64(TEXT, F.lit(seed)), F.lit(3)) == 0
    front = Pipeline(stages=token_stages(max_tokens) + [
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="features"),
    ]).fit(rows.where(~held))
    # The features are written once, as each label's solver passes over them several times.
    prepared = materialise(
        front.transform(rows).select("features", held.alias("_held"), "_gold", *[f"_target_{i}" for i in range(len(labels))]),
        "type_rows",
    )
    fitted_on = prepared.where("not _held")
    models = [
        LogisticRegression(
            featuresCol="features", labelCol=f"_target_{i}", predictionCol=f"_said_{i}", probabilityCol=f"_probability_{i}",
            rawPredictionCol=f"_margin_{i}", maxIter=steps, regParam=penalty, family="binomial",
        ).fit(fitted_on)
        for i in range(len(labels))
    ]
    scorer = PipelineModel(stages=models)
    scored = scorer.transform(prepared.where("_held")).select(
        F.array(*[vector_to_array(F.col(f"_probability_{i}"))[1] for i in range(len(labels))]).alias("_scores"), "_gold"
    )
    counts = bin_counts(scored, "_scores", "_gold", list(labels), bins).collect()  # at most labels x bins rows
    shares = np.empty((len(labels), bins))
    for i in range(len(labels)):
        own = [r for r in counts if r.pos == i]
        positives, seen = np.zeros(bins), np.zeros(bins)
        for r in own:
            positives[r.bin], seen[r.bin] = r.positives, r.rows
        shares[i] = rising_fit(positives, seen) if own else (np.arange(bins) + 0.5) / bins
    return TypeModels(PipelineModel(stages=[*front.stages, *models]), tuple(labels), shares)
