"""Training of the relevance model: Spark ML features, mini-batch epochs, the best one kept."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin import config as C
from tocsin.operators.evaluation import gold_by_name, quality
from tocsin.operators.optimiser import run_epochs
from tocsin.runtime import new_table_path

TEXT = "text_for_model"


def token_stages(max_tokens: int | None) -> list:
    """Word tokens of ``text_for_model``; the whole text unless a limit is set."""
    tokens = RegexTokenizer(inputCol=TEXT, outputCol="all_tokens", pattern=rf"{C.WORD}+", gaps=False, toLowercase=True)
    kept = "all_tokens" if max_tokens is None else f"slice(all_tokens, 1, {int(max_tokens)})"
    return [tokens, SQLTransformer(statement=f"SELECT *, {kept} AS tokens FROM __THIS__")]


def labelled(df: DataFrame, *, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Text and a 0/1 target; other columns are kept out of the shuffle."""
    return df.select(
        F.coalesce(text_col, F.lit("")).alias(TEXT),
        gold_by_name(F.col(label_col)).cast("double").alias("target"),
    )


def train_relevance(
    train: DataFrame,
    validation: DataFrame | None = None,
    *,
    text_col: str = "text",
    label_col: str = "label",
    epochs: int = 12,
    patience: int = 2,
    features: int = 1 << 18,
    penalties: tuple[float, ...] = (1e-5,),
    rate: float = 2.0,
    max_tokens: int | None = None,
    seed: int = 7,
    folder: str | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Fit the model epoch by epoch and keep the best one.  Returns the model and one metrics row.

    After each epoch the loss on the validation rows is taken; the epoch with
    the least loss is the model, and ``patience`` epochs without a lower one
    end the run.  Candidates differ in their penalty.  If no validation rows
    are given, about a quarter of the texts is held out.  Word weights come
    from the training rows alone.  The metrics row has the quality of the
    kept epoch and ``history``, all epochs.  With ``folder`` a run that was
    stopped goes on after its last whole epoch there.
    """
    spark = train.sparkSession
    rows = labelled(train, text_col=text_col, label_col=label_col)
    if validation is None:
        # Equal texts lie on one side.
        held = F.pmod(F.xxhash64(TEXT, F.lit(seed)), F.lit(4)) == 0
        fitted_on, held_out = rows.where(~held), rows.where(held)
        if held_out.isEmpty() or fitted_on.isEmpty():
            fitted_on = held_out = rows
    else:
        fitted_on, held_out = rows, labelled(validation, text_col=text_col, label_col=label_col)
    stages = token_stages(max_tokens) + [
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="features"),
    ]
    front = Pipeline(stages=stages).fit(fitted_on)
    folder = folder or new_table_path(spark, "epochs")
    fitted_on, held_out = (
        _prepared(front, part, f"{folder}/{name}", seed) for name, part in (("rows", fitted_on), ("held_out", held_out))
    )
    runs = {
        penalty: run_epochs(
            fitted_on, held_out, f"{folder}/penalty={penalty}", size=features, epochs=epochs, patience=patience, rate=rate,
            penalty=penalty,
        )
        for penalty in penalties
    }
    penalty, best = min(((p, e) for p, run in runs.items() for e in run), key=lambda found: found[1].loss)
    history = [
        (float(p), e.number, e.loss, *(int(e.measured[x]) for x in ("tp", "fp", "fn", "tn"))) for p, run in runs.items() for e in run
    ]
    row = next(h for h in history if h[:2] == (float(penalty), best.number))
    counted = quality(spark.createDataFrame([row], EPOCH).select("tp", "fp", "fn", "tn"))
    metrics = spark.createDataFrame(
        [(*counted.first(), *row[:3], history)],
        T.StructType([*counted.schema, *T.StructType.fromDDL(f"penalty double, epoch int, loss double, history array<struct<{EPOCH}>>")]),
    )
    return PipelineModel(stages=[*front.stages, logistic_model(best.weights)]), metrics


EPOCH = "penalty double, epoch int, loss double, tp long, fp long, fn long, tn long"


def _prepared(front: PipelineModel, rows: DataFrame, path: str, seed: int) -> DataFrame:
    """Features as a table, with a random place for each row; what a stopped run left there is made anew."""
    spark = rows.sparkSession
    made = front.transform(rows).select("features", "target", F.rand(seed).alias("place"))
    made.write.mode("overwrite").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def logistic_model(weights: np.ndarray) -> LogisticRegressionModel:
    """A Spark model of given weights, the last of which is the intercept."""
    at = np.flatnonzero(weights[:-1])
    coefficients = Vectors.sparse(len(weights) - 1, at.tolist(), weights[at].tolist())
    model = LogisticRegressionModel._create_from_java_class(
        "org.apache.spark.ml.classification.LogisticRegressionModel", f"relevance_{uuid.uuid4().hex[:12]}",
        coefficients, float(weights[-1]),
    )
    return model.setFeaturesCol("features")


def area_under_roc(model: PipelineModel, rows: DataFrame, *, text_col: str = "text", label_col: str = "label") -> float:
    scored = model.transform(labelled(rows, text_col=text_col, label_col=label_col))
    return BinaryClassificationEvaluator(labelCol="target", rawPredictionCol="rawPrediction").evaluate(scored)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
