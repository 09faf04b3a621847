"""Is a message about a crisis?"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin import config as C
from tocsin.functions.numbers import softmax
from tocsin.functions.text import is_blank
from tocsin.functions.vectors import similarities


def score_with_model(df: DataFrame, model: PipelineModel, *, text_col: str = "cleaned_text") -> DataFrame:
    """Add ``model_score`` (probability of class 1) and ``model_flag``.

    A tie goes to class 0.
    """
    fitted = model.transform(df.withColumn("text_for_model", F.col(text_col)))
    probability = vector_to_array("probability")
    return fitted.select(
        *df.columns,
        probability[1].alias("model_score"),
        (probability[1] > probability[0]).alias("model_flag"),
    )


def score_with_prototypes(
    df: DataFrame,
    prototypes: np.ndarray,
    *,
    vector_col: str = "vector",
    name: str = "label_score",
    scale: float = 1.0,
) -> DataFrame:
    """Add the crisis label's share among the candidate labels.

    The first prototype is the crisis label.  Shares are a softmax over the
    message's own similarities, so they add up to 1.
    """
    staged = df.withColumn("_sim", similarities(F.col(vector_col), prototypes))
    scaled = F.transform("_sim", lambda s: F.round(s, 10) * scale)
    return staged.withColumn(name, F.get(softmax(scaled), F.lit(0))).drop("_sim")


def decide_relevance(
    df: DataFrame,
    *,
    text_col: str = "cleaned_text",
    model_score: str | None = None,
    model_flag: str | None = None,
    label_score: str | None = None,
    settings: C.Settings = C.DEFAULTS,
) -> DataFrame:
    """Add ``is_relevant``, ``relevance_confidence`` and ``relevance_label``.

    The trained model decides where it gave a score, the label score where it
    did not.  Blank messages and rows without any score are not relevant.
    """
    blank = is_blank(F.col(text_col))

    def column(name: str | None, kind: str) -> Column:
        return F.col(name) if name else F.lit(None).cast(kind)

    share = column(label_score, "double")
    score = F.coalesce(column(model_score, "double"), share, F.lit(0.0))
    flag = F.coalesce(
        column(model_flag, "boolean"), share >= settings.relevance_threshold, F.lit(False)
    )
    staged = df.select(
        "*",
        F.when(blank, False).otherwise(flag).alias("is_relevant"),
        F.when(blank, 0.0).otherwise(F.round(score, 4)).alias("relevance_confidence"),
    )
    return staged.withColumn(
        "relevance_label", F.when(F.col("is_relevant"), "RELEVANT").otherwise("NOT_RELEVANT")
    )
