"""Urgency of a message from candidate scores and a keyword lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin import config as C
from tocsin.functions.numbers import add_up
from tocsin.functions.text import is_blank

LEXICON = {**C.CRITICAL_KEYWORDS, **C.HIGH_KEYWORDS}


def keyword_boost(lowered: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """Weights of all keywords found as substrings, each once, at most 1."""
    hits = [F.when(lowered.contains(k), w).otherwise(0.0) for k, w in lexicon.items()]
    return F.least(F.lit(1.0), add_up(hits))


def matched_keywords(lowered: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """The keywords found, in lexicon order."""
    return F.array_compact(F.array(*[F.when(lowered.contains(k), F.lit(k)) for k in lexicon]))


def semantic_score(scores: Column) -> Column:
    """Candidate scores, by level position, weighted by level."""
    return add_up([F.get(scores, F.lit(i)) * F.lit(w) for i, (_, w) in enumerate(C.URGENCY_LEVELS)])


def level_of(score: Column, settings: C.Settings = C.DEFAULTS) -> Column:
    return (
        F.when(score >= settings.urgency_critical, "CRITICAL")
        .when(score >= settings.urgency_high, "HIGH")
        .when(score >= settings.urgency_medium, "MEDIUM")
        .otherwise("LOW")
    )


def score_urgency(
    df: DataFrame,
    *,
    text_col: str = "cleaned_text",
    scores_col: str = "urgency_scores",
    gate: Column | None = None,
    lexicon: dict[str, float] = LEXICON,
    settings: C.Settings = C.DEFAULTS,
) -> DataFrame:
    """Add ``urgency_level``, ``urgency_score`` and ``keyword_boost``.

    Blank or gated-out rows are LOW with 0; rows without candidate scores
    are MEDIUM with 0.5.
    """
    text, scores = F.col(text_col), F.col(scores_col)
    skipped = is_blank(text) if gate is None else is_blank(text) | ~gate
    failed = scores.isNull()
    # Lower-cased once, in a projection of its own, for all keywords.
    parts = df.withColumn("_lower", F.when(~(skipped | failed), F.lower(text))).withColumn(
        "_boost",
        F.when(skipped | failed, F.lit(0.0)).otherwise(keyword_boost(F.col("_lower"), lexicon)),
    ).withColumn(
        "_score",
        F.when(skipped, F.lit(0.0))
        .when(failed, F.lit(0.5))
        .otherwise(
            F.least(
                F.lit(1.0),
                semantic_score(scores) * settings.model_weight + F.col("_boost") * settings.keyword_weight,
            )
        ),
    )
    return (
        parts.withColumn("urgency_level", level_of(F.col("_score"), settings))
        .withColumn("urgency_score", F.round("_score", 4))
        .withColumn("keyword_boost", F.round("_boost", 4))
        .drop("_boost", "_score", "_lower")
    )
