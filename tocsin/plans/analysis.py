"""The whole analysis of a messages table as one job, and its totals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin import config as C
from tocsin import schemas
from tocsin.functions.text import is_blank
from tocsin.functions.vectors import folded, similarities, with_word_counts
from tocsin.functions.numbers import softmax
from tocsin.operators.clean import clean_messages
from tocsin.operators.dedup import deduplicate
from tocsin.operators.event_types import SHORT_LABELS, label_event_types, scores_to_arrays
from tocsin.operators.language import LanguageModel, detect_language
from tocsin.operators.places import extract_places, geocode, locations_by_message
from tocsin.operators.relevance import decide_relevance, score_with_model, score_with_prototypes
from tocsin.operators.urgency import score_urgency
from tocsin.runtime import materialise

RESULT_COLUMNS = (
    "message_id", "arrival_seq", "original_text", "cleaned_text", "lang_code", "lang_confidence", "lang_method",
    "is_relevant", "relevance_confidence", "event_types", "type_scores", "urgency_level", "urgency_score",
    "locations", "is_duplicate", "cluster_id", "pipeline_version",
)


@dataclass(frozen=True)
class ScoreTables:
    """Scores from outside, long ``(message_id, label, score)`` tables.

    Relevance has the crisis label's share; types and urgency have one score
    per label, by short label and by level name.
    """

    relevance: DataFrame
    types: DataFrame
    urgency: DataFrame

    def attach(self, df: DataFrame) -> DataFrame:
        levels = [level for level, _ in C.URGENCY_LEVELS]
        share = scores_to_arrays(self.relevance, [C.RELEVANCE_LABELS[0]], "_share").select(
            "message_id", F.get("_share", F.lit(0)).alias("label_score")
        )
        return (
            df.join(share, "message_id", "left")
            .join(scores_to_arrays(self.types, SHORT_LABELS, "type_scores_raw"), "message_id", "left")
            .join(scores_to_arrays(self.urgency, levels, "urgency_scores"), "message_id", "left")
        )


@dataclass(frozen=True)
class ScoreColumns:
    """Scores that the messages table already carries."""

    relevance: str = "label_score"
    types: str = "type_scores_raw"
    urgency: str = "urgency_scores"

    def attach(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed(
            {self.relevance: "label_score", self.types: "type_scores_raw", self.urgency: "urgency_scores"}
        )


@dataclass(frozen=True)
class Prototypes:
    """Scores from similarity to label vectors; projections only.

    ``relevance`` has two rows, the crisis label first; ``types`` one row per
    event type; ``urgency`` one per level.  Type scores are independent
    (a logistic of the similarity), the others add up to 1 per message.  A
    trained relevance model, if given, goes before the label scores.
    """

    relevance: np.ndarray
    types: np.ndarray
    urgency: np.ndarray
    model: PipelineModel | None = None
    vector_col: str = "vector"
    scale: float = 10.0

    def attach(self, df: DataFrame) -> DataFrame:
        vector = F.col(self.vector_col)
        scored = score_with_prototypes(df, self.relevance, vector_col=self.vector_col, scale=self.scale)
        scored = scored.withColumns({
            "_t": similarities(vector, self.types),
            "_u": similarities(vector, self.urgency),
        })
        scored = scored.withColumns({
            "type_scores_raw": F.transform("_t", lambda s: 1.0 / (1.0 + F.exp(-F.lit(self.scale) * s))),
            "urgency_scores": softmax(F.transform("_u", lambda s: F.round(s, 10) * self.scale)),
        }).drop("_t", "_u")
        return score_with_model(scored, self.model) if self.model is not None else scored


def classify(
    df: DataFrame,
    scores: ScoreTables | ScoreColumns | Prototypes,
    *,
    language: LanguageModel | None = None,
    settings: C.Settings = C.DEFAULTS,
) -> DataFrame:
    """Language, relevance, event types and urgency of cleaned messages.

    With column or prototype scores this is a chain of projections that also
    runs on a stream.  Types and urgency are worked out for relevant rows.
    """
    if language is not None:
        df = detect_language(df, language)
    else:
        known = F.col("lang") if "lang" in df.columns else F.lit(None).cast("string")
        known = F.when(~is_blank(F.col("cleaned_text")), known)
        df = df.withColumns({
            "lang_code": F.coalesce(known, F.lit("und")),
            "lang_confidence": F.when(known.isNotNull(), 1.0).otherwise(0.0),
            "lang_method": F.when(is_blank(F.col("cleaned_text")), "none")
            .when(known.isNotNull(), "given").otherwise("failed"),
        })
    df = scores.attach(df)
    has_model = "model_flag" in df.columns
    df = decide_relevance(
        df, label_score="label_score", settings=settings,
        model_score="model_score" if has_model else None, model_flag="model_flag" if has_model else None,
    )
    gate = F.col("is_relevant")
    df = label_event_types(df, gate=gate, settings=settings)
    return score_urgency(df, gate=gate, settings=settings)


def analyze(
    df: DataFrame,
    scores: ScoreTables | ScoreColumns | Prototypes,
    gazetteer: DataFrame,
    *,
    language: LanguageModel | None = None,
    cleaned: DataFrame | None = None,
    vectors: DataFrame | None = None,
    vector_col: str = "vector",
    embed: Callable[[DataFrame], DataFrame] | None = None,
    skip_dedup: bool = False,
    window: int | None = None,
    threshold: float | None = None,
    settings: C.Settings = C.DEFAULTS,
) -> DataFrame:
    """Full result row of every message; see ``RESULT_COLUMNS``.

    ``df`` has ``message_id, arrival_seq, text``.  Vectors stand for the
    cleaned text: they come from ``vectors`` by ``message_id``, from a
    ``vector_col`` of ``df``, or ``embed`` adds them to the cleaned rows (by
    default from hashed words); hashed words are folded to counts.  ``cleaned``
    is given if ``clean_messages(df)``, maybe with vectors, lies in a table
    already.  The cleaned and classified rows are written
    once; places and duplicates then read only the columns they need, and
    their narrow results are joined to each other before the wide rows move,
    which happens once.
    """
    cleaned = clean_messages(df) if cleaned is None else cleaned
    if vectors is not None:
        cleaned = cleaned.drop(vector_col).join(vectors.select("message_id", vector_col), "message_id", "left")
    elif vector_col not in cleaned.columns and not (skip_dedup and not isinstance(scores, Prototypes)):
        cleaned = embed(cleaned) if embed else with_word_counts(cleaned, "cleaned_text", vector_col)
    if vector_col in cleaned.columns:
        cleaned = cleaned.withColumn(vector_col, folded(cleaned, vector_col))
    base = classify(cleaned, scores, language=language, settings=settings)
    base = materialise(base, "classified")
    relevant = base.where("is_relevant").select("message_id", "cleaned_text")
    located = locations_by_message(geocode(extract_places(relevant, gazetteer), gazetteer))
    checked = deduplicate(
        base, vector_col=vector_col, window=window or settings.duplicate_window,
        threshold=threshold or settings.duplicate_threshold, skip=skip_dedup,
    )
    narrow = checked.join(located, "message_id", "left")
    no_places = F.array().cast(f"array<{schemas.LOCATION.simpleString()}>")
    return (
        base.join(narrow, "message_id", "left")
        .withColumns({
            "locations": F.coalesce("locations", no_places),
            "is_duplicate": F.coalesce("is_duplicate", F.lit(False)),
            "pipeline_version": F.lit(C.VERSION),
        })
        .select(*RESULT_COLUMNS, "similarity", "matched_id")
    )


def batch_totals(results: DataFrame) -> DataFrame:
    """Totals of one batch response."""
    return results.agg(
        F.count("*").alias("total_processed"),
        F.count_if("is_relevant").alias("total_relevant"),
        F.count_if(F.col("urgency_level") == "CRITICAL").alias("total_critical"),
    )


def running_totals(results: DataFrame, *, window: int | None = None) -> DataFrame:
    """Totals since the start; critical counts relevant messages only."""
    window = window or C.DEFAULTS.duplicate_window
    return results.agg(
        F.count("*").alias("total_processed"),
        F.count_if("is_relevant").alias("total_relevant"),
        F.count_if(F.col("is_relevant") & (F.col("urgency_level") == "CRITICAL")).alias("total_critical"),
        F.count_if("is_duplicate").alias("total_duplicates"),
        F.least(F.lit(window), F.count_if(~is_blank(F.col("cleaned_text")))).cast("long").alias("dedup_window_size"),
    )


# What a message gets when no stored result is known for it.
UNKNOWN_SAMPLE = {
    "lang_code": "und", "lang_confidence": 0.8, "is_relevant": True, "relevance_confidence": 0.85,
    "event_types": ["SITUATIONAL_UPDATE"], "urgency_level": "MEDIUM", "urgency_score": 0.6,
    "locations": [],
}


def known_results(df: DataFrame, known: DataFrame, *, key: str = "sample_key") -> DataFrame:
    """Stored results by key, with the default row where none is stored.

    ``known`` has the key and the columns of ``UNKNOWN_SAMPLE``; without
    ``locations`` no place is stored.
    """
    if "locations" not in known.columns:
        known = known.withColumn("locations", F.array().cast(T.ArrayType(schemas.LOCATION)))
    kinds = {f.name: f.dataType for f in known.schema.fields}
    stored = known.withColumn("_stored", F.lit(True))
    joined = df.join(stored, key, "left")

    def value(name: str, default: object):
        fallback = F.array(*[F.lit(v) for v in default]) if isinstance(default, list) else F.lit(default)
        return F.when(F.col("_stored"), F.col(name)).otherwise(fallback.cast(kinds[name])).alias(name)

    return joined.select(
        *df.columns,
        *[value(name, default) for name, default in UNKNOWN_SAMPLE.items()],
        F.lit(False).alias("is_duplicate"),
        F.lit(None).cast("string").alias("cluster_id"),
        F.lit(0.0).alias("processing_time_ms"),
    )
