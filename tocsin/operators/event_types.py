"""Event types of a message from one score per label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin import config as C
from tocsin.functions.text import is_blank

SHORT_LABELS = [short for _, short in C.EVENT_TYPES]


def scores_to_arrays(scores: DataFrame, labels: list[str], name: str) -> DataFrame:
    """Long ``(message_id, label, score)`` rows as one array per message.

    The array follows the order of ``labels``.  Partial aggregation leaves
    one row per message for the shuffle.
    """
    picked = [F.max(F.when(F.col("label") == label, F.col("score"))) for label in labels]
    return scores.groupBy("message_id").agg(F.array(*picked).alias(name))


def ranked(scores: Column, labels: list[str]) -> Column:
    """Structs (label, score) by score descending, then by position."""
    names = F.array(*[F.lit(label) for label in labels])
    keyed = F.transform(scores, lambda s, i: F.struct((-s).alias("order"), i.alias("pos")))
    return F.transform(
        F.array_sort(keyed),
        lambda k: F.struct(F.get(names, k["pos"]).alias("label"), (-k["order"]).alias("score")),
    )


def label_event_types(
    df: DataFrame,
    *,
    text_col: str = "cleaned_text",
    scores_col: str = "type_scores_raw",
    gate: Column | None = None,
    labels: list[str] = SHORT_LABELS,
    settings: C.Settings = C.DEFAULTS,
) -> DataFrame:
    """Add ``event_types``, ``type_scores``, ``top_label`` and ``top_score``.

    Labels at or above the threshold are kept by score; if none is, the best
    one stands alone.  Blank and gated-out rows have no types, rows without
    scores the type UNKNOWN.
    """
    skipped = is_blank(F.col(text_col)) if gate is None else is_blank(F.col(text_col)) | ~gate
    usable = ~skipped & F.col(scores_col).isNotNull()
    staged = df.withColumn("_ranked", F.when(usable, ranked(F.col(scores_col), labels)))
    staged = staged.withColumn(
        "_kept", F.filter("_ranked", lambda e: e["score"] >= settings.type_threshold)
    )
    best = F.get("_ranked", F.lit(0))
    return staged.select(
        *df.columns,
        F.when(skipped, F.expr("cast(array() as array<string>)"))
        .when(~usable, F.array(F.lit("UNKNOWN")))
        .when(F.size("_kept") > 0, F.transform("_kept", lambda e: e["label"]))
        .otherwise(F.array(best["label"]))
        .alias("event_types"),
        F.when(
            usable,
            F.map_from_entries(
                F.transform(
                    "_ranked",
                    lambda e: F.struct(e["label"].alias("key"), F.round(e["score"], 4).alias("value")),
                )
            ),
        )
        .otherwise(F.expr("cast(map() as map<string,double>)"))
        .alias("type_scores"),
        F.when(usable, best["label"]).otherwise("UNKNOWN").alias("top_label"),
        F.when(usable, F.round(best["score"], 4)).otherwise(0.0).alias("top_score"),
    )
