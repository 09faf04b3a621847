"""Analytical views on a results table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin import config as C
from tocsin.functions.numbers import fixed, ratio
from tocsin.functions.text import clip
from tocsin.operators.ordering import with_row_index

DASH = "—"
URGENCY_RANK = {level: rank for rank, (level, _) in enumerate(C.URGENCY_LEVELS)}


def choose(value: Column, options: dict, default) -> Column:
    start = F.when(F.lit(False), F.lit(default))
    return reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), options.items(), start).otherwise(
        F.lit(default)
    )


def urgency_rank(level: Column) -> Column:
    return choose(level, URGENCY_RANK, len(URGENCY_RANK))


def joined_types(empty: str) -> Column:
    return F.when(F.size("event_types") > 0, F.array_join("event_types", ", ")).otherwise(empty)


def place_names(empty: str = "") -> Column:
    names = F.array_join(F.transform("locations", lambda p: p["text"]), ", ")
    return F.when(F.size("locations") > 0, names).otherwise(empty)


def place_text(place: Column) -> Column:
    spot = F.concat(
        F.lit(" ("), fixed(place["latitude"], 2), F.lit(", "), fixed(place["longitude"], 2), F.lit(")")
    )
    return F.concat(place["text"], F.when(place["latitude"].isNotNull(), spot).otherwise(""))


def session_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total"),
        F.count_if("is_relevant").alias("relevant"),
        F.count_if(F.col("is_relevant") & (F.col("urgency_level") == "CRITICAL")).alias("critical"),
        F.count_if("is_duplicate").alias("duplicates"),
    )


def headline_metrics(results: DataFrame) -> DataFrame:
    counts = results.agg(
        F.count("*").alias("total"),
        F.count_if("is_relevant").alias("relevant"),
        F.count_if(F.col("urgency_level") == "CRITICAL").alias("critical"),
        F.count_if("is_duplicate").alias("duplicates"),
    )
    share = ratio(F.col("relevant"), F.col("total")) * 100
    return counts.withColumn("relevant_share", F.format_string("%.0f%%", share))


def priority_feed(results: DataFrame) -> DataFrame:
    """Relevant messages by urgency, then arrival, with their place in line.

    The numbering is distributed: a sort of the whole feed in one task is not
    needed, and callers sort by ``position`` only when they print.
    """
    shown = results.where("is_relevant").select(
        "message_id",
        "arrival_seq",
        "urgency_level",
        joined_types(DASH).alias("types"),
        F.col("lang_code").alias("lang"),
        clip(F.col("cleaned_text"), 200).alias("text"),
        F.array_join(F.transform("locations", place_text), ", ").alias("places"),
        urgency_rank(F.col("urgency_level")).alias("_rank"),
    )
    # Texts are clipped before rows move.
    numbered = with_row_index(shown, "arrival_seq", "position", lead_col="_rank", tie_cols=("message_id",))
    return numbered.select((F.col("position") + 1).alias("position"), *shown.columns[:-1])


def feed_heading() -> Column:
    return F.concat(
        F.lit("#"), F.col("position").cast("string"), F.lit(f" {DASH} "), F.col("urgency_level"),
        F.lit(" | "), F.col("types"), F.lit(" | "), F.col("lang"),
    )


def feed_export(results: DataFrame) -> DataFrame:
    """Rows of the feed file, in feed order (a range-partitioned sort of clipped texts)."""
    shown = results.where("is_relevant").select(
        F.col("urgency_level").alias("urgency"),
        joined_types("").alias("types"),
        F.col("lang_code").alias("lang"),
        F.substring("cleaned_text", 1, 200).alias("text"),
        place_names().alias("locations"),
        urgency_rank(F.col("urgency_level")).alias("_rank"),
        "arrival_seq",
        "message_id",
    )
    return shown.orderBy("_rank", "arrival_seq", "message_id").drop("_rank", "arrival_seq", "message_id")


def located_mentions(results: DataFrame) -> DataFrame:
    """One row per mention with coordinates of relevant messages."""
    return (
        results.where("is_relevant")
        .select("*", F.posexplode("locations").alias("pos", "place"))
        .where(F.col("place.latitude").isNotNull())
    )


def map_layer(results: DataFrame) -> DataFrame:
    level, first_type = F.upper("urgency_level"), F.get("event_types", F.lit(0))
    return located_mentions(results).select(
        "message_id",
        "pos",
        F.col("place.latitude").alias("latitude"),
        F.col("place.longitude").alias("longitude"),
        choose(level, C.MARKER_COLOURS, C.DEFAULT_COLOUR).alias("colour"),
        choose(first_type, C.MARKER_ICONS, C.DEFAULT_ICON).alias("icon"),
        F.concat("urgency_level", F.lit(": "), F.col("place.text")).alias("tooltip"),
        F.concat("urgency_level", F.lit(f" {DASH} "), F.array_join("event_types", ", ")).alias("heading"),
        F.when(F.col("urgency_level") == "CRITICAL", C.HEADING_COLOURS["CRITICAL"])
        .otherwise(C.HEADING_COLOURS["OTHER"]).alias("heading_colour"),
        F.substring("cleaned_text", 1, 200).alias("popup_text"),
        F.coalesce(F.nullif(F.col("place.display_name"), F.lit("")), F.col("place.text")).alias("popup_place"),
        F.col("lang_code").alias("popup_language"),
    )


def map_centre(results: DataFrame) -> DataFrame:
    """Coordinates of the first located mention, else the default centre."""
    spot = F.struct(F.col("place.latitude").alias("lat"), F.col("place.longitude").alias("lng"))
    first = located_mentions(results).agg(
        F.min_by(spot, F.struct("arrival_seq", "message_id", "pos")).alias("spot")
    )
    lat, lng = C.DEFAULT_CENTRE
    return first.select(
        F.coalesce("spot.lat", F.lit(lat)).alias("latitude"), F.coalesce("spot.lng", F.lit(lng)).alias("longitude")
    )


def urgency_distribution(results: DataFrame) -> DataFrame:
    return results.where("is_relevant").groupBy("urgency_level").agg(F.count("*").alias("messages"))


def type_distribution(results: DataFrame) -> DataFrame:
    return (
        results.where("is_relevant").select(F.explode("event_types").alias("event_type"))
        .groupBy("event_type").agg(F.count("*").alias("messages"))
    )


def language_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("lang_code").agg(F.count("*").alias("messages"))


def confidence_histogram(results: DataFrame, *, bins: int = 20, settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """Counts in equal bins over 0..1, the last one closed."""
    number = F.least(F.floor(F.col("relevance_confidence") * bins), F.lit(bins - 1))
    return (
        results.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("messages"))
        .select(
            "bin",
            (F.col("bin") / F.lit(float(bins))).alias("low"),
            ((F.col("bin") + 1) / F.lit(float(bins))).alias("high"),
            "messages",
            F.lit(settings.relevance_threshold).alias("threshold"),
        )
    )


def positive_histogram(df: DataFrame, value_col: str = "processing_time_ms", *, bins: int = 15) -> DataFrame:
    """Counts in equal bins between the least and greatest positive value."""
    positive = df.where(F.col(value_col) > 0).select(F.col(value_col).cast("double").alias("v"))
    limits = positive.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    low, high = limits["lo"] or 0.0, limits["hi"] or 0.0
    width = (high - low) / bins
    number = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)) if width else F.lit(0)
    return (
        positive.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("messages"))
        .select(
            "bin",
            (F.lit(low) + F.lit(width) * F.col("bin")).alias("low"),
            (F.lit(low) + F.lit(width) * (F.col("bin") + 1)).alias("high"),
            "messages",
        )
    )


def type_by_urgency(results: DataFrame) -> DataFrame:
    kinds = F.when(F.size("event_types") > 0, F.col("event_types")).otherwise(F.array(F.lit(DASH)))
    return (
        results.where("is_relevant").select(F.explode(kinds).alias("event_type"), "urgency_level")
        .groupBy("event_type", "urgency_level").agg(F.count("*").alias("messages"))
    )


def type_by_urgency_wide(results: DataFrame) -> DataFrame:
    """The cross-tab with one column per level."""
    levels = [level for level, _ in C.URGENCY_LEVELS]
    return (
        type_by_urgency(results).groupBy("event_type").pivot("urgency_level", levels)
        .agg(F.sum("messages")).na.fill(0)
    )


def rate_by_language(results: DataFrame) -> DataFrame:
    """Share of relevant messages by language, largest language first."""
    return (
        results.groupBy("lang_code")
        .agg(F.count("*").alias("messages"), F.count_if("is_relevant").alias("relevant"))
        .select("lang_code", ratio(F.col("relevant"), F.col("messages")).alias("relevance_rate"), "messages")
        .orderBy(F.desc("messages"), "lang_code")
    )


def results_table(results: DataFrame, *, time_col: str | None = None) -> DataFrame:
    time = F.coalesce(F.col(time_col), F.lit(0.0)) if time_col else F.lit(0.0)
    return results.select(
        "message_id",
        "arrival_seq",
        F.when(F.col("is_relevant"), "✅").otherwise("❌").alias("relevant"),
        F.when(F.col("is_relevant"), F.col("urgency_level")).otherwise("-").alias("urgency"),
        joined_types("-").alias("types"),
        F.col("lang_code").alias("language"),
        place_names("-").alias("locations"),
        F.when(F.col("is_duplicate"), "🔁").otherwise("").alias("duplicate"),
        clip(F.col("cleaned_text"), 80).alias("text"),
        fixed(time, 0).alias("time_ms"),
    )


def class_distribution(df: DataFrame, label_col: str = "type") -> DataFrame:
    """Rows by label, most frequent first."""
    return (
        df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "label")
    )


def nested_columns(results: DataFrame, *, with_version: bool = True) -> list:
    """Columns of the nested result, as the service returns it."""
    time = F.col("processing_time_ms") if "processing_time_ms" in results.columns else F.lit(0.0)
    columns = [
        "original_text",
        "cleaned_text",
        F.struct(
            F.col("lang_code").alias("code"), F.col("lang_confidence").alias("confidence"),
            F.col("lang_method").alias("method"),
        ).alias("language"),
        "is_relevant",
        "relevance_confidence",
        "event_types",
        "type_scores",
        F.struct(F.col("urgency_level").alias("level"), F.col("urgency_score").alias("score")).alias("urgency"),
        "locations",
        F.struct("is_duplicate", "cluster_id").alias("deduplication"),
        time.alias("processing_time_ms"),
    ]
    return [*columns, "pipeline_version"] if with_version else columns


def nested_results(results: DataFrame, *, with_version: bool = True) -> DataFrame:
    return results.select(*nested_columns(results, with_version=with_version))


def response_rows(results: DataFrame) -> DataFrame:
    """What a caller of the service gets: the nested result without version."""
    return nested_results(results, with_version=False)


def results_json(results: DataFrame, *, with_version: bool = True) -> DataFrame:
    """Message id and the nested result as JSON text, nulls kept."""
    nested = F.struct(*nested_columns(results, with_version=with_version))
    return results.select("message_id", F.to_json(nested, {"ignoreNullFields": "false"}).alias("result"))
