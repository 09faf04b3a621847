"""Place mentions, their merging, and coordinates from a gazetteer table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tocsin import config as C
from tocsin import schemas
from tocsin.functions.text import is_blank, strip
from tocsin.operators.name_scan import find_names
from tocsin.runtime import materialise

EDGE = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
# Parts into which the rows of one name are dealt.
SALTS = 64
ANYWHERE = ""


def bare(text: Column) -> Column:
    """Lower-cased text without punctuation at either end."""
    return F.lower(F.regexp_replace(text, EDGE, ""))


def name_key(name: Column) -> Column:
    """What names and stretches of text are compared by."""
    return bare(strip(name))


def gazetteer_names(gazetteer: DataFrame) -> DataFrame:
    """One row per name: the kind and score of its most important entry."""
    importance = F.coalesce("importance", F.lit(0.5))
    return (
        gazetteer.groupBy(name_key(F.col("name")).alias("key"))
        .agg(
            F.min_by("kind", F.struct(-importance, "display_name")).alias("kind"),
            F.max(importance).alias("score"),
        )
        .where(F.col("key") != "")
    )


def match_places(df: DataFrame, gazetteer: DataFrame, *, text_col: str = "cleaned_text") -> DataFrame:
    """Gazetteer names found in the text, as tagged mentions.

    Returns ``message_id, text, kind, score, start, end``.  At each place the
    longest name wins, and a name inside an earlier, longer one is dropped.
    Names and text are compared without outer punctuation, as ``name_key``
    makes them; text in a script without blanks is searched at every letter.
    The names are read when the plan is made and passed over each text by
    automata, so neither words nor texts are shuffled.
    """
    return find_names(df.where(~is_blank(F.col(text_col))), gazetteer_names(gazetteer), text_col=text_col)


def is_facility(text: Column) -> Column:
    return F.lower(text).rlike("|".join(C.FACILITY_KEYWORDS))


def keep_places(mentions: DataFrame) -> DataFrame:
    """Keep LOC mentions, and ORG mentions that name a facility."""
    text = strip(F.col("text"))
    label = F.when(F.col("kind").contains("LOC"), "LOC").when(
        F.col("kind").contains("ORG") & is_facility(text), "FACILITY"
    )
    return mentions.select(
        "message_id", text.alias("text"), label.alias("label"),
        F.round("score", 4).alias("confidence"), "start", "end",
    ).where(F.col("label").isNotNull())


def merge_adjacent(mentions: DataFrame, *, gap: int = 2) -> DataFrame:
    """Join mentions of one label that touch or lie up to ``gap`` apart.

    Window and aggregate share one partitioning by message.
    """
    in_text = Window.partitionBy("message_id").orderBy("start", "end")
    apart = (
        F.lag("label").over(in_text).isNull()
        | (F.col("label") != F.lag("label").over(in_text))
        | (F.col("start") - F.lag("end").over(in_text) > gap)
    )
    return (
        mentions.withColumn("_new", apart.cast("int"))
        .withColumn("_island", F.sum("_new").over(in_text))
        .groupBy("message_id", "_island", "label")
        .agg(
            F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("_parts"),
            F.min("confidence").alias("confidence"),
        )
        .select(
            "message_id",
            strip(F.array_join(F.transform("_parts", lambda p: p["text"]), " ")).alias("text"),
            "label",
            "confidence",
            F.get("_parts", F.lit(0))["start"].alias("start"),
            F.element_at("_parts", -1)["end"].alias("end"),
        )
    )


def extract_places(df: DataFrame, gazetteer: DataFrame, *, text_col: str = "cleaned_text") -> DataFrame:
    """Merged place mentions of each message, one row per mention."""
    return merge_adjacent(keep_places(match_places(df, gazetteer, text_col=text_col)))


def geocode_confidence(importance: Column, bbox: Column) -> Column:
    south, north, west, east = (F.get(bbox, F.lit(i)) for i in range(4))
    area = F.abs(north - south) * F.abs(east - west)
    specificity = F.when(F.size(bbox) == 4, F.greatest(F.lit(0.0), 1.0 - area / 100.0)).otherwise(0.5)
    score = F.coalesce(importance, F.lit(0.5)) * 0.6 + F.coalesce(specificity, F.lit(0.5)) * 0.4
    return F.round(F.least(F.lit(1.0), score), 4)


def best_entries(gazetteer: DataFrame, *, by_country: bool = False) -> DataFrame:
    """One located entry per name (and country): the most important one."""
    keys = [name_key(F.col("name")).alias("key")]
    if by_country:
        keys.append(F.upper("country").alias("hint"))
    entry = F.struct(
        F.round("lat", 6).alias("latitude"),
        F.round("lng", 6).alias("longitude"),
        F.col("display_name"),
        F.upper("country").alias("country"),
        geocode_confidence(F.col("importance"), F.col("bbox")).alias("geo_confidence"),
    )
    order = F.struct(-F.coalesce("importance", F.lit(0.5)), "display_name")
    return gazetteer.groupBy(*keys).agg(F.min_by(entry, order).alias("place"))


def lookup_requests(mentions: DataFrame, *, name_col: str = "text", country_col: str | None = None) -> DataFrame:
    """Distinct names to look up; equal requests are asked once."""
    columns = [strip(F.col(name_col)).alias("query")]
    if country_col:
        columns.append(F.upper(country_col).alias("hint"))
    asked = mentions.where(~is_blank(F.col(name_col))).select(*columns)
    return asked.groupBy(*asked.columns).agg(F.count("*").alias("asked"))


def look_up(requests: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The place of each distinct ``_key, _hint``, null if unknown.

    A hint is a country after ``=``; ``ANYWHERE`` asks in all countries.
    """
    anywhere = best_entries(gazetteer).select(F.col("key").alias("_key"), F.col("place").alias("_any"))
    local = best_entries(gazetteer, by_country=True).select(
        F.col("key").alias("_key"), F.concat(F.lit("="), "hint").alias("_hint"), F.col("place").alias("_local")
    )
    place = F.when(F.col("_hint") == ANYWHERE, F.col("_any")).otherwise(F.col("_local"))
    return (
        requests.join(anywhere, "_key", "left").join(local, ["_key", "_hint"], "left")
        .select("_key", "_hint", place.alias("_place"))
    )


class LookupTable:
    """Answers kept between runs, misses included.

    New requests are found by an anti-join and looked up once; each run that
    has some adds one folder.  Remove the folder to ask anew, for instance
    for a new version of the gazetteer.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def known(self) -> DataFrame | None:
        """All answers so far, none before the first run."""
        try:
            return self.spark.read.schema(schemas.LOOKUP).parquet(f"{self.folder}/answers")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def answer(self, requests: DataFrame, gazetteer: DataFrame) -> DataFrame:
        known = self.known()
        new = requests if known is None else requests.join(known.select("_key", "_hint"), ["_key", "_hint"], "left_anti")
        found = materialise(look_up(new, gazetteer).select(*[F.col(f.name).cast(f.dataType) for f in schemas.LOOKUP.fields]), "answers")
        if not found.isEmpty():
            found.write.mode("append").parquet(f"{self.folder}/answers")
        if known is None:
            return found
        return found.unionByName(known.join(requests, ["_key", "_hint"], "left_semi"))


def geocode(
    mentions: DataFrame,
    gazetteer: DataFrame,
    *,
    name_col: str = "text",
    country_col: str | None = None,
    lookups: LookupTable | None = None,
) -> DataFrame:
    """Add coordinates, display name, country and confidence; null if unknown.

    Equal requests are asked once, and never again with ``lookups``.  The
    distinct pairs of request and salt meet the answers first, so a name that
    most mentions have is spread over many tasks.  A null country asks in all
    countries.
    """
    hint = F.concat(F.lit("="), F.upper(country_col)) if country_col else F.lit(None).cast("string")
    # Requests and mentions are read from it: written once, or the texts would be searched twice.
    asked = materialise(mentions.withColumns({
        "_key": F.when(~is_blank(F.col(name_col)), name_key(F.col(name_col))).otherwise(""),
        "_hint": F.coalesce(hint, F.lit(ANYWHERE)),
        "_salt": F.pmod(F.xxhash64("message_id"), F.lit(SALTS)),
    }), "mentions")
    salted = asked.where("_key <> ''").select("_key", "_hint", "_salt").distinct()
    requests = salted.select("_key", "_hint").distinct()
    answers = look_up(requests, gazetteer) if lookups is None else lookups.answer(requests, gazetteer)
    out = asked.join(salted.join(answers, ["_key", "_hint"]), ["_key", "_hint", "_salt"], "left")
    return out.select(
        *mentions.columns,
        "_place.latitude", "_place.longitude", "_place.display_name", "_place.country", "_place.geo_confidence",
    )


def locations_by_message(located: DataFrame) -> DataFrame:
    """Located mentions of each message as one list in text order.

    The list is bounded by the length of its message.
    """
    fields = [f.name for f in schemas.LOCATION.fields]
    return located.groupBy("message_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("start", "end", *fields))),
            lambda m: F.struct(*[m[f].alias(f) for f in fields]),
        ).alias("locations")
    )


__all__ = [
    "LookupTable", "best_entries", "extract_places", "gazetteer_names", "geocode", "geocode_confidence",
    "keep_places", "locations_by_message", "look_up", "lookup_requests", "match_places", "merge_adjacent",
]
