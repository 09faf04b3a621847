"""Shards that all match the mixture of sources.

Rows of each source are put into a seeded order and ranked.  A row's
fractional rank, (rank + 1/2) / rows of the source, says how far into its
source it stands; sorted by that, every stretch of rows holds each source in
proportion.  The sorted rows are cut into shards of equal row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import pin, rank_in_groups, salted_lookup

#: Rows that one task ranks, on average.
RANGE_ROWS = 50_000


def interleaved_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Place every row: ``doc_id, size, text_crc32, source, shard, slot``.

    Row counts of shards differ by one at most, and so do, but for rounding,
    each source's counts.  ``slot`` is the place in the shard, from 0.  A
    null source is a source of its own; a null text has size 1 and the CRC of
    no bytes.  The seeded order depends on id and text, so repeated rows are
    interchangeable.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.xxhash64(F.lit(seed), F.col(id_col), text)
    rows = pin(
        docs.select(
            F.col(id_col).alias("_id"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_source"),
            (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            order.alias("_order"),
        )
    )
    total = rows.count()
    ranges = max(1, -(-total // range_rows))
    # The order is a hash, so equal ranges of it hold about equal numbers of rows.
    by_hash = F.floor((F.col("_order").cast("double") / 2.0**64 + 0.5) * ranges).cast("long")
    sources = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_of"))
    ranked = rank_in_groups(
        rows.withColumn("_range", by_hash), ["_source"], "_range", ["_order", "_id", "text_crc32"], "_rank"
    )
    placed = salted_lookup(ranked, sources, ["_source"], "_range").withColumn(
        "_share", (2 * F.col("_rank") + 1).cast("double") / (2 * F.col("_of")).cast("double")
    )
    # Shares of all sources are spread evenly over 0 to 1.
    cut = placed.select(
        "_id", "size", "text_crc32", "_source", "_share",
        F.least(F.floor(F.col("_share") * ranges), F.lit(ranges - 1)).cast("long").alias("_range"),
        F.lit(0).alias("_all"),
    )
    # A range's counts meet in one task: one row for every range_rows rows of the table.
    sorted_rows = rank_in_groups(cut, ["_all"], "_range", ["_share", "_source"], "_place")
    shard = F.expr(f"(_place * {shards}) div {max(1, total)}")
    first = F.expr(f"((_place * {shards}) div {max(1, total)} * {total} + {shards - 1}) div {shards}")
    return sorted_rows.select(
        F.col("_id").alias("doc_id"), "size", "text_crc32",
        F.when(F.col("_source") != "", F.expr("substring(_source, 2)")).alias("source"),
        shard.cast("int").alias("shard"), (F.col("_place") - first).alias("slot"),
    )
