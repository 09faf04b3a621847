"""Exact duplicates by deterministic block naming.

Every normalised text is cut into blocks of a fixed size.  The distinct
blocks, sorted, get integers as names; neighbouring names are paired and the
distinct pairs, sorted, get names again, until each text has one name.  Equal
texts then have equal names and different texts different ones: nothing rests
on a hash.

Most texts are alone and need no naming of all their blocks: a first round
names only size, head and tail.  A text alone under that name is finished,
as naming can only tell more texts apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import SALTS, ascii_lower, pin, salted_lookup

BLOCK_BYTES = 4096
EDGE_BYTES = 64
FIRST = ["_size", "_head", "_tail"]


def name_sorted(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Give the distinct values of ``keys`` integers in sorted order and add them to the rows.

    ``rows`` must be pinned and carry ``_salt``.
    """
    distinct = rows.select(*keys, "_salt").distinct().select(*keys).distinct()
    ordered = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    names = pin(ordered.select(*keys, F.monotonically_increasing_id().alias(name)))
    return salted_lookup(rows, names, keys, "_salt").drop(*keys)


def _blocks(data: Column, block_bytes: int) -> Column:
    count = F.greatest(F.ceil(F.octet_length(data) / block_bytes), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)),
    )


def _shared_first_names(rows: DataFrame) -> DataFrame:
    """The first names that more than one row has, with each salt they occur with."""
    parts = rows.groupBy(*FIRST, "_salt").agg(F.count(F.lit(1)).alias("_count"))
    shared = parts.groupBy(*FIRST).agg(F.sum("_count").alias("_count")).filter("_count > 1")
    return parts.select(*FIRST, "_salt").join(shared.select(*FIRST), FIRST, "left_semi")


def _root_names(pinned: DataFrame, block_bytes: int) -> DataFrame:
    """One name for each row that carries blocks: ``_rid, _root``."""
    exploded = pinned.select("_rid", "_salt", F.size("_blocks").alias("_width"), F.posexplode("_blocks"))
    level = pin(name_sorted(exploded.withColumnRenamed("col", "_block"), ["_block"], "_name"))
    width = level.agg(F.max("_width")).first()[0] or 0
    done = [level.filter("_width = 1")]
    while width > 1:
        even = F.col("pos") % 2 == 0
        paired = (
            level.filter("_width > 1")
            .groupBy(
                "_rid", "_salt", F.ceil(F.col("_width") / 2).cast("int").alias("_width"),
                F.floor(F.col("pos") / 2).cast("int").alias("pos"),
            )
            .agg(
                F.max(F.when(even, F.col("_name"))).alias("_left"),
                F.coalesce(F.max(F.when(~even, F.col("_name"))), F.lit(-1)).alias("_right"),
            )
        )
        level = pin(name_sorted(pin(paired), ["_left", "_right"], "_name"))
        done.append(level.filter("_width = 1"))
        width = (width + 1) // 2
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionByName(more)
    return roots.select("_rid", F.col("_name").alias("_root"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Mark the row that stays of each set of equal texts.

    Texts are compared after lower-casing A-Z; null counts as empty.  Returns
    one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.
    The largest id stays; of rows that repeat both id and text exactly one
    stays, and a null id is smaller than any other.  An empty table gives an
    empty result, extra columns are not read.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    data = F.col("_data")
    rows = (
        docs.select(F.col(id_col).alias("_id"), text.cast("binary").alias("_data"))
        .withColumns({
            "_size": F.octet_length(data),
            "_head": F.substring(data, 1, EDGE_BYTES),
            "_tail": F.substring(data, F.greatest(F.octet_length(data) - EDGE_BYTES + 1, F.lit(1)), F.lit(EDGE_BYTES)),
            "_salt": F.pmod(F.xxhash64("_id"), F.lit(SALTS)),
        })
    )
    shared = _shared_first_names(rows).withColumn("_shared", F.lit(True))
    pinned = pin(
        rows.join(shared, [*FIRST, "_salt"], "left").select(
            F.monotonically_increasing_id().alias("_rid"), "_id", "_size", "_salt",
            F.sha2(data, 256).alias("text_sha256"),
            F.when(F.col("_shared"), _blocks(data, block_bytes)).alias("_blocks"),
        )
    )
    alone = pinned.filter("_blocks is null").select(
        F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    several = pinned.filter("_blocks is not null")
    named = several.drop("_blocks").join(_root_names(several, block_bytes), "_rid")
    # The size tells names of different levels apart.
    key = ["_size", "_root"]
    top = F.max(F.struct("_id", "_rid"))
    parts = named.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("_count"), top.alias("_top"))
    groups = parts.groupBy(*key).agg(F.sum("_count").alias("group_size"), F.max("_top").alias("_top"))
    marked = salted_lookup(named, groups, key, "_salt").select(
        F.col("_id").alias("doc_id"), F.col("_top._id").alias("keep_id"), "group_size",
        (F.col("_rid") == F.col("_top._rid")).alias("kept"), "text_sha256",
    )
    return alone.unionByName(marked)
