"""Running totals and row numbers over a whole table, without one big sort.

A window without partitions would pull the table into one task.  Here rows
are put into slots by value ranges, totals run inside each slot, and the sums
of the slots before are added.  Only one row per slot meets in a single task.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SLOTS = 2_048
#: Rows of a slot, about, once there are more than two slots a core.
SLOT_ROWS = 50_000


def with_slots(df: DataFrame, order_col: str, slots: int | None = None) -> DataFrame:
    """Add ``slot``: ranges of ``order_col`` with about equal row counts.

    The bounds are literals, so every reader of the result agrees on them.
    """
    spark = df.sparkSession
    value = F.col(order_col).cast("double")
    most = slots or MAX_SLOTS
    shares = [i / most for i in range(1, most)]
    if not shares:
        return df.withColumn("slot", F.lit(0))
    cuts, rows = df.agg(F.percentile_approx(value, shares, 10 * MAX_SLOTS), F.count(F.lit(1))).first()
    if not cuts:
        return df.withColumn("slot", F.lit(0))
    if not slots:
        # The number of slots grows with the rows, so that none does.
        wanted = min(most, max(2 * spark.sparkContext.defaultParallelism, -(-rows // SLOT_ROWS)))
        cuts = [cuts[i * most // wanted - 1] for i in range(1, wanted)]
    bounds = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucketizer = Bucketizer(splits=bounds, inputCol="_order", outputCol="_slot", handleInvalid="keep")
    placed = bucketizer.transform(df.withColumn("_order", value))
    return placed.withColumn("slot", F.col("_slot").cast("int")).drop("_order", "_slot")


def with_running_totals(
    df: DataFrame,
    order_col: str,
    totals: dict[str, Column],
    *,
    descending: bool = False,
    slots: int | None = None,
    by: tuple[str, ...] = (),
    lead_col: str | None = None,
    tie_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Add running sums, own row included, in the order of one numeric column.

    ``by`` starts new sums for each group; a group is cut into slots too, so
    one that holds most rows is shared by many tasks.  ``lead_col``, a small
    integer, may go before the order column.  Rows with equal order values
    stay in one slot: aggregate them first if there may be many.
    """
    keys = [*by, "_lead", "slot"]
    placed = with_slots(df, order_col, slots).withColumn("_lead", F.col(lead_col) if lead_col else F.lit(0))
    for name, value in totals.items():
        placed = placed.withColumn(f"_v_{name}", value)
    sums = placed.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    slot_order = ["_lead", F.col("slot").desc() if descending else F.col("slot").asc()]
    earlier = Window.partitionBy(*by).orderBy(*slot_order).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        *keys, *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in totals]
    )
    row_order = [F.col(order_col).desc() if descending else F.col(order_col).asc(), *tie_cols]
    inside = Window.partitionBy(*keys).orderBy(*row_order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(*df.columns, *keys, *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in totals])
    return local.join(before, keys).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in totals]
    )


def with_row_index(
    df: DataFrame,
    order_col: str,
    name: str = "row_index",
    *,
    by: tuple[str, ...] = (),
    lead_col: str | None = None,
    tie_cols: tuple[str, ...] = (),
    slots: int | None = None,
) -> DataFrame:
    """Number rows from 0 without gaps in the order of ``order_col``."""
    numbered = with_running_totals(
        df, order_col, {name: F.lit(1)}, slots=slots, by=by, lead_col=lead_col, tie_cols=tie_cols
    )
    return numbered.withColumn(name, F.col(name) - 1)


def with_totals_before(
    df: DataFrame, key_col: str, value_col: str, name: str, *, by: tuple[str, ...] = (), fanout: int = 4096
) -> DataFrame:
    """Add the sum of ``value_col`` over all smaller values of a dense key.

    For tables with one row per key, such as blocks.  Keys are summed in
    groups of ``fanout`` neighbours, then the groups are, so neither level
    meets more than a small part of the table in one task.
    """
    parts = [*by, "_part"]
    placed = df.withColumn("_part", F.floor(F.col(key_col) / fanout))
    sums = placed.groupBy(*parts).agg(F.sum(value_col).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*parts, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*parts).orderBy(key_col).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(value_col).over(inside), F.lit(0)))
    return local.join(offsets, parts).select(*df.columns, (F.col("_local") + F.col("_offset")).alias(name))
