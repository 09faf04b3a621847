"""Connected components of a graph that is stored as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import SALTS, pin, salted_lookup


def _with_least(rows: DataFrame) -> DataFrame:
    """Add ``_m``, the least node that ``_u`` or a neighbour has."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)))
    least = salted.groupBy("_u").agg(F.least(F.col("_u"), F.min("_v")).alias("_m"))
    return salted_lookup(salted, least, ["_u"], "_salt")


def _either(rows: DataFrame, *edges: tuple[str, str]) -> DataFrame:
    """Several edges made of each row."""
    found = [F.struct(F.col(a).alias("_u"), F.col(b).alias("_v")) for a, b in edges]
    return rows.select(F.inline(F.array(*found)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _either(edges, ("_u", "_v"), ("_v", "_u"))
    found = _with_least(both).filter("_v > _u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
    return found.filter("_u <> _v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    found = _with_least(edges.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")))
    return _either(found, ("_v", "_m"), ("_u", "_m")).filter("_u <> _v").distinct()


def _plain(edges: DataFrame) -> DataFrame:
    """The same edges in columns of their own: checkpointing mistakes columns that were swapped."""
    return edges.select((F.col("_u") + F.lit(0)).alias("_u"), (F.col("_v") + F.lit(0)).alias("_v"))


def _unfinished(edges: DataFrame) -> int:
    """How many nodes hang on several nodes, or on one and have others hanging on them."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("_u").alias("_end"), F.lit(1).alias("_hangs")),
        F.struct(F.col("_v").alias("_end"), F.lit(0).alias("_hangs")),
    )))
    found = ends.groupBy("_end").agg(F.sum("_hangs").alias("_times"), F.min("_hangs").alias("_only"))
    return found.filter("_times > 1 or (_times = 1 and _only = 0)").count()


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """The least node that each node reaches: ``node, root``, for all nodes but the roots themselves.

    Large-star and small-star steps alternate until every node hangs on one
    root; each hangs the neighbours of a node on the least of them.  No node's
    neighbours are gathered: only minima are, and rows of a hub stay spread.
    """
    ends = F.greatest(left, right).alias("_u"), F.least(left, right).alias("_v")
    now = pin(_plain(edges.select(*ends).filter("_u <> _v").distinct()))
    while _unfinished(now):
        now = pin(_plain(_small_star(_large_star(now))))
    return now.select(F.col("_u").alias("node"), F.col("_v").alias("root"))
