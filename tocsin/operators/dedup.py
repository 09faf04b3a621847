"""Near-duplicate messages within a sliding window of recent messages.

Every non-blank message enters the window whether or not it is a duplicate,
so the best match of a message depends on vectors alone.  That makes the job
parallel:

1. messages are numbered in arrival order (``ordering``);
2. they are cut into blocks of consecutive numbers, each with the last
   ``window`` messages of the block before; a block finds the best match of
   each of its messages and follows matches as far as they stay in the block;
3. chains that leave a block end on one of the last ``window`` messages of
   the block before.  Only those border rows are joined with themselves, each
   round doubling the distance, until all have reached the first message of
   their chain;
4. clusters are numbered by the arrival order of their first messages.

With ``by`` each key has a window and cluster numbers of its own.  A key's
messages are numbered and cut into blocks like any others, so a key that
holds a third of all messages is shared by as many tasks as it has blocks.

No group is larger than a block however many copies a message has, and no
pair of messages is ever written out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin import config as C
from tocsin.functions.text import is_blank
from tocsin.functions.vectors import folded, to_matrix
from tocsin.operators.ordering import with_row_index, with_totals_before
from tocsin.runtime import materialise

# Rows of a block at most.  The size of blocks changes the work, not the result.
MAX_BLOCK = 8_192
# Parts into which the border rows of chains with one beginning are dealt.
SALTS = 64

BLOCK_SCHEMA = (
    "_key string, message_id long, row_index long, block long, matched_id long, similarity double, "
    "head_index long, head_rank long, head_cluster long"
)


def best_matches(vectors: np.ndarray, first: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Best earlier row within ``window`` for each row from ``first`` on.

    Similarities are rounded before they are compared, so that equal vectors
    tie whatever the order of summation; the oldest row wins a tie.  A row
    with nothing before it gets position -1 and similarity 0.
    """
    count = len(vectors)
    best = np.full(count, -1, dtype=np.int64)
    score = np.zeros(count)
    for start in range(first, count, window):
        stop = min(start + window, count)
        low = max(0, start - window)
        sims = np.round(vectors[start:stop] @ vectors[low:stop].T, 10)
        ahead = np.arange(start, stop)[:, None] - np.arange(low, stop)[None, :]
        sims[(ahead < 1) | (ahead > window)] = -np.inf
        top = sims.argmax(axis=1)
        value = sims[np.arange(stop - start), top]
        found = np.isfinite(value)
        best[start:stop][found] = top[found] + low
        score[start:stop][found] = value[found]
    return best, score


def _resolve_block(window: int, threshold: float, block_rows: int):
    """Function from one block, with the rows it borrows, to its results."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_index")
        index, named = table["row_index"].to_numpy(), table["message_id"].to_numpy()
        carried = table["carried_cluster"].to_pandas().to_numpy(dtype=np.float64)
        block = int(table["block"][0].as_py())
        first = int(np.searchsorted(index, block * block_rows))
        best, score = best_matches(to_matrix(table["vector"]), first, window)

        position = np.arange(len(index))
        seeded = ~np.isnan(carried)
        duplicate = (best >= 0) & (score >= threshold) & ~seeded
        head = np.where(duplicate, best, position)
        while True:
            further = head[head]
            if np.array_equal(further, head):
                break
            head = further
        opens = ~duplicate & ~seeded & (position >= first)
        rank = np.cumsum(opens) - 1

        own = slice(first, None)
        inside = head[own] >= first
        plain = inside & ~seeded[head[own]]
        number = inside & seeded[head[own]]
        return pa.table({
            "_key": table["_key"].slice(first).combine_chunks(),
            "message_id": table["message_id"].slice(first).combine_chunks(),
            "row_index": index[own],
            "block": np.full(len(index) - first, block, dtype=np.int64),
            "matched_id": pa.array(named[np.where(duplicate, best, 0)][own], mask=~duplicate[own]),
            "similarity": np.where(seeded, 0.0, score)[own],
            "head_index": index[head[own]],
            "head_rank": pa.array(rank[head[own]], mask=~plain),
            "head_cluster": pa.array(
                np.where(number, np.nan_to_num(carried[head[own]]), 0).astype(np.int64), mask=~number
            ),
        })

    return run


def resolve_chains(local: DataFrame, *, block_rows: int, window: int) -> DataFrame:
    """Follow chains across blocks.  Returns the border rows with the block,
    rank and carried cluster of the first message of their chain.

    A border row is pointed at from one block only, so no join key is hot.
    """
    border = local.where(F.col("row_index") % block_rows >= block_rows - window).select(
        "_key",
        "row_index",
        F.when(F.col("head_index") < F.col("block") * block_rows, F.col("head_index")).alias("next_index"),
        F.col("block").alias("head_block"),
        "head_rank",
        "head_cluster",
    )
    border = materialise(border, "border")
    while not border.where(F.col("next_index").isNotNull()).isEmpty():
        ahead = border.select(
            "_key",
            F.col("row_index").alias("_at"),
            F.struct("next_index", "head_block", "head_rank", "head_cluster").alias("_ahead"),
        )
        moved = (
            border.where(F.col("next_index").isNotNull())
            .select("_key", "row_index", F.col("next_index").alias("_at"))
            .join(ahead, ["_key", "_at"])
            .select("_key", "row_index", "_ahead.*")
        )
        border = materialise(border.where(F.col("next_index").isNull()).unionByName(moved), "border")
    return border.drop("next_index")


def number_clusters(
    local: DataFrame, border: DataFrame, *, block_rows: int, opened_before: DataFrame | None = None
) -> DataFrame:
    """Add ``cluster_number`` to every row of ``local``.

    Rows meet their own block, or the border row their chain leaves by, and
    only border rows meet the block where a chain begins.  A message with
    many copies begins most chains, so those are spread by salt.
    """
    opened = local.where((F.col("head_index") == F.col("row_index")) & F.col("head_cluster").isNull())
    per_block = opened.groupBy("_key", "block").agg(F.count("*").alias("opened"))
    offsets = with_totals_before(per_block, "block", "opened", "before", by=("_key",))
    start = F.lit(0)
    if opened_before is not None:
        offsets, start = offsets.join(opened_before, "_key", "left"), F.coalesce("clusters", F.lit(0))
    offsets = offsets.select("_key", F.col("block").alias("head_block"), (F.col("before") + start).alias("offset"))
    leaves = F.col("head_index") < F.col("block") * block_rows
    number = F.coalesce("head_cluster", F.col("offset") + F.col("head_rank")).alias("cluster_number")
    columns = ["_key", "message_id", "row_index", "matched_id", "similarity"]
    inner = (
        local.where(~leaves)
        .join(offsets.withColumnRenamed("head_block", "block"), ["_key", "block"], "left")
        .select(*columns, number)
    )
    salted = border.withColumn("_salt", F.pmod("row_index", F.lit(SALTS)))
    begins = salted.select("_key", "head_block", "_salt").distinct().join(offsets, ["_key", "head_block"], "left")
    numbers = salted.join(begins, ["_key", "head_block", "_salt"]).select(
        "_key", F.col("row_index").alias("head_index"), number
    )
    outer = local.where(leaves).join(numbers, ["_key", "head_index"]).select(*columns, "cluster_number")
    return inner.unionByName(outer)


def assign_clusters(
    numbered: DataFrame,
    *,
    window: int,
    threshold: float,
    opened_before: DataFrame | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Best match and cluster of every row of a gap-free numbered table.

    ``numbered`` has ``_key, message_id, row_index, vector`` and
    ``carried_cluster``, the known cluster of rows from an earlier run;
    ``opened_before`` has the clusters opened so far by ``_key``.
    """
    if block_rows is None:
        rows = numbered.count()
        tasks = 2 * numbered.sparkSession.sparkContext.defaultParallelism
        block_rows = max(4 * window, min(MAX_BLOCK, -(-rows // tasks)))
    block = F.floor(F.col("row_index") / block_rows)
    lends = F.col("row_index") % block_rows >= block_rows - window
    shared = numbered.select(
        "_key", "message_id", "row_index", "vector", "carried_cluster",
        F.explode(F.when(lends, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"),
    )
    local = shared.groupBy("_key", "block").applyInArrow(
        _resolve_block(window, threshold, block_rows), BLOCK_SCHEMA
    )
    local = materialise(local, "blocks")
    border = resolve_chains(local, block_rows=block_rows, window=window)
    return number_clusters(local, border, block_rows=block_rows, opened_before=opened_before)


def name_matches(clusters: DataFrame) -> DataFrame:
    """Replace cluster numbers by names."""
    return clusters.select(
        "_key",
        "message_id",
        F.col("matched_id").isNotNull().alias("is_duplicate"),
        cluster_name(F.col("cluster_number")).alias("cluster_id"),
        F.round("similarity", 4).alias("similarity"),
        "matched_id",
    )


def no_match(*keep: str) -> list:
    """Result columns of a message that is not checked."""
    return [
        *keep,
        F.lit(False).alias("is_duplicate"),
        F.lit(None).cast("string").alias("cluster_id"),
        F.lit(0.0).alias("similarity"),
        F.lit(None).cast("long").alias("matched_id"),
    ]


def entering_rows(
    df: DataFrame, *, text_col: str | None, vector_col: str, seq_col: str, by: str | None
) -> DataFrame:
    """The few columns the check needs, with vectors of fixed length, written once."""
    blank = is_blank(F.col(text_col)) if text_col else F.lit(False)
    key = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    return materialise(
        df.select(
            key.alias("_key"), "message_id", F.col(seq_col).alias("_seq"),
            F.when(~blank, folded(df, vector_col)).alias("vector"), blank.alias("_blank"),
        ),
        "entering",
    )


def cluster_name(number: Column) -> Column:
    return F.format_string("cluster_%06d", number)


def with_matched_text(results: DataFrame, texts: DataFrame, *, text_col: str = "cleaned_text") -> DataFrame:
    """Add the text each duplicate was matched with.

    Only duplicates take part in the join, and a message is matched by at
    most ``window`` others, so it has no hot key.
    """
    matched = texts.select(F.col("message_id").alias("matched_id"), F.col(text_col).alias("matched_text"))
    found = results.where(F.col("matched_id").isNotNull()).join(matched, "matched_id", "left")
    rest = results.where(F.col("matched_id").isNull()).withColumn("matched_text", F.lit(None).cast("string"))
    return found.select(*results.columns, "matched_text").unionByName(rest)


def deduplicate(
    df: DataFrame,
    *,
    text_col: str | None = "cleaned_text",
    vector_col: str = "vector",
    seq_col: str = "arrival_seq",
    by: str | None = None,
    window: int | None = None,
    threshold: float | None = None,
    block_rows: int | None = None,
    skip: bool = False,
) -> DataFrame:
    """Duplicate check of every message against the ``window`` before it.

    Returns ``message_id, is_duplicate, cluster_id, similarity, matched_id``,
    after the ``by`` column if there is one.  Blank messages are not
    duplicates, have no cluster and do not enter the window.  A window or
    threshold of 0 means the default.
    """
    window = window or C.DEFAULTS.duplicate_window
    threshold = threshold or C.DEFAULTS.duplicate_threshold
    if skip:
        return df.select(*no_match(*[c for c in (by, "message_id") if c]))
    entering = entering_rows(df, text_col=text_col, vector_col=vector_col, seq_col=seq_col, by=by)
    numbered = with_row_index(entering.where(~F.col("_blank")), "_seq", by=("_key",), tie_cols=("message_id",))
    numbered = materialise(
        numbered.select(
            "_key", "message_id", "row_index", "vector", F.lit(None).cast("long").alias("carried_cluster")
        ),
        "numbered",
    )
    clusters = assign_clusters(numbered, window=window, threshold=threshold, block_rows=block_rows)
    checked = name_matches(materialise(clusters, "clusters"))
    if text_col is not None:
        checked = checked.unionByName(entering.where("_blank").select(*no_match("_key", "message_id")))
    return checked.withColumnRenamed("_key", by) if by else checked.drop("_key")


def window_count(df: DataFrame, *, text_col: str = "cleaned_text", window: int | None = None) -> DataFrame:
    """How many messages the window holds after all of ``df``."""
    window = window or C.DEFAULTS.duplicate_window
    return df.agg(
        F.least(F.lit(window), F.count_if(~is_blank(F.col(text_col)))).cast("long").alias("dedup_window_size")
    )


def cluster_summary(df: DataFrame, *, text_col: str = "cleaned_text", seq_col: str = "arrival_seq") -> DataFrame:
    """Size and first text of each cluster; partial aggregates meet a hot one."""
    return (
        df.where(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(F.count("*").alias("messages"), F.min_by(text_col, seq_col).alias("first_text"))
    )
