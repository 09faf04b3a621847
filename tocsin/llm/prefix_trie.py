"""The prefix trie of conversations and totals over its subtrees.

A node is a distinct sequence of first turns.  Positions, and codes of whole
prefixes, are worked out by ranges of turns, so a conversation of any length
is shared by many tasks; nodes are then an aggregate.

Subtree totals are computed by time-forward processing: nodes are sorted by
reverse level order, each takes from a priority queue what its children sent,
and sends its own total to its parent.  First within shards, which are
subtrees bounded in size.  The nodes above them form runs without a branch;
each run, shrunk to one row, takes part in a second pass across the shards'
roots, and totals inside runs are running sums.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.common import pin, salted_lookup

#: Every conversation begins as the one whose id is the last multiple of ``FAMILY`` does.
FAMILY, SHARED_TURNS = 20, 4
#: Turns below a shard's root, at most.
SHARD_TURNS = 50_000
#: Messages a priority queue holds before half of them go to disk.
QUEUE_ROWS = 200_000
#: Depths of one run that are summed together, and ids of one chunk that is hashed.
RANGE_DEPTHS, CHUNK_IDS = 4_096, 4_096
WORD = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "_x", "_y"]


def _ranged(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Pin rows dealt to ranges of ``order``, with the range's number as ``_range``."""
    dealt = rows.repartitionByRange(*order)
    return pin(dealt.withColumn("_range", F.spark_partition_id().cast("long")))


def _running(rows: DataFrame, group: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Running aggregates over the ranges of a group, own row included.

    ``sums`` names aggregates that combine by ``bit_xor`` if the name begins
    with an underscore, else by sum.  Only one row per range of a group meets
    in one task.
    """
    def total(name: str, value: Column) -> Column:
        return F.bit_xor(value) if name.startswith("_") else F.sum(value)

    def combined(name: str, left: Column, right: Column) -> Column:
        return left.bitwiseXOR(right) if name.startswith("_") else left + right

    parts = rows.groupBy(*group, "_range").agg(*[total(n, v).alias(f"_t{n}") for n, v in sums.items()])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        *group, "_range", *[F.coalesce(total(n, F.col(f"_t{n}")).over(earlier), F.lit(0)).alias(f"_t{n}") for n in sums]
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(*rows.columns, *[total(n, v).over(inside).alias(f"_l{n}") for n, v in sums.items()])
    return local.join(before, [*group, "_range"]).select(
        *rows.columns, *[combined(n, F.col(f"_l{n}"), F.col(f"_t{n}")).alias(n) for n in sums]
    )


def own_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` from 1, ``said`` (a code of role and text), ``words`` and ``_range``.

    Turns that share a number follow the order of that code.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("said"),
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("words"),
    )
    placed = _ranged(turns, "conv_id", F.asc_nulls_first("turn"), "said")
    return _running(placed, ["conv_id"], [F.asc_nulls_first("turn"), "said"], {"pos": F.lit(1).cast("long")}).drop("turn")


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """Every conversation with its beginning taken from the first of its family.

    One row per turn, and one of position 0 per conversation: ``conv_id, pos,
    length, said, words, _range``.
    """
    own = pin(own_turns(conversations))
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = (
        own.filter((F.col("pos") < SHARED_TURNS) & (F.col("conv_id") % FAMILY == 0))
        .groupBy(F.col("conv_id").alias("_base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "said", "words"))).alias("_head"))  # three at most
    )
    nothing = F.expr("cast(array() as array<struct<pos:bigint,said:string,words:bigint>>)")
    families = (
        convs.select("conv_id", "_own", taken.alias("_taken"), base.alias("_base")).join(heads, "_base", "left")
        .withColumn("_head", F.slice(F.coalesce("_head", nothing), F.lit(1), F.col("_taken").cast("int")))
        .withColumn("_shift", F.size("_head").cast("long") - F.col("_taken"))
        .withColumn("length", F.size("_head").cast("long") + F.greatest(F.col("_own") - F.col("_taken"), F.lit(0)))
    )
    families = pin(families.select("conv_id", "_taken", "_shift", "length", "_head"))
    top = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("said"), F.lit(0).cast("long").alias("words"))
    borrowed = families.select("conv_id", "length", F.inline(F.concat(F.array(top), "_head"))).withColumn(
        "_range", F.lit(-1).cast("long")
    )
    rest = salted_lookup(own, families.drop("_head"), ["conv_id"], "_range").filter("pos > _taken").select(
        "conv_id", "length", (F.col("pos") + F.col("_shift")).alias("pos"), "said", "words", "_range"
    )
    return borrowed.unionByName(rest)


def prefixes(conversations: DataFrame) -> DataFrame:
    """The node each turn of each rebuilt conversation ends at.

    ``conv_id, depth, length, words``, the node's code ``_x, _y`` and its
    parent's ``_px, _py``.  A prefix's code joins the codes of its turns and
    their places by exclusive or, 128 bits in all.
    """
    turns = rebuilt_turns(conversations)
    own = {
        name: F.when(F.col("pos") > 0, F.xxhash64(F.lit(seed), F.col("pos"), F.col("said"))).otherwise(F.lit(0))
        for name, seed in (("_x", 11), ("_y", 17))
    }
    coded = _running(turns, ["conv_id"], ["pos"], own)
    return pin(coded.select(
        "conv_id", F.col("pos").alias("depth"), "length", "words", "_x", "_y",
        F.col("_x").bitwiseXOR(own["_x"]).alias("_px"), F.col("_y").bitwiseXOR(own["_y"]).alias("_py"),
    ))


# --- hashes of long lists of ids -----------------------------------------


def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id become texts of up to ``CHUNK_IDS`` ids."""
    rows: list[tuple] = []
    key, ids = None, []

    def flush() -> None:
        if ids:
            rows.append((*key, ids[0], ",".join(map(str, ids))))

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*KEY, "first", "ids"]
        )

    for batch in batches:
        for *node, conv in zip(*[batch.column(c).to_pylist() for c in (*KEY, "conv_id")], strict=True):
            if tuple(node) != key or len(ids) == CHUNK_IDS:
                flush()
                key, ids = tuple(node), []
            ids.append(conv)
        yield out()
        rows.clear()
    flush()
    yield out()


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by node and first id become one hash per node; a chunk is forgotten once hashed."""
    key, state, rows = None, None, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*KEY, "ends_sha256"]
        )

    for batch in batches:
        for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
            if tuple(node) == key:
                state.update(b"," + ids.encode())
            else:
                if state:
                    rows.append((*key, state.hexdigest()))
                key, state = tuple(node), hashlib.sha256(ids.encode())
        yield out()
        rows.clear()
    if state:
        rows.append((*key, state.hexdigest()))
    yield out()


def end_hashes(steps: DataFrame) -> DataFrame:
    """``ends_sha256`` of the nodes at which conversations end.

    Ids are sorted in ranges, so those of one node are cut among tasks; one
    task then passes over a node's chunks of text, holding one at a time.
    """
    names = ", ".join(f"{c} long" for c in KEY)
    ends = steps.filter("depth = length").select(*KEY, "conv_id")
    dealt = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    chunks = dealt.mapInArrow(_id_chunks, f"{names}, first long, ids string")
    gathered = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return gathered.mapInArrow(_hash_chunks, f"{names}, ends_sha256 string")


# --- time-forward processing ---------------------------------------------


class SpillingQueue:
    """A priority queue of tuples; beyond ``limit`` the later half goes to disk as a sorted run."""

    def __init__(self, limit: int = QUEUE_ROWS) -> None:
        self.limit, self.heap, self.runs, self.spilled = limit, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self.heap.sort()
            half = len(self.heap) // 2
            run = self._written(self.heap[half:])
            del self.heap[half:]
            heapq.heappush(self.runs, (next(run), self.spilled, run))
            self.spilled += 1

    @staticmethod
    def _written(items: list[tuple]) -> Iterator[tuple]:
        # Spark's own scratch folder of this executor; the file is gone with its task.
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        file = tempfile.TemporaryFile(dir=folder)
        for item in items:
            pickle.dump(item, file)
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                for _ in range(len(items)):
                    yield pickle.load(file)

        return read()

    def top(self) -> tuple | None:
        on_disk = self.runs[0][0] if self.runs else None
        if self.heap and (on_disk is None or self.heap[0] <= on_disk):
            return self.heap[0]
        return on_disk

    def pop(self) -> tuple:
        if self.runs and not (self.heap and self.heap[0] <= self.runs[0][0]):
            item, number, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))
            return item
        return heapq.heappop(self.heap)


SENT = ["_home", "_home_depth", "depth", "conv_id", "_up_depth", "_up_conv", "_leaves", "_saved"]


def _forward(batches: Iterator[pa.RecordBatch], queue_rows: int) -> Iterator[pa.RecordBatch]:
    """Subtree totals of rows sorted by shard and reverse level order.

    A row is addressed by shard, falling depth and conversation; it meets the
    messages to it at the head of the queue, as all its children came before.
    """
    queue = SpillingQueue(queue_rows)
    for batch in batches:
        leaves, saved = [], []
        for home, home_depth, depth, conv, up_depth, up_conv, own_leaves, own_saved in zip(
            *[batch.column(c).to_pylist() for c in SENT], strict=True
        ):
            here = (home, home_depth, -depth, conv)
            while (sent := queue.top()) is not None and sent[:4] <= here:
                if sent[:4] == here:
                    own_leaves, own_saved = own_leaves + sent[4], own_saved + sent[5]
                queue.pop()
            leaves.append(own_leaves)
            saved.append(own_saved)
            if up_conv is not None:
                queue.push((home, home_depth, -up_depth, up_conv, own_leaves, own_saved))
        names = [*batch.schema.names, "n_leaves", "saved_tokens"]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], names
        )


def time_forward(rows: DataFrame, queue_rows: int = QUEUE_ROWS, tasks: int | None = None) -> DataFrame:
    """Add ``n_leaves`` and ``saved_tokens`` to rows that carry the columns ``SENT``.

    A shard lies in one task, sorted by Spark's external sort.  A message to
    a row outside the shard must not be sent: ``_up_conv`` is null there.
    """
    shard = ["_home", "_home_depth"]
    dealt = rows.repartition(tasks, *shard) if tasks else rows.repartition(*shard)
    ordered = dealt.sortWithinPartitions(*shard, F.desc("depth"), "conv_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ordered.mapInArrow(
        lambda it: _forward(it, queue_rows), f"{schema}, n_leaves long, saved_tokens long"
    )


# --- nodes -----------------------------------------------------------------


def trie_nodes(steps: DataFrame) -> DataFrame:
    """One row per node with its parent, own values and ``_weight``, a bound of its subtree's nodes."""
    nodes = pin(
        steps.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
            F.max("_px").alias("_px"), F.max("_py").alias("_py"),
            (F.sum(F.col("length") - F.col("depth")) + 1).alias("_weight"),
        )
    )
    root = F.col("depth") == 0
    children = nodes.filter(~root).groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("_px").alias("_x"), F.col("_py").alias("_y")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").join(end_hashes(steps), KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)).cast("long"),
        "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_IDS)),
        "_salt": F.pmod(F.col("_x"), F.lit(64)),
    })
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("_x").alias("_px"), F.col("_y").alias("_py"),
        F.col("conv_id").alias("parent_conv_id"), F.col("_weight").alias("_above"),
    )
    below = salted_lookup(nodes.filter(~root), parents, ["depth", "_px", "_py"], "_salt")
    top = nodes.filter(root).withColumns({
        "parent_conv_id": F.lit(None).cast("long"), "_above": F.lit(None).cast("long")
    })
    own = below.unionByName(top.select(*below.columns))
    return pin(own.withColumns({
        "_leaves": (F.col("n_children") == 0).cast("long"),
        "_saved": (F.col("n_convs") - 1) * F.col("words"),
    }).drop("_salt", "_px", "_py"))


def _homes(steps: DataFrame, nodes: DataFrame, shard_turns: int) -> DataFrame:
    """The shard's root on each conversation's way down: ``conv_id, _home, _home_depth``."""
    light = nodes.filter(F.col("_weight") <= shard_turns)
    roots = light.filter(F.col("_above").isNull() | (F.col("_above") > shard_turns)).select(
        *KEY, F.col("conv_id").alias("_home")
    )
    # Only conversations that name a light node are asked for.
    asked = light.select("conv_id").distinct().withColumn("_asked", F.lit(True))
    lead = steps.select("conv_id", *KEY, F.pmod(F.xxhash64("conv_id"), F.lit(64)).alias("_salt"))
    passed = salted_lookup(lead, roots, KEY, "_salt").select("conv_id", "_home", F.col("depth").alias("_home_depth"))
    return passed.join(asked, "conv_id", "left_semi")


def _runs(heavy: DataFrame) -> DataFrame:
    """Number, within its conversation, of the run of heavy nodes that each belongs to.

    Only the lowest node of a run has heavy children of other conversations.
    """
    branched = heavy.filter("parent_conv_id <> conv_id").select(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
    ).distinct()
    last = heavy.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = branched.union(last.select("conv_id", "depth")).distinct().withColumn("_ends", F.lit(1).cast("long"))
    marked = heavy.join(ends, ["conv_id", "depth"], "left").withColumns({
        "_ends": F.coalesce("_ends", F.lit(0).cast("long")),
        # Ranges count upwards from the deepest nodes.
        "_range": -F.floor(F.col("depth") / RANGE_DEPTHS),
    })
    return _running(marked, ["conv_id"], [F.desc("depth")], {"run": F.col("_ends")})


def conversation_trie(
    conversations: DataFrame, shard_turns: int = SHARD_TURNS, queue_rows: int = QUEUE_ROWS
) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations.

    Conversation ``c`` begins with the first ``crc32(c) % 4`` turns of
    conversation ``c - c % 20`` and goes on with its own turns after as many.
    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Null role or text counts as empty, null turns come first.  Turns of one
    number follow the md5 of role and text; repeated rows are turns of their
    own.  Rows without ``conv_id`` belong to no conversation and are left out.
    An empty table has no member and so no root.  Extra columns are not read;
    texts of any length are read whole.
    """
    steps = prefixes(conversations)
    nodes = trie_nodes(steps)
    heavy_above = F.col("_above") > shard_turns
    light = nodes.filter(F.col("_weight") <= shard_turns)
    homed = light.join(_homes(steps, nodes, shard_turns), "conv_id").withColumns({
        "_up_depth": F.col("depth") - 1,
        "_up_conv": F.when(~heavy_above, F.col("parent_conv_id")),
    })
    within = pin(time_forward(homed.drop("_x", "_y"), queue_rows))

    heavy = pin(nodes.filter(F.col("_weight") > shard_turns))
    arrived = within.filter(heavy_above).groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
    ).agg(F.sum("n_leaves").alias("_in_leaves"), F.sum("saved_tokens").alias("_in_saved"))
    runs = pin(_runs(heavy).join(arrived, ["conv_id", "depth"], "left").withColumns({
        "_leaves": F.col("_leaves") + F.coalesce("_in_leaves", F.lit(0)),
        "_saved": F.col("_saved") + F.coalesce("_in_saved", F.lit(0)),
    }))
    # One row for a run, addressed by its lowest node; messages go to the lowest node of the run above.
    shrunk = runs.groupBy("conv_id", "run").agg(
        F.max("depth").alias("depth"), (F.min("depth") - 1).alias("_up_depth"),
        F.min_by("parent_conv_id", "depth").alias("_up_conv"),
        F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved"),
    ).withColumns({"_home": F.lit(0).cast("long"), "_home_depth": F.lit(0).cast("long")})
    across = time_forward(shrunk, queue_rows, tasks=1).select(
        "conv_id", "run", (F.col("n_leaves") - F.col("_leaves")).alias("_more_leaves"),
        (F.col("saved_tokens") - F.col("_saved")).alias("_more_saved"),
    )
    summed = _running(
        runs, ["conv_id", "run"], [F.desc("depth")], {"n_leaves": F.col("_leaves"), "saved_tokens": F.col("_saved")}
    ).withColumn("_salt", F.pmod("depth", F.lit(64)))
    above = salted_lookup(summed, across, ["conv_id", "run"], "_salt").withColumns({
        "n_leaves": F.col("n_leaves") + F.col("_more_leaves"),
        "saved_tokens": F.col("saved_tokens") + F.col("_more_saved"),
    })
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return within.select(*columns).unionByName(above.select(*columns))
