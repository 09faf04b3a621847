"""Documents that share most of their word n-grams: an exact Jaccard join.

The join is size-aware.  Light sets list the fixed-size subsets (pairs) of
their rarest shingles, and two light sets meet where they list the same
pair.  Heavy sets, for which pairs would be too many, scan the inverted lists
of their rarest shingles instead.  The size at which sets count as heavy is
the one with the least estimated cost.

How far a set must be listed follows from the overlap a partner needs: of n
shingles at least ``ceil(t n)`` must be shared, so whichever n - ceil(t n) + k
shingles come first in a common order, k of them are shared.  The order is by
rising document frequency.

To keep the work in proportion:

- documents with equal sets are one class and enter once;
- a first pass drops classes whose first shingles in code order are hardly
  shared with any other class, which no partner would allow;
- links that can't change a component are not checked: a first round links
  sets to one leader each, and later only sets of different components meet.

Shingles are 64-bit codes, so counts of a pair could be wrong by a chance of
about 1e-14; classes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.common import SALTS, pin, salted_lookup
from tocsin.llm.components import connected
from tocsin.llm.words import mix, shingle_codes, word_codes

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: One extra shingle in so many lengthens the first pass's prefix.
EXTRA = 10
#: Rows that the first pass looks at together, before it shuffles.
CHUNK_ROWS = 4_000
#: Of a shingle's code the bucket and so many bytes tell it apart in the first pass.
CODE_BYTES = 5
#: Codes that one bucket of the first pass gets, about.
BUCKET_CODES = 400_000
#: Ranges of class keys in which the first pass's counts are summed.
KEY_RANGES = 256
#: Longs of a set's parity bitmap, which tells most pairs that are too different.
BITMAP = 8
#: Sets whose tokens are counted and listed together.
CHUNK_NODES = 1_024
#: Rounds of leaders at most; what they leave unlinked is checked pair by pair.
TURNS = 4
#: About so many rows of an inverted list count as its cost.
LIST_ROWS = 8
#: Stands for a null id in joins.
NO_ID = -(2**63)
#: Size classes for the cost estimate: so many for each doubling.
STEPS = 8


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle codes of a text, sorted; A-Z count as a-z."""
    return np.unique(shingle_codes(word_codes((text or b"").lower()), width))


def fingerprint(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


def short_key(print_: bytes) -> int:
    return int.from_bytes(print_[:8], "little", signed=True)


def needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _measure(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints = [], []
        for text in batch.column("_text"):
            codes = shingle_set(text.as_py(), width)
            sizes.append(len(codes))
            prints.append(fingerprint(codes) if len(codes) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                pa.array([p and short_key(p) for p in prints], pa.int64()),
            ],
            ["doc_id", "n_shingles", "_print", "_key"],
        )


def _cell(bucket: int, keys: np.ndarray, owners: np.ndarray, codes: np.ndarray, credits: np.ndarray) -> tuple:
    own, places = np.unique(owners, return_inverse=True)
    packed = codes.view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()
    return bucket, keys[own].tobytes(), places.astype(np.uint16).tobytes(), packed, credits.astype(np.int32).tobytes()


def _prefix_cells(
    batches: Iterator[pa.RecordBatch], width: int, percent: int, buckets: int
) -> Iterator[pa.RecordBatch]:
    """First shingles of each class in code order, packed by chunk of rows and bucket of codes.

    Shingles that several classes of the chunk share are credited at once and
    go on as one entry of no class (key 0), however many classes they have.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK_ROWS):
            seen: dict[int, np.ndarray] = {}
            for text in batch.column("_text").slice(start, CHUNK_ROWS):
                codes = shingle_set(text.as_py(), width)
                if len(codes) > 1:
                    seen[short_key(fingerprint(codes))] = codes[
                        : len(codes) - needed(len(codes), percent) + 1 + len(codes) // EXTRA
                    ]
            if not seen:
                continue
            keys = np.fromiter([*seen, 0], np.int64, len(seen) + 1)
            owner = np.repeat(np.arange(len(seen)), [len(x) for x in seen.values()])
            codes = mix(np.concatenate(list(seen.values())))
            order = np.argsort(codes)
            codes, owner = codes[order], owner[order]
            first = np.r_[True, codes[1:] != codes[:-1]]
            alone = first & np.r_[first[1:], True]
            credit = np.bincount(owner[~alone], minlength=len(seen))
            codes, owner = codes[first], np.where(alone, owner, len(seen))[first]
            bucket = ((codes >> np.uint64(8 * CODE_BYTES)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True])
            cells = []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                at = order[low:high]
                cells.append(_cell(int(bucket[at[0]]), keys, owner[at], codes[at], np.empty(0)))
            credited = np.flatnonzero(credit)
            none = np.empty(0, np.uint64)
            cells.append((int(keys[0] % buckets), keys[credited].tobytes(), b"", none.tobytes(), credit[credited].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*cells, strict=True), [pa.int64(), *[pa.binary()] * 4], strict=True)],
                ["_bucket", "_keys", "_owners", "_codes", "_credits"],
            )


def _bucket_credits(cells: pa.Table) -> pa.Table:
    """How many of its codes in this bucket each class shares with another class."""
    keys, codes, given_to, given = [], [], [], []
    for own, owners, packed, credits in zip(*(cells.column(c).to_pylist() for c in ("_keys", "_owners", "_codes", "_credits")), strict=True):
        own = np.frombuffer(own, np.int64)
        if credits:
            given_to.append(own)
            given.append(np.frombuffer(credits, np.int32))
            continue
        wide = np.zeros((len(packed) // CODE_BYTES, 8), np.uint8)
        wide[:, :CODE_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, CODE_BYTES)
        codes.append(wide.view(np.uint64).ravel())
        keys.append(own[np.frombuffer(owners, np.uint16)])
    if any(map(len, codes)):
        code, key = np.concatenate(codes), np.concatenate(keys)
        order = np.lexsort((key, code))
        code, key = code[order], key[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        lengths = np.diff(np.r_[starts, len(code)])
        several = np.logical_or.reduceat(key == 0, starts) | (key[starts] != key[starts + lengths - 1])
        new = np.r_[True, (code[1:] != code[:-1]) | (key[1:] != key[:-1])]
        shared = key[np.repeat(several, lengths) & new & (key != 0)]
        given_to.append(shared)
        given.append(np.ones(len(shared), np.int32))
    found, total = _summed(given_to, given)
    ranges = found.view(np.uint64) % np.uint64(KEY_RANGES)
    order = np.argsort(ranges, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(ranges[order].astype(np.int64)) > 0, True]) if len(order) else [0]
    parts = [order[low:high] for low, high in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({
        "_range": pa.array([int(ranges[p[0]]) for p in parts], pa.int64()),
        "_keys": pa.array([found[p].tobytes() for p in parts], pa.binary()),
        "_credits": pa.array([total[p].astype(np.int32).tobytes() for p in parts], pa.binary()),
    })


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate([*keys, np.empty(0, np.int64)]), return_inverse=True)
    weights = np.concatenate([*values, np.empty(0)])
    return found, np.bincount(where, weights, len(found)).astype(np.int64)


def _range_credits(parts: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x, np.int64) for x in parts.column("_keys").to_pylist()]
    found, total = _summed(keys, [np.frombuffer(x, np.int32) for x in parts.column("_credits").to_pylist()])
    return pa.table({"_key": found, "_credit": total})


def _token_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text.as_py(), width).view(np.int64) for text in batch.column("_text")]
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate([*sets, np.empty(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([fingerprint(x) for x in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
            ],
            ["_print", "_tokens"],
        )


def _plausible(texts: DataFrame, shingles: int, width: int, percent: int) -> DataFrame:
    """How many first shingles each class shares with other classes: ``_key, _credit``.

    Counts may be too high, by codes or keys that happen to be equal, never
    too low.
    """
    buckets = max(16, shingles // (3 * BUCKET_CODES))
    cells = texts.select("_text").mapInArrow(
        lambda it: _prefix_cells(it, width, percent, buckets),
        "_bucket long, _keys binary, _owners binary, _codes binary, _credits binary",
    )
    parts = cells.groupBy("_bucket").applyInArrow(_bucket_credits, "_range long, _keys binary, _credits binary")
    return parts.groupBy("_range").applyInArrow(_range_credits, "_key long, _credit long")


def _light_limit(sets: DataFrame) -> int:
    """The size up to which sets list pairs, by the least estimated cost.

    Costs are rows to be made: the pairs of the prefix, or the lengths of the
    inverted lists, of which leaders settle all but ``LIST_ROWS`` or so.  They
    are summed in classes of sizes, ``STEPS`` for each doubling, so few rows
    come to the driver.
    """
    step = F.ceil(STEPS * F.log2("_n")).cast("int")
    pairs = (F.col("_p1") + 1) * F.col("_p1") / 2
    lists = F.aggregate(
        F.slice("_listed", 1, F.col("_p1")), F.lit(0).cast("long"), lambda s, x: s + F.least(x["_df"], F.lit(LIST_ROWS))
    )
    rows = sets.groupBy(step.alias("step")).agg(F.sum(pairs).alias("pairs"), F.sum(lists).alias("lists")).collect()
    rows.sort()
    best, limit, cost = 0.0, 1, 0.0
    for row in rows:
        cost += row["pairs"] - row["lists"]
        if cost < best:
            best, limit = cost, math.floor(2 ** (row["step"] / STEPS))
    return limit


def _postings(sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """Where sets can meet: ``_key, _node, _n``, with ``_weight``, how common the set's listed shingles are."""
    light = (F.col("_n") <= limit) & (F.col("_need") >= 2)
    listed = F.transform("_listed", lambda x: x["_token"])
    pairs = F.flatten(F.transform(
        listed,
        lambda a, i: F.transform(F.slice(listed, 1, i), lambda b: F.xxhash64(F.lit(2), b, a)),
    ))
    near_heavy = ~light | (F.col("_n") * 100 >= percent * limit)
    tokens = F.slice(listed, 1, F.col("_p1"))
    none = F.array().cast("array<long>")
    keys = F.concat(F.when(light, pairs).otherwise(none), F.when(near_heavy, tokens).otherwise(none))
    common = F.aggregate("_listed", F.lit(0).cast("long"), lambda s, x: s + x["_df"]) / F.col("_n")
    return sets.select(F.explode(keys).alias("_key"), "_node", "_n", common.alias("_weight"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar; ``sets`` has the shingles that are in several sets."""
    left = sets.select(F.col("_node").alias("_a"), F.col("_n").alias("_na"), F.col("_shared").alias("_sa"))
    right = sets.select(F.col("_node").alias("_b"), F.col("_n").alias("_nb"), F.col("_shared").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    return (
        _near(pairs, sets, percent).join(right, "_b").join(left, "_a")
        .withColumn("_i", both)
        .filter(100 * F.col("_i") >= percent * (F.col("_na") + F.col("_nb") - F.col("_i")))
        .select("_a", "_b")
    )


def _fits(a: Column, b: Column, percent: int) -> Column:
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings of keys that meet sets of several components, with ``_label`` and the key's ``_main`` one.

    ``_rest`` is how many of the key's sets are outside its main component.
    """
    if labels is None:
        placed = postings.withColumn("_label", F.col("_node"))
    else:
        salted = postings.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
        placed = salted.join(labels, "_node", "left").withColumn("_label", F.coalesce("_label", "_node")).drop("_salt")
    counts = placed.groupBy("_key", "_label").agg(F.count(F.lit(1)).alias("_count"))
    mixed = counts.groupBy("_key").agg(
        F.max(F.struct("_count", "_label")).alias("_top"), F.count(F.lit(1)).alias("_labels"),
        F.sum("_count").alias("_all"),
    ).filter("_labels > 1")
    return pin(placed.join(
        mixed.select("_key", F.col("_top._label").alias("_main"), "_all", (F.col("_all") - F.col("_top._count")).alias("_rest")),
        "_key",
    ))


def _leader_pairs(mixed: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each set the leader of another component that it meets most often.

    A key's leader is first the set whose shingles are the most common, which
    is the middle of a group of near copies, later any set.
    """
    rank = F.xxhash64("_node", F.lit(turn)) if turn else F.col("_weight")
    leaders = mixed.groupBy("_key").agg(F.max(F.struct(rank, "_node", "_n", "_label")).alias("_lead"))
    met = mixed.join(leaders, "_key").filter("_label <> _lead._label").filter(
        _fits(F.col("_n"), F.col("_lead._n"), percent)
    )
    counts = met.groupBy("_node", F.col("_lead._node").alias("_a")).agg(F.count(F.lit(1)).alias("_met"))
    best = counts.groupBy("_node").agg(F.max(F.struct("_met", F.xxhash64("_a", F.lit(turn)), "_a")).alias("_best"))
    return best.select(F.col("_best._a").alias("_a"), F.col("_node").alias("_b"))


def _open_pairs(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs that meet, are in different components so far and may be similar by their bitmaps.

    The sets outside a key's main component meet all others of the key.
    """
    rows = mixed.join(sets.select("_node", "_bits", (F.col("_n") - F.size("_shared")).alias("_o")), "_node")
    few = rows.filter("_label <> _main").select(
        "_key", F.col("_node").alias("_x"), F.col("_n").alias("_nx"), F.col("_label").alias("_lx"),
        F.col("_bits").alias("_bitsx"), F.col("_o").alias("_ox"),
    )
    close = _may_be_similar(
        F.col("_n"), F.col("_nx"), F.col("_o") + F.col("_ox"), F.col("_bits"), F.col("_bitsx"), percent
    )
    one_way = (F.col("_label") == F.col("_main")) | (F.col("_x") < F.col("_node"))
    right = rows.withColumnRenamed("_key", "_at")
    met = few.join(right, (F.col("_key") == F.col("_at")) & (F.col("_label") != F.col("_lx")) & one_way & close)
    return met.select(F.least("_x", "_node").alias("_a"), F.greatest("_x", "_node").alias("_b")).distinct()


def _may_be_similar(na: Column, nb: Column, alone: Column, bits_a: Column, bits_b: Column, percent: int) -> Column:
    """Whether the bitmaps leave it open that two sets are similar.

    Similar sets differ in at most ``(a + b) (100 - percent) / (100 + percent)``
    tokens, of which those that only one set of all has count from the start.
    """
    places = F.aggregate(
        F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    return (100 + percent) * (alone + places) <= (100 - percent) * (na + nb)


def _nodes(texts: DataFrame, classes: DataFrame, shingles: int, width: int, percent: int) -> DataFrame:
    """Classes that may have a partner, numbered: ``_node, _print, _least, _n, _tokens``.

    A text is fetched by its class's least id; where ids repeat, the class
    read from the text decides.
    """
    size = F.col("n_shingles")
    kept = (
        classes.filter(size > 1)
        .join(_plausible(texts, shingles, width, percent), "_key")
        .filter(F.col("_credit") > F.floor(size / EXTRA))
        .select("_print", "_least", F.coalesce("_least", F.lit(NO_ID)).alias("_at"))
    )
    kept = pin(kept)
    wanted = texts.withColumn("_at", F.coalesce("doc_id", F.lit(NO_ID))).join(
        kept.select("_at").distinct(), "_at", "left_semi"
    )
    sets = wanted.select("_text").mapInArrow(lambda it: _token_rows(it, width), "_print binary, _tokens array<long>")
    chosen = sets.join(kept.select("_print", "_least"), "_print").dropDuplicates(["_print"])
    return pin(chosen.select(
        F.monotonically_increasing_id().alias("_node"), "_print", "_least",
        F.size("_tokens").cast("long").alias("_n"), "_tokens",
    ))


def _chunk_cells(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """How many sets of a chunk have each token, packed by bucket of tokens."""
    for batch in batches:
        chunks = batch.column("_chunk").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            if start == stop:
                continue
            flat = batch.column("_tokens").slice(start, stop - start).flatten().to_numpy()
            tokens, counts = np.unique(flat, return_counts=True)
            bucket = (tokens.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True]) if len(order) else [0]
            parts = [order[low:high] for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(bucket[p[0]]) for p in parts], pa.int64()),
                    pa.array([int(chunks[start])] * len(parts), pa.int64()),
                    pa.array([tokens[p].tobytes() for p in parts], pa.binary()),
                    pa.array([counts[p].astype(np.int32).tobytes() for p in parts], pa.binary()),
                ],
                ["_bucket", "_chunk", "_codes", "_counts"],
            )


def _cell_frequencies(cells: pa.Table) -> pa.Table:
    """For each chunk those of its tokens in this bucket that more than one set has, with how many have them."""
    codes = [np.frombuffer(x, np.int64) for x in cells.column("_codes").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in cells.column("_counts").to_pylist()])
    _, where = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.bincount(where, counts).astype(np.int64)[where]
    ends = np.cumsum([len(x) for x in codes])
    parts = [(x, total[end - len(x) : end]) for x, end in zip(codes, ends.tolist(), strict=True)]
    return pa.table({
        "_chunk": cells.column("_chunk"),
        "_codes": pa.array([x[n > 1].tobytes() for x, n in parts], pa.binary()),
        "_dfs": pa.array([n[n > 1].tobytes() for _, n in parts], pa.binary()),
    })


LISTED = (
    "_node long, _n long, _need long, _p1 int, _listed array<struct<_df: long, _token: long>>, _shared array<long>, _bits array<long>"
)


def _listed_rows(sets: pa.Table, found: pa.Table, percent: int) -> pa.Table:
    """The sets of one chunk with the tokens they share; see ``_listed``."""
    codes = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in found.column("_codes").to_pylist())])
    dfs = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in found.column("_dfs").to_pylist())])
    order = np.argsort(codes)
    codes, dfs = np.append(codes[order], 0), np.append(dfs[order], 0)  # the last entry stands for no token
    tokens = sets.column("_tokens").combine_chunks()
    sizes = sets.column("_n").to_numpy()
    flat, owner = tokens.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
    at = np.searchsorted(codes[:-1], flat)
    known = (codes[at] == flat) & (dfs[at] > 0)
    flat, owner, df = flat[known], owner[known], dfs[at[known]]
    order = np.lexsort((flat, df, owner))
    flat, owner, df = flat[order], owner[order], df[order]
    shared = np.bincount(owner, minlength=len(sizes))
    need = -(-percent * sizes // 100)
    first = shared - need + 1
    kept = first > 0
    # For each place of a bitmap whether an odd number of the tokens fall on it: two sets
    # differ in at least as many tokens as their bitmaps differ in places.
    place = owner * (64 * BITMAP) + (flat % BITMAP) * 64 + ((flat >> 8) & 63)
    odd = (np.bincount(place, minlength=64 * BITMAP * len(sizes)) & 1).astype(np.uint8).reshape(-1, 64)
    bits = np.packbits(odd, axis=1, bitorder="little").view("<i8").reshape(-1, BITMAP)[kept]
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(shared) - shared, shared)
    in_kept = kept[owner]
    listed = in_kept & (rank <= first[owner])
    list_sizes = np.bincount(owner[listed], minlength=len(sizes))[kept]

    def lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), values)

    pairs = pa.StructArray.from_arrays([pa.array(df[listed]), pa.array(flat[listed])], ["_df", "_token"])
    return pa.table({
        "_node": sets.column("_node").to_numpy()[kept], "_n": sizes[kept], "_need": need[kept],
        "_p1": first[kept].astype(np.int32), "_listed": lists(pairs, list_sizes),
        "_shared": lists(pa.array(flat[in_kept]), shared[kept]),
        "_bits": lists(pa.array(bits.ravel()), np.full(int(kept.sum()), BITMAP)),
    })


def _listed(nodes: DataFrame, percent: int) -> DataFrame:
    """The shingles that each set has in common with others, and the first of them by frequency.

    ``_node, _n, _need, _p1, _listed, _shared, _bits``; sets with too few are
    left out.  Sets are taken in chunks; a chunk asks for each of its tokens
    once, so one that most sets have is met once a chunk.
    """
    total = nodes.agg(F.sum("_n")).first()[0] or 0
    buckets = max(16, total // BUCKET_CODES)
    chunked = nodes.select(F.floor(F.col("_node") / CHUNK_NODES).cast("long").alias("_chunk"), "_node", "_n", "_tokens")
    cells = chunked.select("_chunk", "_tokens").mapInArrow(
        lambda it: _chunk_cells(it, buckets), "_bucket long, _chunk long, _codes binary, _counts binary"
    )
    found = cells.groupBy("_bucket").applyInArrow(_cell_frequencies, "_chunk long, _codes binary, _dfs binary")
    joined = chunked.groupBy("_chunk").cogroup(found.groupBy("_chunk"))
    return pin(joined.applyInArrow(lambda sets, dfs: _listed_rows(sets, dfs, percent), LISTED))


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Without the pairs whose bitmaps differ in too many places."""
    alone = F.col("_n") - F.size("_shared")
    left, right = (
        sets.select(
            F.col("_node").alias(f"_{x}"), F.col("_n").alias(f"_n{x}"), F.col("_bits").alias(f"_bits{x}"),
            alone.alias(f"_o{x}"),
        )
        for x in "ab"
    )
    near = _may_be_similar(
        F.col("_na"), F.col("_nb"), F.col("_oa") + F.col("_ob"), F.col("_bitsa"), F.col("_bitsb"), percent
    )
    return pairs.join(left, "_a").join(right, "_b").filter(near).select("_a", "_b")


def _components(sets: DataFrame, percent: int) -> DataFrame:
    """``_node, _root`` of the sets that are linked with a lesser one."""
    postings = pin(_postings(sets, _light_limit(sets), percent))
    rows, labels, before = postings.count(), None, math.inf
    for turn in range(TURNS):
        mixed = _labelled(postings, labels)
        # Pairs that are left at most; a few for each row are quickly checked.
        left = mixed.filter("_label <> _main").agg(F.sum("_all")).first()[0] or 0
        if left <= 2 * rows or left > 0.8 * before:
            break
        before = left
        labels = _merged(labels, _verified(_leader_pairs(mixed, turn, percent), sets, percent))
    else:
        mixed = _labelled(postings, labels)
    merged = _merged(labels, _verified(_open_pairs(mixed, sets, percent), sets, percent))
    return merged.withColumnRenamed("_label", "_root")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``_node, _label`` after more links."""
    if labels is not None:
        # Sums make columns of their own; unions of pinned tables with renamed columns fail in the optimizer.
        stars = labels.select((F.col("_label") + F.lit(0)).alias("_a"), (F.col("_node") + F.lit(0)).alias("_b"))
        links = links.select((F.col("_a") + F.lit(0)).alias("_a"), (F.col("_b") + F.lit(0)).alias("_b")).union(stars)
    return connected(links, "_a", "_b").select(F.col("node").alias("_node"), F.col("root").alias("_label"))


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """Component of each document under links of similar shingle sets.

    Returns one row per input row: ``doc_id, n_shingles, component_id``, the
    least id reachable.  Null and wordless texts have no shingles and are
    linked with nothing; fewer than ``width`` words are one shingle.  A null
    id is a component's id only if it has no other; repeated rows are linked
    like other copies.  An empty table gives an empty result, extra columns
    are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    rows = pin(
        texts.mapInArrow(lambda it: _measure(it, width), "doc_id long, n_shingles long, _print binary, _key long")
        .withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    )
    worded = rows.filter("_print is not null")
    one_class = ["_print", "_key", "n_shingles"]
    classes = (
        worded.groupBy(*one_class, "_salt").agg(F.min("doc_id").alias("_least"))
        .groupBy(*one_class).agg(F.min("_least").alias("_least"))
    )
    shingles = worded.agg(F.sum("n_shingles")).first()[0] or 0
    nodes = _nodes(texts, classes, shingles, width, percent)
    grouped = _components(_listed(nodes, percent), percent)
    named = nodes.select("_node", "_print", "_least").join(grouped, "_node", "left").withColumn(
        "_root", F.coalesce("_root", "_node")
    )
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    # The least set of a component is its root; its members meet the root's row spread by salt.
    named = named.withColumn("_salt", F.pmod("_node", F.lit(SALTS)))
    linked = salted_lookup(named, least, ["_root"], "_salt").select("_print", "component_id")
    values = classes.join(linked, "_print", "left").select(
        "_print", F.coalesce("component_id", "_least").alias("component_id")
    )
    names = ["doc_id", "n_shingles", "component_id"]
    found = salted_lookup(worded, values, ["_print"], "_salt").select(*names)
    bare = rows.filter("_print is null").withColumn("component_id", F.col("doc_id"))
    return found.unionByName(bare.select(*names))
