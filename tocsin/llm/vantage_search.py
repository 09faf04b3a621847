"""Nearest neighbours by cosine with one vantage-point tree per shard.

Vectors are scaled to length one, so cosine falls as Euclidean distance
grows, and distances obey the triangle inequality.  Each shard's vectors form
a balanced tree: a node keeps one vector, the vantage point, and the ranges
of distances from it to its nearer and its farther half.  A query skips a
half whose range is too far from the query's own distance for anything
nearer than what it has.  That bound is multiplied by ``factor``: one is
exact, more skips more.

The index is a table with one row per shard.  A shard holds a bounded number
of vectors and queries come in blocks of bounded size, so a task's work does
not grow with the tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.common import pin

#: Vectors of one shard and queries of one block, about.
SHARD_ROWS = 8_192
BLOCK_ROWS = 1_024
LEAF = 48
#: More than rounding can change a distance by, in few dimensions; `Search` widens it for many.
SLACK = 1e-7

INDEX = "dim long, shard long, ids array<array<long>>, vectors binary, nodes binary"


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector, dim``: one row per id, without null, zero and non-finite vectors.

    Of vectors with one id the least counts.
    """
    cells = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    far = F.exists(cells, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = ~far & F.exists(cells, lambda x: x != 0)
    once = rows.select(F.col(id_col).cast("long").alias("vec_id"), cells.alias("vector")).filter(
        F.col("vec_id").isNotNull() & good
    )
    return once.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector").cast("long"))


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points and the nodes over it, each with its left child next to it.

    A node covers a stretch of the order; an inner node's first point is its
    vantage point, the nearer half follows, then the farther half.
    """
    order, nodes = np.arange(len(points)), []

    def grow(start: int, end: int) -> int:
        at = len(nodes)
        nodes.append([start, end, -1, 0.0, 0.0, 0.0, 0.0])
        if end - start <= leaf:
            return at
        part = order[start:end]
        # The point farthest from the first one is on the rim, where distances differ most.
        rim = int(np.argmin(points[part] @ points[part[0]]))
        part[[0, rim]] = part[[rim, 0]]
        away = distance(points[part[1:]] @ points[part[0]])
        by = np.argsort(away, kind="stable")
        order[start + 1 : end] = part[1:][by]
        away, half = away[by], (end - start) // 2
        nodes[at][3:] = away[0], away[half - 1], away[half], away[-1]
        grow(start + 1, start + 1 + half)
        nodes[at][2] = grow(start + 1 + half, end)
        return at

    if len(points):
        grow(0, len(points))
    return order, np.array(nodes, float).reshape(-1, 7)


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


class Search:
    """The ``k`` nearest points of one tree for a block of queries.

    Which of several equally far points are among them is chance; ``ties``
    has them all.
    """

    def __init__(self, points: np.ndarray, nodes: np.ndarray, queries: np.ndarray, k: int, factor: float) -> None:
        self.points, self.nodes, self.queries, self.factor = points, nodes, queries, factor
        self.k = min(k, max(1, len(points)))
        rounding = max(1, points.shape[1]) * np.finfo(float).eps  # of the square of a distance
        self.slack, self.square_slack = max(SLACK, 4 * np.sqrt(rounding)), 8 * rounding
        self.best = np.full((len(queries), self.k), np.inf)
        self.where = np.full((len(queries), self.k), -1)
        if len(nodes):
            everyone = np.arange(len(queries))
            self.walk(0, everyone, False)  # each down to one leaf, for a first bound
            self.bound = self.best[:, -1].copy()
            self.best[:], self.where[:] = np.inf, -1  # and found again by the full walk
            self.walk(0, everyone, True)

    def offer(self, who: np.ndarray, start: int, away: np.ndarray) -> None:
        """Merge the distances to points from ``start`` on into the nearest so far."""
        all_away = np.hstack([self.best[who], away])
        ids = np.broadcast_to(np.arange(start, start + away.shape[1]), away.shape)
        all_where = np.hstack([self.where[who], ids])
        by = np.argsort(all_away, axis=1, kind="stable")[:, : self.k]
        self.best[who] = np.take_along_axis(all_away, by, 1)
        self.where[who] = np.take_along_axis(all_where, by, 1)

    def walk(self, at: int, who: np.ndarray, full: bool) -> None:
        if not len(who):
            return
        start, end, right = (int(x) for x in self.nodes[at, :3])
        if right < 0:
            self.offer(who, start, distance(self.queries[who] @ self.points[start:end].T))
            return
        low_near, high_near, low_far, high_far = self.nodes[at, 3:]
        away = distance(self.queries[who] @ self.points[start])
        self.offer(who, start, away[:, None])
        nearer = away < (high_near + low_far) / 2
        if not full:
            self.walk(at + 1, who[nearer], False)
            self.walk(right, who[~nearer], False)
            return
        # Children are walked in one order for all queries, as the first walk has given good bounds.
        for child, low, high in ((at + 1, low_near, high_near), (right, low_far, high_far)):
            gap = np.maximum(np.maximum(low - away, away - high), 0)
            least = np.minimum(self.bound[who], self.best[who, -1])
            self.walk(child, who[gap * self.factor <= least + self.slack], True)

    def ties(self) -> list[np.ndarray]:
        """For each query every point as near as its ``k``-th one, but for rounding; there is no limit to their number."""
        who, where = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        last = self.best[:, -1]
        most = last * last + self.square_slack

        def take(asked: np.ndarray, start: int, away: np.ndarray) -> None:
            row, column = np.nonzero(away * away <= most[asked, None])
            who.append(asked[row].astype(np.int32))
            where.append((start + column).astype(np.int32))

        def walk(at: int, asked: np.ndarray) -> None:
            if not len(asked):
                return
            start, end, right = (int(x) for x in self.nodes[at, :3])
            if right < 0:
                take(asked, start, distance(self.queries[asked] @ self.points[start:end].T))
                return
            low_near, high_near, low_far, high_far = self.nodes[at, 3:]
            away = distance(self.queries[asked] @ self.points[start])
            take(asked, start, away[:, None])
            for child, low, high in ((at + 1, low_near, high_near), (right, low_far, high_far)):
                gap = np.maximum(np.maximum(low - away, away - high), 0)
                walk(child, asked[gap * self.factor <= last[asked] + self.slack])

        if len(self.nodes):
            walk(0, np.arange(len(self.queries)))
        owner, found = np.concatenate(who), np.concatenate(where)
        by = np.argsort(owner, kind="stable")
        return np.split(found[by], np.searchsorted(owner[by], np.arange(1, len(self.queries))))


def _index_shards(rows: pd.DataFrame) -> pd.DataFrame:
    """One index row of a shard; equal vectors are one point with all their ids."""
    vectors = np.stack(rows["vector"].to_numpy()).astype(float)
    points, which = np.unique(vectors, axis=0, return_inverse=True)
    ids = rows["vec_id"].to_numpy()
    by = np.lexsort((ids, which.ravel()))
    groups = np.split(ids[by], np.flatnonzero(np.diff(which.ravel()[by])) + 1)
    order, nodes = build_tree(scaled(points))
    return pd.DataFrame([{
        "dim": rows["dim"].iloc[0], "shard": rows["shard"].iloc[0], "ids": [groups[i].tolist() for i in order],
        "vectors": points[order].tobytes(), "nodes": nodes.tobytes(),
    }])


def scaled(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / top
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def build_index(rows: DataFrame, id_col: str, vector_col: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A table with one tree for each shard of the vectors of one length; all vectors are in it."""
    good = pin(usable_vectors(rows, id_col, vector_col))
    shards = max(1, -(-good.count() // shard_rows))
    placed = good.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return pin(placed.groupBy("dim", "shard").applyInPandas(_index_shards, INDEX))


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each sum in the same order, so equal vectors have equal results."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    dot, aa, bb = (a * b).cumsum(1)[:, -1], (a * a).cumsum(1)[:, -1], (b * b).cumsum(1)[:, -1]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def _search_block(index: pd.DataFrame, block: pd.DataFrame, k: int, factor: float) -> pd.DataFrame:
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(index) and len(block):
        row, dim = index.iloc[0], int(index["dim"].iloc[0])
        vectors = np.frombuffer(row["vectors"]).reshape(-1, dim)
        nodes = np.frombuffer(row["nodes"]).reshape(-1, 7)
        queries, asked = np.stack(block["vector"].to_numpy()).astype(float), block["vec_id"].to_numpy()
        least_ids = np.array([ids[0] for ids in row["ids"]])
        # One more point than asked for, as one may be the query alone, and all that tie with the last.
        for i, places in enumerate(Search(scaled(vectors), nodes, scaled(queries), k + 1, factor).ties()):
            scores = exact_cosines(np.repeat(queries[i : i + 1], len(places), 0), vectors[places])
            # An id of a later point has one smaller or nearer id at least in each of these.
            first = np.lexsort((least_ids[places], -scores))[: k + 1]
            places, scores = places[first], scores[first]
            ids = [(j, s) for p, s in zip(places, scores, strict=True) for j in row["ids"][p][: k + 1] if j != asked[i]]
            for j, s in sorted(ids, key=lambda x: (-x[1], x[0]))[:k]:
                out["query_id"].append(asked[i])
                out["vec_id"].append(j)
                out["score"].append(s)
    return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _fresh(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, as both sides of a cogroup come from the index."""
    return df.toDF(*df.columns).select(*[F.coalesce(c, c).alias(c) for c in df.columns])


def search(index: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0) -> DataFrame:
    """The ``k`` nearest others of each query: ``query_id, rank, vec_id, score``.

    ``queries`` are rows of ``usable_vectors``.  Every block of queries meets
    every shard of its vectors' length.  Ties go to the smaller id; fewer
    candidates than ``k`` are all returned; empty tables give an empty result.
    """
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)))
    shards = index.select(F.col("dim").alias("of_dim"), F.col("shard").alias("of_shard"))
    asked = dealt.join(shards, F.col("dim") == F.col("of_dim")).select(
        F.col("of_dim").alias("dim"), F.col("of_shard").alias("shard"), F.col("block").alias("of_block"), "vec_id", "vector"
    ).withColumnRenamed("of_block", "block")
    offered = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["dim", "shard", "block"]
    found = _fresh(offered).groupBy(*keys).cogroup(_fresh(asked).groupBy(*keys)).applyInPandas(
        lambda a, b: _search_block(a, b, k, factor), "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(
    rows: DataFrame, every: int, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Search for the rows whose id is divisible by ``every`` among all rows."""
    index = build_index(rows, id_col, vector_col)
    queries = usable_vectors(rows.filter(F.col(id_col) % every == 0), id_col, vector_col)
    return search(index, pin(queries), k, factor)
