"""A sparse logistic model fitted by mini-batches, with the state of every epoch kept.

An epoch is one pass of several workers over a table of sparse rows in a fresh
order.  Each worker takes steps of its own from the shared weights; their
changes are averaged, coordinate by coordinate, over the workers that met the
coordinate.  What an epoch leaves is a table, so a run that was stopped goes
on after its last whole epoch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a step.
BATCH = 16
#: Workers of an epoch, whatever the number of rows.
WORKERS = 8
STATE = "code int, weight double, square double"
MEASURES = ("loss", "rows", "tp", "fp", "fn", "tn")


@dataclass(frozen=True)
class Epoch:
    """Weights (the last one is the intercept), squared gradients so far, and how the epoch did on the held-out rows."""

    number: int
    weights: np.ndarray
    squares: np.ndarray
    measured: dict[str, float]

    @property
    def loss(self) -> float:
        return self.measured["loss"] / max(1.0, self.measured["rows"])


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and values of all rows, one after another, the rows they belong to, and the targets."""
    features = batch.column("features")
    codes, values = features.field("indices"), features.field("values")
    lengths = np.diff(codes.offsets.to_numpy())
    return (
        codes.flatten().to_numpy(), values.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lengths),
        batch.column("target").to_numpy(),
    )


def _margins(codes: np.ndarray, values: np.ndarray, owner: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(owner, values * weights[codes], rows) + weights[-1]


def _steps(
    batches: Iterator[pa.RecordBatch], start: np.ndarray, squares: np.ndarray, rate: float, penalty: float
) -> Iterator[pa.RecordBatch]:
    """One worker's part of an epoch: ``code, change, added`` of the coordinates that it met."""
    weights, sums = start.copy(), squares.copy()
    for batch in batches:
        codes, values, owner, target = _sparse(batch)
        for low in range(0, batch.num_rows, BATCH):
            rows = min(BATCH, batch.num_rows - low)
            begin, end = np.searchsorted(owner, [low, low + rows])
            at, x, own = codes[begin:end], values[begin:end], owner[begin:end] - low
            wrong = 1 / (1 + np.exp(-np.clip(_margins(at, x, own, rows, weights), -30, 30))) - target[low : low + rows]
            met, where = np.unique(at, return_inverse=True)
            slope = np.bincount(where, x * wrong[own], len(met)) / rows + penalty * weights[met]
            # The intercept is a coordinate that all rows have, without penalty.
            met, slope = np.append(met, len(weights) - 1), np.append(slope, wrong.mean())
            sums[met] += slope**2
            weights[met] -= rate * slope / (np.sqrt(sums[met]) + 1e-8)
    moved = np.flatnonzero(sums != squares)
    yield pa.RecordBatch.from_arrays(
        [pa.array(moved.astype(np.int32)), pa.array(weights[moved] - start[moved]), pa.array(sums[moved] - squares[moved])],
        ["code", "change", "added"],
    )


def _measured(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, values, owner, target = _sparse(batch)
        margins, gold = _margins(codes, values, owner, batch.num_rows, weights), target > 0.5
        loss = np.logaddexp(0, np.where(gold, -margins, margins)).sum()
        said = margins > 0
        counts = (batch.num_rows, (said & gold).sum(), (said & ~gold).sum(), (~said & gold).sum(), (~said & ~gold).sum())
        yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in (loss, *counts)], list(MEASURES))


def measure(rows: DataFrame, weights: np.ndarray) -> dict[str, float]:
    """Summed log loss and confusion counts of ``features, target``; all zero for no rows."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    parts = rows.mapInArrow(lambda it: _measured(it, shared.value), ", ".join(f"{x} double" for x in MEASURES))
    found = parts.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in MEASURES]).first().asDict()
    shared.destroy()
    return found


def _pass(rows: DataFrame, last: Epoch, rate: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    shared = rows.sparkSession.sparkContext.broadcast((last.weights, last.squares))
    turn = F.xxhash64("place", F.lit(last.number))
    dealt = rows.withColumn("_turn", turn).repartition(WORKERS, "_turn").sortWithinPartitions("_turn")
    changes = dealt.select("features", "target").mapInArrow(
        lambda it: _steps(it, *shared.value, rate, penalty), "code int, change double, added double"
    )
    # At most one row for each weight.
    merged = changes.groupBy("code").agg(F.avg("change").alias("change"), F.avg("added").alias("added")).toArrow()
    shared.destroy()
    weights, squares = last.weights.copy(), last.squares.copy()
    at = merged["code"].to_numpy()
    weights[at] += merged["change"].to_numpy()
    squares[at] += merged["added"].to_numpy()
    return weights, squares


def _save(epoch: Epoch, spark, path: str) -> None:
    """Weights that are not zero, and the measures under negative codes, as one file that is there whole or not at all."""
    at = np.flatnonzero(epoch.squares)
    codes = np.r_[-1 - np.arange(len(MEASURES)), at].astype(np.int32)
    table = pa.table({
        "code": codes, "weight": np.r_[[epoch.measured[x] for x in MEASURES], epoch.weights[at]],
        "square": np.r_[np.zeros(len(MEASURES)), epoch.squares[at]],
    })
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(path)


def _load(spark, path: str, number: int, size: int) -> Epoch | None:
    try:
        table = spark.read.schema(STATE).parquet(path).toArrow()
    except AnalysisException:
        return None
    code, weight, square = (table[x].to_numpy() for x in ("code", "weight", "square"))
    if not (code < 0).any():
        return None
    weights, squares = np.zeros(size), np.zeros(size)
    kept = code >= 0
    weights[code[kept]], squares[code[kept]] = weight[kept], square[kept]
    measured = {MEASURES[-1 - c]: float(x) for c, x in zip(code[~kept].tolist(), weight[~kept], strict=True)}
    return Epoch(number, weights, squares, measured)


def run_epochs(
    rows: DataFrame,
    held_out: DataFrame,
    folder: str,
    *,
    size: int,
    epochs: int,
    patience: int,
    rate: float,
    penalty: float,
) -> list[Epoch]:
    """All epochs up to the last one that was run, each without its squares but for the last.

    ``rows`` has ``features`` (sparse, of ``size`` places), ``target`` and a
    random but fixed ``place``.  It stops when ``patience`` epochs have not
    lowered the loss on ``held_out``.  Epochs found in ``folder`` are not run
    again, so it must hold those of the same rows and settings only.
    """
    spark = rows.sparkSession
    last = Epoch(0, np.zeros(size + 1), np.zeros(size + 1), {})
    done: list[Epoch] = []
    for number in range(1, epochs + 1):
        path = f"{folder}/epoch={number}"
        found = _load(spark, path, number, size + 1)
        if found is None:
            weights, squares = _pass(rows, last, rate, penalty)
            found = Epoch(number, weights, squares, measure(held_out, weights))
            _save(found, spark, path)
        last = found
        done.append(found)
        best = min(done, key=lambda e: e.loss)
        if number - best.number >= patience:
            break
    return done
