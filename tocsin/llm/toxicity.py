"""Toxicity scores from FTRL-proximal logistic regression over hashed word features.

Features are words, neighbouring pairs and pairs with one word between, as
codes folded into a fixed number of places; each counts once a text.  FTRL
keeps two sums for each place, learns at a rate of its own for each, and L1
leaves most weights at zero, so the weights are small enough to broadcast.

Features are made on all executors.  The learner itself passes over the
labelled rows, whose number is bounded, in a fixed order, a part at a time: a
part is a small job that starts from the sums so far, so no task holds more
than its part and a lost one is run again.  The order and the number of parts
do not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import id_remainder, pin
from tocsin.llm.words import MULTIPLIER, NOT_ALNUM, mix, word_codes

PLACES = 1 << 18
#: The model is fitted on at most so many labelled rows, those with the least hash of the id.
SAMPLE_ROWS = 40_000
#: Parts that the labelled rows are dealt to, whatever their number.
PARTS = 4
#: Features of fewer texts of the whole sample would only learn those texts by heart.
LEAST_TEXTS = 5
PASSES = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
PREDICTED = 0.7


def feature_places(text: str | None) -> np.ndarray:
    """Places of all words, pairs and skip-pairs of the text, with repeats."""
    words = word_codes((text or "").lower().encode("utf-8", "replace"), NOT_ALNUM)
    pairs = mix(words[:-1] * MULTIPLIER + words[1:])
    skips = mix(words[:-2] * MULTIPLIER + mix(words[2:]))
    return (np.concatenate([words, pairs, skips]) & np.uint64(PLACES - 1)).astype(np.int64)


@dataclass
class Ftrl:
    """Sums of one logistic regression; place ``PLACES`` is the intercept."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls) -> Ftrl:
        return cls(np.zeros(PLACES + 1), np.zeros(PLACES + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        beyond = np.sign(z) * np.maximum(abs(z) - L1, 0)
        return -beyond / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, places: np.ndarray, label: float) -> None:
        at = np.append(places, PLACES)
        weights = self.weights(at)
        g = sigmoid(weights.sum()) - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - rate * weights
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Weights:
    """The weights that are not zero."""

    places: np.ndarray
    values: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        found = feature_places(text)
        if len(self.places):
            at = np.minimum(np.searchsorted(self.places, found), len(self.places) - 1)
            hits = np.unique(at[self.places[at] == found])
            return float(sigmoid(self.intercept + self.values[hits].sum()))
        return float(sigmoid(self.intercept))


def _feature_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each place's features are."""
    total = np.zeros(PLACES, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            total[np.unique(feature_places(text.as_py()))] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "texts"])


def _known_features(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(feature_places(text.as_py())) for text in batch.column("text")]
        found = [f[known[f]].astype(np.int32) for f in found]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate([*found, np.empty(0, np.int32)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("order"), batch.column("label"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            ["order", "label", "places"],
        )


def _learn_part(rows: pa.Table, start: Ftrl) -> pa.Table:
    """The sums of all places that the part's rows have, after one pass over them."""
    rows = rows.sort_by([("order", "ascending"), ("label", "ascending")])
    for places, label in zip(rows["places"], rows["label"].to_pylist(), strict=True):
        start.learn(places.values.to_numpy().astype(np.int64), label)
    at = np.unique(np.append(rows["places"].combine_chunks().flatten().to_numpy(), PLACES)).astype(np.int64)
    return pa.table({"place": at, "z": start.z[at], "n": start.n[at]})


def train(rows: DataFrame) -> Weights:
    """Fit on ``text, label, order``, a bounded number of rows.

    What comes back to the driver is two sums for each of at most ``PLACES``
    places.
    """
    context = rows.sparkSession.sparkContext
    counted = rows.select("text").mapInArrow(_feature_texts, "place long, texts long").groupBy("place")
    common = counted.agg(F.sum("texts").alias("texts")).filter(F.col("texts") >= LEAST_TEXTS).toPandas()
    known = np.zeros(PLACES, bool)
    known[common["place"]] = True
    table = context.broadcast(known)
    features = pin(
        rows.mapInArrow(lambda it: _known_features(it, table.value), "order long, label double, places array<int>")
        .withColumn("part", F.pmod(F.xxhash64("order"), F.lit(PARTS)))
    )
    state = Ftrl.empty()
    for step in range(PASSES * PARTS):
        shared = context.broadcast(state)
        part = features.filter(F.col("part") == step % PARTS)
        found = part.groupBy("part").applyInArrow(
            lambda rows: _learn_part(rows, Ftrl(shared.value.z.copy(), shared.value.n.copy())), "place long, z double, n double"
        ).toPandas()
        state = Ftrl(state.z.copy(), state.n.copy())
        state.z[found["place"]], state.n[found["place"]] = found["z"], found["n"]
        shared.destroy()
    table.destroy()
    weights = state.weights()
    places = np.flatnonzero(weights[:PLACES])
    return Weights(places, weights[places], float(weights[PLACES]))


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Labelled texts outside the held-out third: ``text, label, order``.

    An id with several labels counts as toxic if one says so; labels other
    than 0 and 1 are left out.  Of texts that share an id the least one is
    learnt, so the sample is bounded whatever repeats.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).filter(
        id_remainder(id_col, 3) != 1
    )
    once = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
    order = F.xxhash64(F.lit(3), F.col("_id"))
    # At most sample_rows rows of two numbers.
    chosen = once.withColumn("order", order).orderBy("order", "_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "label", "order").agg(F.min("text").alias("text"))
    return found.select("text", "label", "order")


def _score_rows(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = np.array([weights.score(text.as_py()) for text in batch.column("_text")], float)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= PREDICTED).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Score every text: ``doc_id, held_out, score, predicted``.

    Labels are learnt only from rows whose crc32 of the id as text leaves no
    remainder 1 by 3; those others are ``held_out``.  Null and empty texts
    have the score of the intercept alone; without labels all scores are one
    half.  Repeated rows are scored alike, extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        train(training_rows(docs, labels, id_col, text_col, label_col, sample_rows))
    )
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (id_remainder(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("_text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        lambda it: _score_rows(it, shared.value), f"doc_id {kind}, held_out boolean, score double, predicted int"
    )
