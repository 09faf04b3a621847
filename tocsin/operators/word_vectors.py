"""Message vectors learnt from which words stand near each other.

Words of a bounded vocabulary are counted with their neighbours.  The counts
become positive pointwise mutual information, of which the leading singular
directions are the word vectors: words that are used in the same places lie
close.  A message is the mean of its words, where frequent words weigh less.

The matrix stays a distributed table of rows; what meets on the driver is one
short row for each word of the vocabulary, whose size is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin import config as C
from tocsin.functions.batches import PART_VALUES, bounds, list_sizes
from tocsin.functions.text import find_all
from tocsin.runtime import materialise

#: Words in the vocabulary, the most frequent ones.
VOCABULARY = 8_192
#: Length of the vectors.
SIZE = 64
#: Words to either side that count as near.
NEAR = 4
#: Rounds of subspace iteration, and how many more directions it follows than are kept.
ROUNDS, SPARE = 4, 10
#: A word of this share of all words weighs half as much as a rare one.
HALF_WEIGHT = 1e-3


def words_of(text: Column) -> Column:
    return find_all(F.lower(text), f"{C.WORD}+")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if one of them is zero."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


@dataclass(frozen=True)
class WordVectors:
    """A weighted vector for each word of the vocabulary; ``vocabulary x size`` numbers."""

    words: list[str]
    vectors: np.ndarray

    def embed(self, df: DataFrame, text_col: str = "cleaned_text", name: str = "vector") -> DataFrame:
        """Add unit vectors of the whole texts; a projection, also on a stream.

        Null texts and texts without a known word have the zero vector, which
        is similar to nothing.
        """
        shared = df.sparkSession.sparkContext.broadcast((self.words, self.vectors))

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def vector(words: pa.Array) -> pa.Array:
            known, vectors = shared.value
            return _mean_vectors(words, pa.array(known, pa.string()), vectors)

        return df.withColumn(name, vector(words_of(F.coalesce(F.col(text_col), F.lit("")))))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = pa.table({"pos": np.arange(len(self.words)), "word": self.words, "vector": list(self.vectors)})
        spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> WordVectors:
        rows = spark.read.parquet(path).orderBy("pos").toArrow()
        return cls(rows["word"].to_pylist(), np.array(rows["vector"].to_pylist()))


def _mean_vectors(words: pa.Array, known: pa.Array, vectors: np.ndarray) -> pa.Array:
    """Unit sums of the vectors of each list's words."""
    sums = np.zeros((len(words), vectors.shape[1]))
    for low, high in bounds(list_sizes(words), PART_VALUES):
        sums[low:high] = _sums(words[low:high], known, vectors)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)
    offsets = np.arange(0, unit.size + 1, vectors.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))


def _sums(words: pa.Array, known: pa.Array, vectors: np.ndarray) -> np.ndarray:
    rows, size = len(words), vectors.shape[1]
    lengths = np.diff(words.offsets.to_numpy())
    at = pc.fill_null(pc.index_in(words.flatten(), value_set=known), -1).to_numpy()
    owner = np.repeat(np.arange(rows), lengths)[at >= 0]
    at = at[at >= 0].astype(np.int64)
    # Counts of each row's different words, so that long texts need no row of the matrix for each word.
    cells, counts = np.unique(owner * max(1, len(known)) + at, return_counts=True)
    sums = np.zeros((rows, size))
    for low in range(0, len(cells), 1 << 16):
        part = cells[low : low + (1 << 16)]
        np.add.at(sums, part // len(known), vectors[part % len(known)] * counts[low : low + (1 << 16), None])
    return sums


def _neighbours(batches: Iterator[pa.RecordBatch], known: list[str], near: int, pieces: int) -> Iterator[pa.RecordBatch]:
    """``a, b, n`` for words of the vocabulary at most ``near`` words apart, summed over a piece of the input."""
    names, size = pa.array(known, pa.string()), len(known)
    kept = np.empty(0, np.int64), np.empty(0, np.int64)

    def packed(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array((cells // size).astype(np.int32)), pa.array((cells % size).astype(np.int32)), pa.array(counts)], ["a", "b", "n"]
        )

    parts = (b.column(0)[low:high] for b in batches for low, high in bounds(list_sizes(b.column(0)), PART_VALUES))
    for lists in parts:
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        found = [kept[0]]
        weights = [kept[1]]
        for gap in range(1, near + 1):
            a, b = at[:-gap], at[gap:]
            both = (a >= 0) & (b >= 0) & (owner[:-gap] == owner[gap:])
            cells, counts = np.unique(np.r_[a[both] * size + b[both], b[both] * size + a[both]], return_counts=True)
            found.append(cells)
            weights.append(counts)
        cells, where = np.unique(np.concatenate(found), return_inverse=True)
        counts = np.bincount(where, np.concatenate(weights), len(cells)).astype(np.int64)
        if len(cells) > pieces:
            yield packed(cells, counts)
            kept = np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            kept = cells, counts
    if len(kept[0]):
        yield packed(*kept)


def _product(batches: Iterator[pa.RecordBatch], basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``a`` and its row of the matrix times ``basis``."""
    for batch in batches:
        lists, values = batch.column("b"), batch.column("x")
        lengths = np.diff(lists.offsets.to_numpy())
        columns, x = lists.flatten().to_numpy(), values.flatten().to_numpy()
        starts = np.r_[0, np.cumsum(lengths)]
        rows = np.empty((batch.num_rows, basis.shape[1]))
        for i in range(batch.num_rows):
            part = slice(starts[i], starts[i + 1])
            rows[i] = x[part] @ basis[columns[part]]
        offsets = np.arange(0, rows.size + 1, basis.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))], ["a", "row"]
        )


def _times(matrix: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The matrix times ``basis``: one row of its width for each word comes back."""
    shared = matrix.sparkSession.sparkContext.broadcast(basis)
    rows = matrix.mapInArrow(lambda it: _product(it, shared.value), "a int, row array<double>").toArrow()
    shared.destroy()
    found = np.zeros(basis.shape)
    if rows.num_rows:
        found[rows["a"].to_numpy()] = np.array(rows["row"].combine_chunks().flatten()).reshape(rows.num_rows, -1)
    return found


def _information(pairs: DataFrame, smooth: float) -> DataFrame:
    """Positive pointwise mutual information as rows ``a, b, x``, columns by position.

    Contexts are weighted by their counts to the power ``smooth``, which
    keeps rare ones from standing out.
    """
    sums = pairs.groupBy("b").agg(F.sum("n").alias("m"))  # one row for each word
    powers = sums.select("b", F.pow("m", F.lit(smooth)).alias("w"))
    total = powers.agg(F.sum("w")).first()[0] or 1.0
    rows = pairs.join(sums.select(F.col("b").alias("a"), F.col("m").alias("ma")), "a").join(powers, "b")
    x = F.log(F.col("n") / F.col("ma") / (F.col("w") / F.lit(total)))
    near = rows.select("a", "b", x.alias("x")).where("x > 0")
    packed = near.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "x"))).alias("_c"))
    return packed.select("a", F.col("_c.b").alias("b"), F.col("_c.x").alias("x"))


def learn_word_vectors(
    df: DataFrame,
    *,
    text_col: str = "cleaned_text",
    vocabulary: int = VOCABULARY,
    size: int = SIZE,
    near: int = NEAR,
    smooth: float = 0.75,
    half_weight: float = HALF_WEIGHT,
    seed: int = 7,
) -> WordVectors:
    """Learn from all texts.  Vectors have ``size`` numbers, or the vocabulary's size if that is less.

    Of equally frequent words the first by name enter the vocabulary.  Words
    outside of it are skipped but keep their place, so nearness is as
    written.  Null and blank texts teach nothing; without words every
    message has the zero vector.
    """
    spark = df.sparkSession
    words = df.select(words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    counted = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted, "word_counts")
    chosen = counted.orderBy(F.desc("n"), "word").limit(vocabulary).collect()
    if not chosen:
        return WordVectors([], np.zeros((0, size)))
    known, total = [r.word for r in chosen], counted.agg(F.sum("n")).first()[0]
    shared = spark.sparkContext.broadcast(known)
    pairs = words.mapInArrow(lambda it: _neighbours(it, shared.value, near, 1 << 20), "a int, b int, n long")
    pairs = materialise(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "word_pairs")
    # At most vocabulary squared numbers, a row of at most vocabulary ones for each word.
    matrix = materialise(_information(pairs, smooth), "word_rows")
    directions = _leading(matrix, len(known), min(size, len(known)), seed)
    shares = np.array([r.n for r in chosen]) / total
    weights = half_weight / (half_weight + shares)
    shared.destroy()
    return WordVectors(known, directions * weights[:, None])


def _leading(matrix: DataFrame, words: int, size: int, seed: int) -> np.ndarray:
    """Left singular vectors times the roots of their values, signs fixed.

    The matrix is not symmetric once contexts are smoothed, so its rows are
    also kept the other way round.
    """
    entries = matrix.select("a", F.explode(F.arrays_zip("b", "x")).alias("_e")).select("a", "_e.b", "_e.x")
    turned = entries.groupBy(F.col("b").alias("_at")).agg(F.array_sort(F.collect_list(F.struct("a", "x"))).alias("_c"))
    turned = materialise(turned.select(F.col("_at").alias("a"), F.col("_c.a").alias("b"), F.col("_c.x").alias("x")), "word_columns")
    wide = min(words, size + SPARE)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(words, wide)))[0]
    for _ in range(ROUNDS):
        left = np.linalg.qr(_times(matrix, basis))[0]
        basis = np.linalg.qr(_times(turned, left))[0]
    left, values, _ = np.linalg.svd(_times(matrix, basis), full_matrices=False)
    left, values = left[:, :size], values[:size]
    left = left * np.where(left[abs(left).argmax(0), np.arange(left.shape[1])] < 0, -1.0, 1.0)
    return left * np.sqrt(values)
