"""Message vectors and scores against label vectors.

A message vector comes in one of three shapes: a list of floats (an embedding
supplied by the caller), a list of 32-bit codes (hashed words, made here, one
for each word and pair of the text), or a list of 64-bit counts, which is what
codes are folded into before they are written or shuffled: its length does not
grow with the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin import config as C
from tocsin.functions.batches import PART_VALUES, bounds, list_sizes, text_sizes
from tocsin.functions.text import find_all

CODE_DIM = 256
#: Bytes of texts whose words are hashed at a time: larger parts leave the caches and are slower.
WORD_BYTES = 1 << 17


def fast_code(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def md5_code(term: Column, buckets: int) -> Column:
    """Slower, but other engines can compute it too."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 6), 16, 10).cast("int"), F.lit(buckets)).cast("int")


def word_codes(text: Column, code: Callable[[Column, int], Column] = fast_code) -> Column:
    """Codes of the words and word pairs of a text.

    Codes run over twice the vector width; the upper half counts negatively,
    so that unrelated long texts do not look alike by chance.
    """
    words = find_all(F.lower(text), f"{C.WORD}+")
    pairs = F.zip_with(
        words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    terms = F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))
    return F.transform(terms, lambda t: code(t, 2 * CODE_DIM))


def with_word_codes(
    df: DataFrame, text_col: str, name: str = "vector", code: Callable[[Column, int], Column] = fast_code
) -> DataFrame:
    return df.withColumn(name, word_codes(F.col(text_col), code))


def with_word_counts(df: DataFrame, text_col: str, name: str = "vector") -> DataFrame:
    """Add what ``with_word_codes`` adds, folded to counts at once.

    Spark makes words that single blanks part; tasks hash the bytes of all
    words and pairs of a part of a batch together.
    """
    other = f"[^{C.WORD[1:]}"
    words = F.regexp_replace(F.lower(text_col), f" {other}+|[{other}&&[^ ]]{other}*", " ")
    return df.withColumn(name, _word_counts(F.coalesce(words, F.lit(""))))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _word_counts(texts: pa.Array) -> pa.Array:
    counts = np.zeros((len(texts), CODE_DIM), np.int64)
    for low, high in bounds(np.maximum(text_sizes(texts), WORD_BYTES // CHUNK), WORD_BYTES):
        counts[low:high] = _hashed_words(texts[low:high])
    return _count_lists(counts, texts)


def _count_lists(counts: np.ndarray, given: pa.Array) -> pa.Array:
    """Rows of counts as lists, null where ``given`` is."""
    offsets = np.arange(0, counts.size + 1, CODE_DIM, dtype=np.int32)
    missing = given.is_null() if given.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel()), mask=missing)


def _hashed_words(texts: pa.Array) -> np.ndarray:
    """Signed counts of the words and word pairs of texts whose words single blanks part."""
    rows, width = len(texts), 2 * CODE_DIM
    raw = " ".join("" if t is None else t for t in texts.to_pylist()).encode()
    data = np.frombuffer(raw + bytes(8), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = data[: len(raw)] != ord(" ")
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    firsts = np.searchsorted(starts, np.cumsum(np.r_[0, text_sizes(texts) + 1]))
    owner = np.repeat(np.arange(rows), np.diff(firsts))
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    begins = np.concatenate([starts, starts[pairs]])
    hashes = xxhash64(data, begins, np.concatenate([ends, ends[pairs + 1]]) - begins)
    cells = np.concatenate([owner, owner[pairs]]) * width + (hashes % np.uint64(width)).astype(np.int64)
    counts = np.bincount(cells, minlength=rows * width).reshape(rows, width)
    return counts[:, :CODE_DIM] - counts[:, CODE_DIM:]


_PRIMES = tuple(np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many stretches of ``data``, as the SQL function of this name; eight bytes must follow the last stretch."""
    p1, p2, p3, p4, p5 = _PRIMES
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    four = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    at, left, seed = starts.copy(), sizes.copy(), np.uint64(seed)
    with np.errstate(over="ignore"):
        mixed = lambda lane, value: _rotated(lane + value * p2, 31) * p1
        hashes = np.full(len(at), seed + p5)
        long = np.flatnonzero(sizes >= 32)
        if len(long):
            lanes = [np.full(len(long), x) for x in (seed + p1 + p2, seed + p2, seed, seed - p1)]
            some = np.arange(len(long))
            while len(some := some[left[long[some]] >= 32]):
                which = long[some]
                for i, lane in enumerate(lanes):
                    lane[some] = mixed(lane[some], eight[at[which] + 8 * i])
                at[which] += 32
                left[which] -= 32
            merged = sum((_rotated(x, r) for x, r in zip(lanes[1:], (7, 12, 18), strict=True)), _rotated(lanes[0], 1))
            for lane in lanes:
                merged = (merged ^ mixed(np.uint64(0), lane)) * p1 + p4
            hashes[long] = merged
        hashes += sizes.astype(np.uint64)
        for _ in range(3):
            some = np.flatnonzero(left >= 8)
            hashes[some] = _rotated(hashes[some] ^ mixed(np.uint64(0), eight[at[some]]), 27) * p1 + p4
            at[some] += 8
            left[some] -= 8
        some = np.flatnonzero(left >= 4)
        hashes[some] = _rotated(hashes[some] ^ (four[at[some]].astype(np.uint64) * p1), 23) * p2 + p3
        at[some] += 4
        left[some] -= 4
        for i in range(3):
            some = np.flatnonzero(left > i)
            hashes[some] = _rotated(hashes[some] ^ (data[at[some] + i].astype(np.uint64) * p5), 11) * p1
        hashes = (hashes ^ (hashes >> np.uint64(33))) * p2
        hashes = (hashes ^ (hashes >> np.uint64(29))) * p3
        return hashes ^ (hashes >> np.uint64(32))


CHUNK = 1024


def to_matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows from a list column of codes, or the rows of a float column.

    Null gives zeros.  Codes are expanded a chunk of rows at a time, so that
    the counts by row stay small whatever the length of the texts.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if pa.types.is_int64(vectors.type.value_type):
        lengths, values = _flat(vectors)
        matrix = np.zeros((len(vectors), CODE_DIM))
        matrix[lengths == CODE_DIM] = values.reshape(-1, CODE_DIM)
        return _unit(matrix)
    if pa.types.is_integer(vectors.type.value_type):
        matrix = np.zeros((len(vectors), CODE_DIM))
        for low, high in _chunks(vectors):
            matrix[low:high] = _from_codes(vectors[low:high])
        return matrix
    lengths, values = _flat(vectors)
    width = max(int(lengths.max(initial=0)), 1)
    filled = lengths == width
    if not ((lengths == 0) | filled).all():
        raise ValueError("vectors of different length")
    matrix = np.zeros((len(vectors), width))
    matrix[filled] = values.reshape(-1, width)
    return matrix


def _chunks(vectors: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``CHUNK`` rows and, but for one longer row, ``PART_VALUES`` codes."""
    return bounds(np.maximum(list_sizes(vectors), PART_VALUES // CHUNK), PART_VALUES)


def _flat(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count:
        lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    return lengths, vectors.flatten().to_numpy(zero_copy_only=False)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _signed_counts(vectors: pa.ListArray) -> np.ndarray:
    lengths, values = _flat(vectors)
    rows, width = len(vectors), 2 * CODE_DIM
    owner = np.repeat(np.arange(rows), lengths)
    counts = np.bincount(owner * width + values, minlength=rows * width).reshape(rows, width)
    return counts[:, :CODE_DIM] - counts[:, CODE_DIM:]


def _from_codes(vectors: pa.ListArray) -> np.ndarray:
    return _unit(_signed_counts(vectors).astype(np.float64))


def folded(df: DataFrame, name: str = "vector") -> Column:
    """Codes as counts of fixed length; other vectors as they are."""
    if not isinstance(df.schema[name].dataType.elementType, T.IntegerType):
        return F.col(name)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def fold(vectors: pa.Array) -> pa.Array:
        counts = np.zeros((len(vectors), CODE_DIM), np.int64)
        for low, high in _chunks(vectors):
            counts[low:high] = _signed_counts(vectors[low:high])
        return _count_lists(counts, vectors)

    return fold(F.col(name))


def similarities(vector: Column, prototypes: np.ndarray) -> Column:
    """Dot products with a few label vectors, by label position."""
    labels = np.asarray(prototypes, dtype=np.float64).T.copy()

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(vectors: pa.Array) -> pa.Array:
        scores = to_matrix(vectors) @ labels
        offsets = np.arange(0, scores.size + 1, labels.shape[1], dtype=np.int32)
        missing = vectors.is_null() if vectors.null_count else None
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.ravel()), mask=missing)

    return score(vector)


def unit_vectors(codes: Column) -> Column:
    """Codes as unit vectors of doubles."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def expand(vectors: pa.Array) -> pa.Array:
        matrix = to_matrix(vectors)
        offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))

    return expand(codes)


def learn_prototypes(df: DataFrame, label_col: str, vector_col: str, labels: list) -> np.ndarray:
    """Unit mean vector of each label, rows in the order of ``labels``.

    The mean is a distributed aggregate; only one row per wanted label
    reaches the driver.
    """
    if isinstance(df.schema[vector_col].dataType.elementType, T.IntegralType):
        vector = unit_vectors(F.col(vector_col))
    else:
        vector = F.col(vector_col).cast("array<double>")
    means = (
        df.where(F.col(label_col).isin(list(labels)))
        .select(label_col, array_to_vector(vector).alias("_v"))
        .groupBy(label_col)
        .agg(Summarizer.mean(F.col("_v")).alias("mean"))
        .collect()
    )
    found = {row[label_col]: row["mean"].toArray() for row in means}
    missing = [label for label in labels if label not in found]
    if missing:
        raise ValueError(f"no rows for labels {missing}")
    matrix = np.array([found[label] for label in labels])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


__all__ = [
    "CODE_DIM", "fast_code", "folded", "learn_prototypes", "md5_code", "similarities", "to_matrix",
    "unit_vectors", "with_word_codes", "with_word_counts", "word_codes",
]
