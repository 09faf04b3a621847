"""Language of a message from character trigrams.

The model is learnt from a table of labelled texts.  Trigrams are hashed into
a fixed number of buckets, and only what a language has seen is kept, as a
sparse table of fixed-point weights with a bound on its bytes.  So hundreds of
languages fit into a few MB however much text there was, and scoring is a
projection that needs neither a join nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.functions.batches import PART_VALUES, bounds, text_sizes
from tocsin.functions.text import is_blank

#: A power of two.
BUCKETS = 1 << 15
METHOD = "trigram"
#: Weights are natural logarithms in steps of 1 / SCALE.
SCALE = 1024
#: Bytes of an entry: a column number and a weight of two bytes each.
ENTRY_BYTES = 4
#: The sparse table is never larger; each language has an equal share of it.
MAX_BYTES = 16 << 20
#: With a smaller share a language could not be told from others.
LEAST_ENTRIES = 128
#: What counts as a label, once trimmed, lower-cased and cut at its first - or _.
LABEL = "[a-z]{2,3}"
#: Scores of one step of the scoring loop, and entries that it expands, about.
STEP = 1 << 20
#: With so few languages a text is scored by a dense table, one language after the other.
DENSE_LANGUAGES = 16
#: Counters of languages and buckets that a task holds at a time; with more languages parts are sorted instead.
MOST_CELLS = 1 << 20


def trigram_line(text: Column) -> Column:
    """The lower-cased, space-padded text whose trigrams are counted; null for blank text."""
    lowered = F.when(~is_blank(text), F.lower(text))
    return F.concat(F.lit(" "), F.trim(F.replace(lowered, F.lit("\n"), F.lit(" "))), F.lit(" "))


def trigram_codes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all trigrams of the lines, one line after another, and how many each line has.

    A code is computed from three neighbouring code points, so no trigram is
    ever cut out as a string.
    """
    texts = ["" if line is None else line for line in lines.to_pylist()]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    codes = (points[:-2] * 961 + points[1:-1] * 31 + points[2:]) & np.uint32(BUCKETS - 1)
    # None begins at the last two characters of a line.
    begins = np.ones(len(points), bool)
    ends = np.cumsum(sizes)[sizes > 0]
    begins[ends - 1] = False
    begins[np.maximum(ends - 2, 0)] = False
    return codes[begins[: len(codes)]].astype(np.int64), np.maximum(sizes - 2, 0)


@dataclass(frozen=True)
class LanguageModel:
    """For each bucket the languages that know it and how much more likely it is than an unseen one.

    The entries of bucket ``b`` are ``starts[b]`` to ``starts[b + 1]``.  A
    text's score in a language is its prior, plus ``floor`` for each trigram,
    plus the weights of those that the language knows.
    """

    languages: tuple[str, ...]
    log_prior: np.ndarray
    floor: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray

    @property
    def nbytes(self) -> int:
        arrays = (self.log_prior, self.floor, self.starts, self.columns, self.weights)
        return sum(x.nbytes for x in arrays)

    @cached_property
    def dense(self) -> np.ndarray:
        """One row of weights by bucket for each language."""
        table = np.zeros((len(self.languages), BUCKETS))
        table[self.columns, np.repeat(np.arange(BUCKETS), np.diff(self.starts))] = self.weights
        return table

    def scores(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One row for each text, one column for each language; ``codes`` holds the texts one after another."""
        width = len(self.languages)
        scores = self.log_prior + lengths[:, None] * self.floor
        if width <= DENSE_LANGUAGES:
            some = np.flatnonzero(lengths)
            starts = np.cumsum(lengths)[some] - lengths[some]
            for i, weights in enumerate(self.dense if len(some) else ()):
                scores[some, i] += np.add.reduceat(weights[codes], starts) / SCALE
            return scores
        owner = np.repeat(np.arange(len(lengths)), lengths)
        counts = np.diff(self.starts)
        known = counts[codes]
        ends = np.cumsum(known)
        low = 0
        while low < len(codes):
            # A step is bounded by its entries and by the texts that it touches.
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + STEP, "right")))
            first = owner[low]
            high = min(high, max(low + 1, int(np.searchsorted(owner, first + max(1, STEP // width), "left"))))
            size = known[low:high]
            shift = self.starts[codes[low:high]] - (np.cumsum(size) - size)
            at = np.arange(size.sum()) + np.repeat(shift, size)
            cell = np.repeat(owner[low:high] - first, size) * width + self.columns[at]
            rows = owner[high - 1] - first + 1
            found = np.bincount(cell, self.weights[at], rows * width).reshape(rows, width)
            scores[first : first + rows] += found / SCALE
            low = high
        return scores


def clean_label(label: Column) -> Column:
    """The language a label names: ``EN``, ``en-GB`` and `` en_us`` all mean ``en``.

    Null if what is left is not a code of two or three letters, or is ``und``.
    """
    code = F.lower(F.regexp_extract(F.trim(label), "^([^-_]*)", 1))
    return F.when(code.rlike(f"^{LABEL}$") & (code != "und"), code)


def train_language_model(
    df: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    max_bytes: int = MAX_BYTES,
) -> LanguageModel:
    """Count trigram buckets by language, with add-one smoothing.

    Labels are read by ``clean_label``; rows without one teach nothing, so
    junk in the label column makes no languages.  Tasks add up
    those of a batch, so no trigram is a row of its own, and of each language
    the driver gets at most its share of ``max_bytes``.
    """
    known = df.select(clean_label(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"))
    known = known.where(F.col("lang").isNotNull() & ~is_blank(F.col("text")))
    lines = known.select("lang", trigram_line(F.col("text")).alias("line"))
    counts = lines.mapInArrow(_counted, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return model_from_counts(counts, known.groupBy("lang").agg(F.count("*").alias("n")), max_bytes=max_bytes)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams in ``lang, line`` as ``lang, code, n``, added up within a batch."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        size = len(langs.dictionary) * BUCKETS
        total = np.zeros(size if size <= MOST_CELLS else 0, np.int64)
        for low, high in bounds(text_sizes(batch.column("line")), PART_VALUES):
            codes, sizes = trigram_codes(batch.column("line")[low:high])
            cells = np.repeat(langs.indices[low:high].to_numpy().astype(np.int64), sizes) * BUCKETS + codes
            if size <= MOST_CELLS:
                total += np.bincount(cells, minlength=size)
            else:
                yield _count_rows(langs.dictionary, *np.unique(cells, return_counts=True))
        if size <= MOST_CELLS:
            cells = np.flatnonzero(total)
            yield _count_rows(langs.dictionary, cells, total[cells])


def _count_rows(names: pa.Array, cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    columns = [names.take(pa.array(cells // BUCKETS)), pa.array((cells % BUCKETS).astype(np.int32)), pa.array(counts)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "code", "n"])


def model_from_counts(counts: DataFrame, texts: DataFrame, *, max_bytes: int = MAX_BYTES) -> LanguageModel:
    """Model from tables ``(lang, code, n)`` and ``(lang, n)``.

    Of a language with more buckets than its share the most frequent stay,
    which are those that lift its scores most; ties go to the smaller code.
    """
    totals = {row["lang"]: row["n"] for row in texts.collect()}
    languages = tuple(sorted(totals))
    share = min(BUCKETS, max_bytes // (ENTRY_BYTES * max(1, len(languages))))
    if share < LEAST_ENTRIES:
        raise ValueError(f"{len(languages)} languages do not fit into {max_bytes} bytes")
    by_lang = Window.partitionBy("lang")
    ranked = counts.select(
        "lang", F.col("code").cast("int").alias("code"), "n",
        F.row_number().over(by_lang.orderBy(F.desc("n"), "code")).alias("rank"),
        F.sum("n").over(by_lang).alias("total"),
    )
    weight = F.round(F.log(F.col("n") + 1) * SCALE).cast("int")
    table = ranked.where(F.col("rank") <= share).select("lang", "code", weight.alias("weight"), "total").toArrow()
    column = {lang: i for i, lang in enumerate(languages)}
    names = table["lang"].combine_chunks().dictionary_encode()
    columns = np.array([column[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    seen = np.zeros(len(languages))
    seen[columns] = table["total"].to_numpy()
    prior = np.array([totals[lang] for lang in languages], dtype=np.float64)
    return _packed(
        languages, np.log(prior / prior.sum()), -np.log(seen + BUCKETS),
        table["code"].to_numpy(), columns, table["weight"].to_numpy(),
    )


def _packed(
    languages: tuple[str, ...], log_prior: np.ndarray, floor: np.ndarray,
    codes: np.ndarray, columns: np.ndarray, weights: np.ndarray,
) -> LanguageModel:
    order = np.lexsort((columns, codes))
    starts = np.searchsorted(codes[order], np.arange(BUCKETS + 1)).astype(np.int64)
    return LanguageModel(
        languages, log_prior, floor, starts, columns[order].astype(np.uint16), weights[order].astype(np.uint16)
    )


def save_language_model(model: LanguageModel, spark: SparkSession, path: str) -> None:
    """One row for each language with the buckets it knows and their weights."""
    code = np.repeat(np.arange(BUCKETS), np.diff(model.starts))
    rows = []
    for i, lang in enumerate(model.languages):
        at = np.flatnonzero(model.columns == i)
        rows.append((lang, float(model.log_prior[i]), float(model.floor[i]), code[at].tolist(), model.weights[at].tolist()))
    spark.createDataFrame(
        rows, "lang string, log_prior double, floor double, codes array<int>, weights array<int>"
    ).write.mode("overwrite").parquet(path)


def load_language_model(spark: SparkSession, path: str) -> LanguageModel:
    rows = spark.read.parquet(path).orderBy("lang").collect()
    sizes = [len(r["codes"]) for r in rows]
    return _packed(
        tuple(r["lang"] for r in rows), np.array([r["log_prior"] for r in rows]), np.array([r["floor"] for r in rows]),
        np.array([c for r in rows for c in r["codes"]], np.int64), np.repeat(np.arange(len(rows)), sizes),
        np.array([w for r in rows for w in r["weights"]], np.int64),
    )


def language_scores(lines: Column, model: LanguageModel) -> Column:
    """Best language of each ``trigram_line`` and its probability as a struct; null without evidence or without any language."""
    handle = SparkSession.active().sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("code", T.StringType()), T.StructField("share", T.DoubleType())])

    @F.arrow_udf(kind)
    def best(lines: pa.Array) -> pa.Array:
        model = handle.value
        names = np.array(model.languages, dtype=object)
        if not len(names) or not len(lines):
            return pa.nulls(len(lines), pa.struct([("code", pa.string()), ("share", pa.float64())]))
        top, shares, found = np.zeros(len(lines), np.int64), np.zeros(len(lines)), np.zeros(len(lines), bool)
        # About as many characters as values are worked on at a time.
        least = max(1, PART_VALUES * len(names) // STEP)
        for low, high in bounds(np.maximum(text_sizes(lines), least), PART_VALUES):
            part = slice(low, high)
            codes, lengths = trigram_codes(lines[part])
            scores = model.scores(codes, lengths)
            found[part] = lengths > 0
            top[part] = scores.argmax(axis=1)
            shares[part] = 1.0 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(names[top], pa.string()), pa.array(shares)], names=["code", "share"], mask=pa.array(~found)
        )

    return best(lines)


def detect_language(df: DataFrame, model: LanguageModel, *, text_col: str = "cleaned_text") -> DataFrame:
    """Add ``lang_code``, ``lang_confidence`` and ``lang_method``.

    Blank text is ``und`` by method ``none``; text the model cannot judge is
    ``und`` by method ``failed``.
    """
    staged = df.withColumn("_best", language_scores(trigram_line(F.col(text_col)), model)).withColumn(
        "_blank", is_blank(F.col(text_col))
    )
    found = F.col("_best").isNotNull()
    return staged.select(
        *df.columns,
        F.when(found, F.col("_best.code")).otherwise("und").alias("lang_code"),
        F.when(found, F.round("_best.share", 4)).otherwise(0.0).alias("lang_confidence"),
        F.when(found, METHOD).when(F.col("_blank"), "none").otherwise("failed").alias("lang_method"),
    )
