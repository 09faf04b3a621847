"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary classifier over
character n-grams says which of its two halves of the languages a text is
from.  The decoder adds up, for each codeword, the loss of all bits, weighted
by how reliable each bit is for that language, and chooses the codeword with
the least loss.  Texts whose two nearest codewords are about as near are
flagged as ambiguous.

N-grams are counted on bytes of the lower-cased text with everything in ASCII
that is no letter made one blank, in segments, so texts of any length are
used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import id_remainder
from tocsin.llm.words import SEGMENT, mix

ORDERS = (1, 2, 3, 4)
#: N-gram codes are folded into so many places, so the model's size is fixed.
PLACES = 1 << 15
#: More languages than this in the training rows are an error, not a longer model.
MAX_LANGUAGES = 256
#: Up to here every split of the languages in two is a bit.
EXHAUSTIVE = 6
#: About so many training rows tell how reliable the bits are.
CALIBRATION_ROWS = 20_000
#: A text is ambiguous if the nearest codeword's share is not above this much of the two nearest.
AMBIGUOUS = 0.55
UNDETERMINED = "und"

LETTERS = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def codewords(count: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 for each language.

    Few languages get all different splits; more get random bits, of several
    draws the one whose nearest two codewords are furthest apart.
    """
    if count <= 1:
        return np.ones((count, 1), np.int8)
    if count <= EXHAUSTIVE:
        splits = [s for s in product((1, -1), repeat=count - 1) if -1 in s]
        return np.array([(1, *s) for s in splits], np.int8).T
    rng, bits, best, most = np.random.default_rng(seed), int(10 * np.ceil(np.log2(count))), None, -1
    for _ in range(50):
        drawn = rng.choice(np.array([-1, 1], np.int8), (count, bits))
        same = drawn.astype(int) @ drawn.T
        np.fill_diagonal(same, -bits)
        halves = (abs(drawn.sum(0)) < count).all()
        if halves and bits - same.max() > most:
            best, most = drawn, bits - same.max()
    if best is None:
        raise ValueError(f"no code of {bits} bits found for {count} languages")
    return best


def ngram_counts(text: str) -> np.ndarray:
    """How often each place's n-grams occur in the text."""
    data = LETTERS[np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)]
    total = np.zeros(PLACES, np.int64)
    longest = max(ORDERS)
    for start in range(0, max(1, len(data)), SEGMENT):
        part = data[max(0, start - longest + 1) : start + SEGMENT]
        blank = part == 32
        part = part[~(blank & np.r_[False, blank[:-1]])].astype(np.uint64)
        code = np.zeros(len(part), np.uint64)
        for order in range(1, longest + 1):
            code = code[: len(part) - order + 1] * np.uint64(257) + part[order - 1 :] + np.uint64(1)
            if not len(code):
                break
            if order in ORDERS:
                places = (mix(code) & np.uint64(PLACES - 1)).astype(np.int64)
                total += np.bincount(places, minlength=PLACES)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Languages, their codewords, n-gram weights of each bit and reliabilities; at most a few MB."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scales: np.ndarray
    trust: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        return (counts.astype(np.float32) @ self.weights) / max(1, counts.sum())

    def decode(self, margins: np.ndarray) -> tuple[int, float, bool]:
        """The nearest codeword, its share against the second nearest, and whether they are about as near."""
        signed = self.code * np.clip(margins / self.scales, -3, 3)
        losses = (self.trust * np.exp(-signed)).sum(1)
        order = np.argsort(losses, kind="stable")
        if len(order) == 1:
            return 0, 1.0, False
        # At equal losses the share is one half.
        share = losses[order[1]] ** 2 / (losses[order[0]] ** 2 + losses[order[1]] ** 2)
        return int(order[0]), float(share), bool(share <= AMBIGUOUS)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, False
        best, share, ambiguous = self.decode(self.margins(ngram_counts(text)))
        return self.languages[best], share, ambiguous


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            counts = ngram_counts(text.as_py())
            known = totals.setdefault(lang.as_py(), counts)
            if known is not counts:
                known += counts
            if len(totals) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages in the training rows")
    for lang, counts in totals.items():
        places = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(places)), pa.array(places), pa.array(counts[places])], ["lang", "place", "n"]
        )


def _agreement_rows(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    index = {lang: i for i, lang in enumerate(model.languages)}
    right = np.zeros(model.code.shape)
    size = np.zeros(model.code.shape)
    rows = np.zeros(len(index), np.int64)
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            i = index[lang.as_py()]
            margins = model.margins(ngram_counts(text.as_py()))
            right[i] += np.sign(margins) == model.code[i]
            size[i] += abs(margins)
            rows[i] += 1
    languages, bits = np.indices(model.code.shape)
    yield pa.RecordBatch.from_arrays(
        [pa.array(x.ravel()) for x in (languages, bits, right, size, np.repeat(rows, model.code.shape[1]))],
        ["lang", "bit", "right", "size", "n"],
    )


def train(rows: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> LanguageModel:
    """Learn from ``text, lang``; rows without language or letters teach nothing.

    Counts cover all rows.  Reliabilities come from about
    ``calibration_rows`` rows, chosen by a hash of the text.
    """
    usable = rows.filter("lang is not null and text rlike '\\\\p{L}'").select("text", "lang")
    counts = usable.mapInArrow(_count_rows, "lang string, place long, n long").groupBy("lang", "place").agg(
        F.sum("n").alias("n")
    )
    # At most MAX_LANGUAGES x PLACES numbers, packed by language.
    packed = counts.groupBy("lang").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("n"))
    table = {r["lang"]: r for r in packed.limit(MAX_LANGUAGES + 1).toLocalIterator()}
    if len(table) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in the training rows")
    languages = sorted(table)
    shares = np.full((len(languages), PLACES), 0.5)
    for i, lang in enumerate(languages):
        np.add.at(shares[i], np.array(table[lang]["places"], int), np.array(table[lang]["n"], float))
    shares /= shares.sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((PLACES, code.shape[1]), np.float32)
    for bit in range(code.shape[1] if len(languages) > 1 else 0):
        yes, no = shares[code[:, bit] > 0].mean(0), shares[code[:, bit] < 0].mean(0)
        weights[:, bit] = np.log(yes / no)
    bits = code.shape[1]
    model = LanguageModel(languages, code, weights, np.ones(bits), np.full(code.shape, 1 / bits))
    if len(languages) > 1:
        _calibrate(model, usable, calibration_rows)
    return model


def _calibrate(model: LanguageModel, usable: DataFrame, calibration_rows: int) -> None:
    share = min(1.0, calibration_rows / max(1, usable.count()))
    chosen = usable.filter((F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))))
    shared = usable.sparkSession.sparkContext.broadcast(model)
    found = (
        chosen.mapInArrow(
            lambda it: _agreement_rows(it, shared.value), "lang long, bit long, right double, size double, n long"
        )
        .groupBy("lang", "bit").agg(F.sum("right").alias("right"), F.sum("size").alias("size"), F.sum("n").alias("n"))
        .collect()
    )
    shared.destroy()
    right, size, n = (np.zeros(model.code.shape) for _ in range(3))
    for row in found:
        at = row["lang"], row["bit"]
        right[at], size[at], n[at] = row["right"], row["size"], row["n"]
    model.scales = np.maximum(size.sum(0) / np.maximum(n.sum(0), 1), 1e-6)
    trust = (right + 1) / (n + 2)
    model.trust = trust / trust.sum(1, keepdims=True)


def _predict_rows(batches: Iterator[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model.predict(text.as_py()) for text in batch.column("_text")]
        labels, scores, flags = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64()),
                pa.array(flags, pa.bool_()),
            ],
            [*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"],
        )


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Learn from all but one fold of the documents and predict all of them.

    Returns one row per input row: ``doc_id, held_out, lang_pred, score,
    ambiguous``.  Rows whose crc32 of the id as text is divisible by
    ``folds`` are held out.  Texts that are null or have no letter are
    ``und`` with score 0; without any training row all texts are.  With one
    language all other texts have it, with score 1.  Repeated rows are
    treated alike; extra columns are not read, but those named in ``carry``
    come back in the struct ``carried``.
    More than ``MAX_LANGUAGES`` different labels in the training rows raise,
    as such a column holds no languages.
    """
    marked = docs.select(
        F.col(id_col).alias("doc_id"), (id_remainder(id_col, folds) == 0).alias("held_out"),
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    model = train(marked.filter("not held_out").select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passed = [c for c in marked.columns if c not in ("lang", "text")]
    kinds = ", ".join(f"{c} {t}" for c, t in marked.select(*passed).dtypes)
    return marked.select(*passed, F.col("text").alias("_text")).mapInArrow(
        lambda it: _predict_rows(it, shared.value), f"{kinds}, lang_pred string, score double, ambiguous boolean"
    )
