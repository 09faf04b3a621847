"""Two tokenizers' tokens of one text aligned by the bytes they cover.

A text's tokens of either kind end at byte offsets; offsets where both end
cut the tokens into groups.  A byte range of a text yields a fragment: an
open prefix up to the first common end it can see, the groups closed inside,
and an open suffix.  Fragments compose, and the order of composing does not
matter, so a very long text is cut into ranges that many tasks align, and a
tree of compositions puts it together.  Ranges are cut where each tokenizer
allows it, which need not be the same place for both.

Other texts are cut into words between lone blanks, at which both tokenizers
always end a token.  A word is a fragment without open ends; it is aligned
once for all texts of a batch, and a text is the concatenation of its words.

Counts of linked ids are looked up per block of texts, not per text: a block
asks for each of its pairs once.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import pin
from tocsin.runtime import materialise

#: Bytes beyond which a text is cut into ranges, and the characters of a range.
LONG_TEXT, RANGE_CHARS = 1 << 18, 1 << 16
#: Fragments that one step of the tree composes.
FAN = 8
#: Bytes of texts that are cut into words together, words that are encoded as one, bytes of texts of a block.
TOGETHER, JOINED, BLOCK_BYTES = 4_000_000, 1_000, 16_000_000
#: White space other than lone blanks and line ends between other characters.
ODD_WHITE = (
    r"[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \n][ \n]|^[ \n]|[ \n]$"
)
#: Both tokenizers end a token before a lone blank; the first also before a lone line end.
SAFE_FIRST, SAFE_SECOND = re.compile(r"(?<=\S)[ \n](?=\S)"), re.compile(r"(?<=\S) (?=\S)")
PLAIN = re.compile(r"\S+(?:\n\S+)*")
WHITE_MARK, BYTE_PIECE = "▁", re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others follow from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Side:
    """Ids of consecutive words with the number of ids of each word."""

    ids: np.ndarray
    counts: np.ndarray


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, first: str, second: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are its threads
        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        alphabet = byte_alphabet()
        vocab = self.first.get_vocab()
        size = max(vocab.values()) + 1
        tokens = [b""] * size
        self.opens = np.zeros(size, bool)
        for token, i in vocab.items():
            known = all(c in alphabet for c in token)
            tokens[i] = bytes(alphabet[c] for c in token) if known else token.encode()
            self.opens[i] = tokens[i].startswith(b" ")
        self.second_size = self.second.get_piece_size()
        self.tokens = (pa.array(tokens, pa.binary()), pa.array(map(self._piece, range(self.second_size)), pa.binary()))
        self.lengths = tuple(pc.binary_length(t).to_numpy().astype(np.int64) for t in self.tokens)
        #: Decimal ids with each mark that can follow them: the next of its kind, the end of its kind.
        self.first_size = size
        kinds = ((",", size), ("|", size), (",", self.second_size), (";", self.second_size))
        self.texts = pa.array([f"{i}{mark}".encode() for mark, n in kinds for i in range(n)], pa.binary())

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        byte = BYTE_PIECE.fullmatch(piece) if self.second.is_byte(i) else None
        return bytes([int(byte[1], 16)]) if byte else piece.replace(WHITE_MARK, " ").encode()

    def encode_first(self, texts: list[str]) -> list[np.ndarray]:
        found = self.first.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, np.int64) for c in found]

    def encode_second(self, texts: list[str]) -> Side:
        found = self.second.encode(texts, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return Side(np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum())), counts)

    def words_first(self, plain: list[str], odd: list[str]) -> Side:
        """Ids of words after a blank: many plain words as one text, odd words alone."""
        ids, counts = [], []
        for at in range(0, len(plain), JOINED):
            part = plain[at : at + JOINED]
            joined = self.encode_first([" " + " ".join(part)])[0]
            cuts = np.flatnonzero(self.opens[joined])
            if len(cuts) != len(part):
                raise ValueError("the first tokenizer joins words across a blank")
            ids.append(joined)
            counts.append(np.diff(np.append(cuts, len(joined))))
        for found in self.encode_first([" " + w for w in odd]):
            ids.append(found)
            counts.append(np.array([len(found)]))
        return Side(np.concatenate(ids), np.concatenate(counts)) if ids else Side(np.zeros(0, np.int64), np.zeros(0, np.int64))


@lru_cache(1)
def tokenizers_of(first: str, second: str) -> Tokenizers:
    return Tokenizers(first, second)


def taken_bytes(values: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of ``values[at]`` and the end of each."""
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    found = values.take(pa.array(at))
    offsets = np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1]
    return np.frombuffer(found.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], (offsets[1:] - offsets[0]).astype(np.int64)


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


def group_text(coder: Tokenizers, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the groups that end behind ``cut_a`` and ``cut_b``, each closed by a semicolon, and each group's end."""
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[cut_a], last_b[cut_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before_b = np.concatenate([[0], cut_b + 1])  # second ids in earlier groups
    place = np.empty(len(a) + len(b), np.int64)
    place[np.arange(len(a)) + before_b[group_a]] = a + last_a * coder.first_size
    place[np.arange(len(b)) + (cut_a + 1)[group_b]] = b + last_b * coder.second_size + 2 * coder.first_size
    data, ends = taken_bytes(coder.texts, place)
    return data, ends[cut_a + cut_b + 1]


@dataclass
class Words:
    """Aligned words: bytes of their groups and codes of their links, with offsets; ``ok`` if both sides cover the word."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    text: np.ndarray
    text_at: np.ndarray
    codes: np.ndarray
    codes_at: np.ndarray


def align_words(coder: Tokenizers, words: list[str]) -> tuple[Words, np.ndarray]:
    """Align distinct words; also returns where each word of the list lies."""
    plain = [i for i, w in enumerate(words) if PLAIN.fullmatch(w)]
    odd = sorted(set(range(len(words))) - set(plain))
    order = np.array([*plain, *odd], np.int64)
    where = np.empty(len(words), np.int64)
    where[order] = np.arange(len(words))
    a = coder.words_first([words[i] for i in plain], [words[i] for i in odd])
    ordered = [words[i] for i in order]
    b = coder.encode_second(ordered)
    said = pa.array([" " + w for w in ordered], pa.string()).cast(pa.binary())
    expected, said_ends = taken_bytes(said, np.arange(len(ordered)))
    said_at = np.concatenate([[0], said_ends])
    # A word counts if either side gives back its bytes, no more and no fewer.
    ok = np.ones(len(ordered), bool)
    for side, tokens, lengths in zip((a, b), coder.tokens, coder.lengths, strict=True):
        ends = starts_of(lengths[side.ids])[starts_of(side.counts)]
        ok &= np.diff(ends) == np.diff(said_at)
        found, _ = taken_bytes(tokens, side.ids[np.repeat(ok, side.counts)])
        owner = np.repeat(np.arange(len(ordered)), np.where(ok, np.diff(said_at), 0))
        ok[owner[found != expected[np.repeat(ok, np.diff(said_at))]]] = False
    (ids_a, ends_a), (ids_b, ends_b) = (
        (kept, np.cumsum(lengths[kept]))
        for kept, lengths in ((s.ids[np.repeat(ok, s.counts)], n) for s, n in zip((a, b), coder.lengths, strict=True))
    )
    word_a = np.repeat(np.arange(len(ordered)), np.where(ok, a.counts, 0))
    _, cut_a, cut_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    data, group_ends = group_text(coder, ids_a, ids_b, cut_a, cut_b)
    groups = np.bincount(word_a[cut_a], minlength=len(ordered))
    group_at = starts_of(groups)
    codes = (ids_a[cut_a] * coder.second_size + ids_b[cut_b]).astype(np.uint32)
    return Words(
        ok, np.where(ok, a.counts, 0), np.where(ok, b.counts, 0), data, np.concatenate([[0], group_ends])[group_at], codes, group_at
    ), where


def gather(data: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``data`` that ``at`` bounds, in the order chosen, and the end of each."""
    lengths = at[chosen + 1] - at[chosen]
    ends = np.cumsum(lengths)
    return data[np.repeat(at[chosen] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


@dataclass
class Aligned:
    """The alignment of one text."""

    n_a: int = 0
    n_b: int = 0
    closed: bytes = b""
    codes: bytes = b""

    def row(self) -> tuple:
        digest = hashlib.sha256(self.closed[:-1]).hexdigest() if self.closed else ""
        return self.n_a, self.n_b, len(self.codes) // 4, digest, self.codes


def align_texts(coder: Tokenizers, texts: pa.Array) -> list[Aligned]:
    """Align texts that are not empty."""
    odd = pc.match_substring_regex(texts, ODD_WHITE).to_numpy(zero_copy_only=False)
    found: list[Aligned] = [Aligned()] * len(texts)
    plain = np.flatnonzero(~odd)
    kinds = [(plain, pc.split_pattern(texts.take(pa.array(plain)), " "))] if len(plain) else []
    others = np.flatnonzero(odd)
    if len(others):
        cut = [SAFE_SECOND.split(texts[int(i)].as_py()) for i in others]
        kinds.append((others, pa.array(cut, pa.list_(pa.string()))))
    for rows, lists in kinds:
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        flat = lists.flatten().dictionary_encode()
        words, where = align_words(coder, flat.dictionary.to_pylist())
        chosen = where[flat.indices.to_numpy().astype(np.int64)]
        first, last = offsets[:-1], offsets[1:]

        def per_text(values: np.ndarray) -> np.ndarray:
            sums = starts_of(values[chosen])
            return sums[last] - sums[first]

        ok = per_text(~words.ok) == 0
        n_a, n_b = per_text(words.n_a), per_text(words.n_b)
        text, text_ends = gather(words.text, words.text_at, chosen)
        codes, code_ends = gather(words.codes, words.codes_at, chosen)
        text_ends, code_ends = np.concatenate([[0], text_ends]), np.concatenate([[0], code_ends])
        text, codes = text.tobytes(), codes.tobytes()
        for i, row in enumerate(rows):
            if ok[i]:
                found[row] = Aligned(
                    int(n_a[i]), int(n_b[i]), text[text_ends[first[i]] : text_ends[last[i]]],
                    codes[4 * code_ends[first[i]] : 4 * code_ends[last[i]]],
                )
    return found


# --- the fragment monoid ---------------------------------------------------


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Stream:
    """Ids with the byte offset that each ends at."""

    ids: np.ndarray = field(default_factory=_none)
    ends: np.ndarray = field(default_factory=_none)

    def __add__(self, other: Stream) -> Stream:
        return Stream(np.concatenate([self.ids, other.ids]), np.concatenate([self.ends, other.ends]))

    def cut(self, end: int) -> tuple[Stream, Stream]:
        """What ends up to ``end``, and what ends behind it."""
        at = int(np.searchsorted(self.ends, end, "right"))
        return Stream(self.ids[:at], self.ends[:at]), Stream(self.ids[at:], self.ends[at:])


@dataclass
class Fragment:
    """What a byte range of a text says about its alignment.

    ``first`` and ``last`` are the first and last common ends seen in it, or
    None.  Tokens up to the first are the open prefix, those behind the last
    the open suffix; without a common end all tokens are prefix.
    """

    coder: Tokenizers
    ok: bool = True
    first: int | None = None
    last: int | None = None
    prefix: tuple[Stream, Stream] = field(default_factory=lambda: (Stream(), Stream()))
    suffix: tuple[Stream, Stream] = field(default_factory=lambda: (Stream(), Stream()))
    closed: bytes = b""
    codes: bytes = b""
    n_a: int = 0
    n_b: int = 0

    @classmethod
    def of(cls, coder: Tokenizers, a: Stream, b: Stream, ok: bool = True) -> Fragment:
        """The fragment of the tokens of a byte range."""
        common, cut_a, cut_b = np.intersect1d(a.ends, b.ends, assume_unique=True, return_indices=True)
        out = cls(coder, ok=ok, n_a=len(a.ids), n_b=len(b.ids))
        if not len(common):
            out.prefix = (a, b)
            return out
        out.first, out.last = int(common[0]), int(common[-1])
        (pre_a, rest_a), (pre_b, rest_b) = a.cut(out.first), b.cut(out.first)
        (in_a, suf_a), (in_b, suf_b) = rest_a.cut(out.last), rest_b.cut(out.last)
        out.prefix, out.suffix = (pre_a, pre_b), (suf_a, suf_b)
        out.codes = (a.ids[cut_a] * coder.second_size + b.ids[cut_b]).astype("<u4").tobytes()
        if len(common) > 1:
            text, _ = group_text(coder, in_a.ids, in_b.ids, cut_a[1:] - cut_a[0] - 1, cut_b[1:] - cut_b[0] - 1)
            out.closed = text.tobytes()
        return out

    def __add__(self, right: Fragment) -> Fragment:
        """The fragment of two neighbouring ranges, this one to the left.

        Only tokens between the last common end here and the first one there
        are looked at again.
        """
        left_open = self.suffix if self.first is not None else self.prefix
        middle = Fragment.of(self.coder, left_open[0] + right.prefix[0], left_open[1] + right.prefix[1])
        out = Fragment(self.coder, ok=self.ok and right.ok, n_a=self.n_a + right.n_a, n_b=self.n_b + right.n_b)
        # The common end that closes the right prefix is known already: its link is counted there.
        known = right.first is not None
        codes = middle.codes[:-4] if known else middle.codes
        out.codes = self.codes + codes + right.codes
        ends = [e for e in (self.first, middle.first, right.first) if e is not None]
        if not ends:
            out.prefix = middle.prefix
            return out
        out.first = ends[0]
        out.last = next(e for e in (right.last, middle.last, self.last) if e is not None)
        opening = b"" if self.first is None or middle.first is None else self._closing(middle.prefix)
        out.closed = self.closed + opening + middle.closed + right.closed
        out.prefix = self.prefix if self.first is not None else middle.prefix
        if known:
            out.suffix = right.suffix
        else:
            out.suffix = middle.suffix if middle.first is not None else middle.prefix
        return out

    def _closing(self, group: tuple[Stream, Stream]) -> bytes:
        a, b = group
        text, _ = group_text(self.coder, a.ids, b.ids, np.array([len(a.ids) - 1]), np.array([len(b.ids) - 1]))
        return text.tobytes()

    def whole(self) -> Aligned:
        """The alignment, if this is the fragment of a whole text."""
        if not self.ok or self.first is None or any(len(s.ids) for s in self.suffix):
            return Aligned()
        return Aligned(self.n_a, self.n_b, self._closing(self.prefix) + self.closed, self.codes)

    def packed(self) -> tuple:
        streams = [s for pair in (self.prefix, self.suffix) for s in pair]
        return (
            self.ok, self.first, self.last, [x.astype("<i8").tobytes() for s in streams for x in (s.ids, s.ends)],
            self.closed, self.codes, self.n_a, self.n_b,
        )

    @classmethod
    def unpacked(cls, coder: Tokenizers, row: dict) -> Fragment:
        flat = [np.frombuffer(x, "<i8") for x in row["open"]]
        streams = [Stream(flat[i], flat[i + 1]) for i in range(0, 8, 2)]
        return cls(
            coder, row["ok"], row["first"], row["last"], tuple(streams[:2]), tuple(streams[2:]),
            row["closed"], row["codes"], row["n_a"], row["n_b"],
        )


FRAGMENT = "ok boolean, first long, last long, open array<binary>, closed binary, codes binary, n_a long, n_b long"
FRAGMENT_ARROW = [
    ("ok", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("open", pa.list_(pa.binary())),
    ("closed", pa.binary()), ("codes", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()),
]


def ranges_of(text: str, range_chars: int = RANGE_CHARS) -> Iterator[tuple[str, int, str, int]]:
    """Byte ranges of a blank and the text: each side's part, cut where its tokenizer allows, and the part's offset."""
    said = " " + text

    def cuts(safe: re.Pattern) -> list[int]:
        found, at = [0], range_chars
        while at < len(said):
            match = safe.search(said, max(at, found[-1] + 1))
            found.append(match.start() if match else len(said))
            at += range_chars
        return [*found, len(said)]

    # Cuts before the same nominal offsets: a part may be empty where no cut is allowed for long.
    first, second = cuts(SAFE_FIRST), cuts(SAFE_SECOND)
    at_a = at_b = 0
    for i in range(len(first) - 1):
        a, b = said[first[i] : first[i + 1]], said[second[i] : second[i + 1]]
        yield a, at_a, b, at_b
        at_a, at_b = at_a + len(a.encode()), at_b + len(b.encode())


def fragment_of(coder: Tokenizers, a: str, at_a: int, b: str, at_b: int) -> Fragment:
    """Tokens of both parts of a range; a part of the second side begins with the blank its tokenizer puts there."""
    streams, ok = [], True
    ids_a = coder.encode_first([a])[0] if a else _none()
    ids_b = coder.encode_second([b[1:]]).ids if b else _none()
    for ids, tokens, part, at in ((ids_a, coder.tokens[0], a, at_a), (ids_b, coder.tokens[1], b, at_b)):
        data, ends = taken_bytes(tokens, ids)
        ok = ok and data.tobytes() == part.encode()
        streams.append(Stream(ids, ends + at))
    return Fragment.of(coder, *streams, ok=ok)


def compose(fragments: Iterable[Fragment]) -> Fragment:
    found = None
    for fragment in fragments:
        found = fragment if found is None else found + fragment
    return found


# --- Spark ------------------------------------------------------------------


def _aligned_rows(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Align short texts, in blocks of about ``BLOCK_BYTES``."""
    coder, size, block = None, 0, 0
    for batch in batches:
        coder = coder or tokenizers_of(*paths)
        texts = pc.fill_null(batch.column("_text"), "").cast(pa.string())
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        runs = np.cumsum(lengths) // TOGETHER
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(runs)) + 1):
            if not len(part):
                continue
            rows: list[Aligned] = [Aligned()] * len(part)
            full = np.flatnonzero(lengths[part] > 0)
            if len(full):
                for i, aligned in zip(full, align_texts(coder, texts.take(pa.array(part[full]))), strict=True):
                    rows[i] = aligned
            columns = list(zip(*(r.row() for r in rows), strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(int(part[0]), len(part)), pa.array(columns[0], pa.int64()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()),
                 pa.array(columns[4], pa.binary()), pa.array([block] * len(part), pa.int64())],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "block"],
            )
            size += int(lengths[part].sum())
            block, size = (block + 1, 0) if size >= BLOCK_BYTES else (block, size)


def _range_rows(batches: Iterator[pa.RecordBatch], range_chars: int) -> Iterator[pa.RecordBatch]:
    """Cut long texts: one row per range, passed on one text at a time."""
    for batch in batches:
        for i, text in enumerate(batch.column("_text")):
            parts = list(ranges_of(text.as_py(), range_chars))
            a, at_a, b, at_b = zip(*parts, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_rid").take(pa.array([i] * len(parts))), pa.array(range(len(parts)), pa.int64()),
                 pa.array(a, pa.string()), pa.array(at_a, pa.int64()), pa.array(b, pa.string()), pa.array(at_b, pa.int64())],
                ["_rid", "_range", "a", "at_a", "b", "at_b"],
            )


def _fragment_batch(keys: list[pa.Array], names: list[str], fragments: list[Fragment]) -> pa.RecordBatch:
    columns = list(zip(*(f.packed() for f in fragments), strict=True)) if fragments else [()] * len(FRAGMENT_ARROW)
    return pa.RecordBatch.from_arrays(
        [*keys, *[pa.array(c, t) for c, (_, t) in zip(columns, FRAGMENT_ARROW, strict=True)]],
        [*names, *[n for n, _ in FRAGMENT_ARROW]],
    )


def _fragment_rows(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = {c: batch.column(c)[at].as_py() for c in ("a", "at_a", "b", "at_b")}
            found = fragment_of(tokenizers_of(*paths), **row)
            yield _fragment_batch([batch.column(c).slice(at, 1) for c in ("_rid", "_range")], ["_rid", "_range"], [found])


def _composed(key: tuple, table: pa.Table, paths: tuple[str, str]) -> pa.Table:
    coder = tokenizers_of(*paths)
    rows = table.sort_by("_range").to_pylist()
    found = compose(Fragment.unpacked(coder, row) for row in rows)
    batch = _fragment_batch([pa.array([k.as_py()], pa.int64()) for k in key], ["_rid", "_range"], [found])
    return pa.Table.from_batches([batch])


def _whole_rows(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coder = tokenizers_of(*paths)
        rows = [Fragment.unpacked(coder, r).whole().row() for r in batch.drop_columns(["_rid", "_range"]).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_rid"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
            ["_rid", "n_a", "n_b", "n_groups", "groups_sha256", "codes"],
        )


def align_long(rows: DataFrame, paths: tuple[str, str], range_chars: int = RANGE_CHARS) -> DataFrame:
    """Align ``doc_id, _text`` by ranges in many tasks and a tree of compositions."""
    long = pin(rows.withColumn("_rid", F.monotonically_increasing_id()))
    cut = long.select("_rid", "_text").mapInArrow(
        lambda it: _range_rows(it, range_chars), "_rid long, _range long, a string, at_a long, b string, at_b long"
    )
    keys = "_rid long, _range long"
    # A task holds one range's tokens at a time.
    fragments = pin(
        cut.repartition("_rid", "_range").mapInArrow(lambda it: _fragment_rows(it, paths), f"{keys}, {FRAGMENT}")
    )
    most = fragments.agg(F.max("_range")).first()[0] or 0
    while most:
        up = fragments.withColumn("_above", F.floor(F.col("_range") / FAN).cast("long"))
        fragments = up.groupBy("_rid", "_above").applyInArrow(
            lambda key, part: _composed(key, part.drop_columns(["_above"]), paths), f"{keys}, {FRAGMENT}"
        )
        most //= FAN
    whole = fragments.mapInArrow(
        lambda it: _whole_rows(it, paths), "_rid long, n_a long, n_b long, n_groups long, groups_sha256 string, codes binary"
    )
    # Each long text is a block of its own.
    return long.select("_rid", "doc_id").join(whole, "_rid").withColumn("block", -1 - F.col("_rid")).drop("_rid")


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct links of a block's texts in this batch and how often each occurs."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for part in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
            if not len(part):
                continue
            joined = b"".join(batch.column("codes").slice(int(part[0]), len(part)).to_pylist())
            codes, counts = np.unique(np.frombuffer(joined, "<u4"), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(codes), blocks[part[0]])), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))],
                ["block", "code", "n"],
            )


def _count_links(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of each text of one block."""
    codes = pairs.column("code").to_numpy()
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    totals = pairs.column("total").to_numpy()[order]
    best = pairs.column("best").to_numpy()[order].astype(np.int64)
    n_best, count_sum = [], []
    for packed in texts.column("codes"):
        at = np.searchsorted(codes, np.frombuffer(packed.as_buffer(), "<u4"))
        n_best.append(int(best[at].sum()))
        count_sum.append(int(totals[at].sum()))
    kept = texts.drop_columns(["codes", "block"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align(
    docs: DataFrame,
    first: str,
    second: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    long_text: int = LONG_TEXT,
    range_chars: int = RANGE_CHARS,
) -> DataFrame:
    """Align the tokens of a byte-level and a sentence-piece tokenizer over each text.

    Both encode a blank and the text, special tokens being plain text there.
    Returns one row per document: ``doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256``.  A link is a token of either kind
    that end at one offset; its count is how many links of the whole table
    join the same two ids, and it is best if no count of its second id is
    higher.

    Null and empty texts have no tokens, nor have texts that either tokenizer
    doesn't give back byte by byte: zeros and an empty hash.  Longer texts
    than ``long_text`` bytes are cut into ranges; memory of a task is bounded
    by one range (or one stretch without a place to cut) and, at the tree's
    root, by a text's ids as text.  Repeated rows count each, an empty table
    gives an empty result, extra columns are not read.
    """
    paths = (first, second)
    coder = Tokenizers(first, second)
    if coder.first_size * coder.second_size >= 1 << 32 or min(int(n.min()) for n in coder.lengths) == 0:
        raise ValueError("ids of a pair must fit 32 bits and no token may be empty")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["doc_id"]
    columns = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, codes binary, block long"
    is_long = F.coalesce(F.octet_length("_text") > long_text, F.lit(False))
    short = rows.filter(~is_long).mapInArrow(lambda it: _aligned_rows(it, paths), columns).withColumn(
        "block", F.col("block") * F.lit(1 << 32) + F.spark_partition_id()
    )
    long = align_long(rows.filter(is_long), paths, range_chars)
    texts = materialise(short.unionByName(long), "aligned")
    linked = texts.filter("n_groups > 0")
    asked = linked.select("block", "codes").mapInArrow(_pair_rows, "block long, code long, n long")
    totals = asked.groupBy("code").agg(F.sum("n").alias("total"))
    second_id = (F.col("code") % coder.second_size).alias("_second")
    # One row per id of the second vocabulary.
    most = totals.groupBy(second_id).agg(F.max("total").alias("_most"))
    valued = totals.withColumn("_second", F.col("code") % coder.second_size).join(F.broadcast(most), "_second").select(
        "code", "total", (F.col("total") == F.col("_most")).alias("best")
    )
    # A block asks for a pair once or, cut between files, a few times.
    pairs = asked.select("block", "code").join(valued, "code").select("block", "code", "total", "best")
    counted = linked.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(
        _count_links,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long",
    )
    bare = texts.filter("n_groups = 0").drop("codes", "block").withColumns({
        "n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")
    })
    return counted.unionByName(bare).select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )
