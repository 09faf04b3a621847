"""SentencePiece models run by the tokenizers library.

The model file is parsed from its protobuf form and rebuilt: normaliser,
blank marker, unigram scores or merges, and byte fallback.  Texts are cut
before each blank where no piece can reach across; the different words of a
batch are encoded together and each text's ids put together from them.  The
sentencepiece library encodes the raw texts, and whole ids are compared.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
EDGE = re.compile(f"(?<=[^{MARK}])(?={MARK})")
#: Bytes of texts that are cut into words together.
TOGETHER = 2_000_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} in a model file")
            size = varint()
        if at + size > len(data):
            raise ValueError("a model file ends inside a field")
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    """What a model file says, with the format's defaults."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            found = dict(fields(value))
            model.kind = found.get(3, UNIGRAM)
            model.byte_fallback = bool(found.get(35, 0))
            model.suffix = bool(found.get(24, 0))
        elif number == 3:
            found = dict(fields(value))
            model.charsmap = found.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(found.get(n, 1)) for n in (3, 4, 5))
    model.unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    if model.kind not in (UNIGRAM, BPE) or model.suffix:
        raise ValueError("only unigram and BPE models with leading blank markers are known")
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Pairs to merge, best first: those that make a piece of higher score, then longer left parts."""
    ids = {piece: i for i, (piece, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, score, kind in model.pieces:
        if kind != NORMAL:
            continue
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-score, ids[piece], ids[left], ids[right], left, right))
    return [x[4:] for x in sorted(found)]


def rebuild(model: Model):
    """A tokenizer that works on marked texts, as ``Pieces.marked`` makes them."""
    from tokenizers import AddedToken, Tokenizer, models

    if model.kind == UNIGRAM:
        inner = models.Unigram([p[:2] for p in model.pieces], model.unknown, model.byte_fallback)
    else:
        vocab = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
        inner = models.BPE(
            vocab, merges_of(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    tokenizer = Tokenizer(inner)
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER])
    return tokenizer


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            self.model = parse_model(file.read())
        self.tokenizer = rebuild(self.model)
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normaliser = None
        if self.model.charsmap:
            from tokenizers import normalizers

            self.normaliser = normalizers.Precompiled(self.model.charsmap)
        #: Cutting before a blank is exact unless a piece has a blank after another character.
        self.cuts = self.model.escape and not any(
            MARK in p.lstrip(MARK) for p, _, kind in self.model.pieces if kind in (NORMAL, USER)
        )
        self.spelled = [self._spelled(*p) for p in self.model.pieces]
        self.bytes_of = pa.array(self.spelled, pa.binary())

    def _spelled(self, piece: str, _: float, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def normal(self, text: str) -> str:
        """The text as the model reads it, with blanks."""
        if self.normaliser and text:
            text = self.normaliser.normalize_str(text)
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return text

    def marked(self, normal: str) -> str:
        text = " " + normal if self.model.dummy_prefix and normal else normal
        return text.replace(" ", MARK) if self.model.escape else text

    def units(self, normal: str) -> list[str]:
        marked = self.marked(normal)
        return EDGE.split(marked) if self.cuts else [marked] if marked else []

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units one after another, and how many each has."""
        found = [code.ids for code in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def _lists(self, normal: list[str]) -> pa.ListArray:
        """The units of each text, most of them cut column by column."""
        marked = [self.marked(n) for n in normal]
        if self.cuts and self.model.dummy_prefix and not any(MARK + MARK in m for m in marked):
            # Every unit of such texts begins with one mark.
            lists = pc.split_pattern(pa.array([m[1:] for m in marked], pa.string()), MARK)
            flat = pc.binary_join_element_wise(MARK, lists.flatten(), "")
            return pa.ListArray.from_arrays(lists.offsets, flat)
        return pa.array([[u for u in self.units(n) if u] for n in normal], pa.list_(pa.string()))

    def _own(self, normal: list[str]) -> list[np.ndarray]:
        """Ids of texts without an empty one; a unit is encoded once for all of them."""
        lists = self._lists(normal)
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        flat = lists.flatten().dictionary_encode()
        ids, counts = self._learn(flat.dictionary.to_pylist())
        chosen = flat.indices.to_numpy().astype(np.int64)
        lengths = counts[chosen]
        ends = np.cumsum(lengths)
        starts = np.cumsum(counts) - counts
        placed = ids[np.repeat(starts[chosen] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        return np.split(placed, np.r_[0, ends][offsets[1:-1]])

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """For each text the little-endian 32-bit ids and whether the other library gives the same for the raw text."""
        found: list[tuple[bytes, bool]] = []
        normal = [self.normal(t) for t in texts]
        full = [i for i, n in enumerate(normal) if n]
        plain = [i for i in full if "  " not in normal[i] and MARK not in normal[i] and not normal[i].startswith(" ")]
        own = [b""] * len(texts)
        for part in (plain, sorted(set(full) - set(plain))):
            if part:
                for i, ids in zip(part, self._own([normal[i] for i in part]), strict=True):
                    own[i] = ids.astype("<u4").tobytes()
        for ids, theirs in zip(own, self.peer.encode(texts, num_threads=1), strict=True):
            found.append((ids, ids == np.array(theirs, "<u4").tobytes()))
        return found

    def gives_back(self, ids: list[bytes], normal: list[str]) -> list[bool]:
        """Whether decoding gives each normalised text back."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        spelled = self.bytes_of.take(pa.array(flat.astype(np.int64)))
        # What is taken lies in one buffer, in order.
        data = spelled.buffers()[2].to_pybytes() if len(flat) else b""
        offsets = np.frombuffer(spelled.buffers()[1], np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        cuts = offsets[np.r_[0, np.cumsum([len(x) // 4 for x in ids])]].astype(np.int64)
        lead = " " if self.model.dummy_prefix else ""
        return [
            data[a:b] == (lead + n if n else "").encode() or self.decode(x) == n
            for x, n, a, b in zip(ids, normal, cuts[:-1], cuts[1:], strict=True)
        ]

    def decode(self, ids: bytes) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters."""
        spelled = self.spelled
        text = b"".join([spelled[i] for i in np.frombuffer(ids, np.uint32).tolist()]).decode("utf-8", "replace")
        return text.removeprefix(" ") if self.model.dummy_prefix else text


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encode_rows(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coder, rows = pieces(path), []
        given = pc.fill_null(batch.column("_text"), "")
        runs = np.cumsum(pc.binary_length(given).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
        for part in np.split(np.arange(len(given)), np.flatnonzero(np.diff(runs)) + 1) if len(given) else ():
            texts = given.slice(int(part[0]), len(part)).to_pylist()
            found = coder.encode_batch(texts)
            same = coder.gives_back([ids for ids, _ in found], [coder.normal(t) for t in texts])
            for (ids, parity), back in zip(found, same, strict=True):
                rows.append((len(ids) // 4, zlib.crc32(ids), parity, back, np.frombuffer(ids, np.uint32) if with_ids else None))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
            ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip", "ids"],
        )


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Ids of every text: ``doc_id, n_tokens, ids_crc32, parity, round_trip, ids``.

    ``parity`` says whether the sentencepiece library gives the raw text the
    same ids, ``round_trip`` whether decoding gives the normalised text
    back.  Null counts as empty and has no ids; repeated rows are encoded
    alike.  Ids are left out (null) unless ``with_ids``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        lambda it: _encode_rows(it, model_path, with_ids),
        f"doc_id {kind}, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean, ids array<int>",
    )


def _decode_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coder = pieces(path)
        texts = [coder.decode(np.array(x.as_py() or [], np.uint32).tobytes()) for x in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """Texts of ``doc_id, ids``; null ids give an empty text."""
    rows = rows.select("doc_id", "ids")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda it: _decode_rows(it, model_path), f"doc_id {kind}, text string")
