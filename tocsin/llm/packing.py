"""Documents packed into sequences of a fixed length.

Lengths are whole numbers up to the sequence length, so all documents of a
length are alike and an instance is a histogram of at most that many counts,
however many documents there are.  The driver packs the histogram: first the
sets that dominate all others are fixed for good (Martello and Toth's
reduction), which leaves a smaller instance, then the rest is packed best-fit
by falling length.  Both work on whole counts at a time, so the result is a
short list of patterns, each with how often it is used.

Documents are then ranked within their length and each finds its place from
its rank.  Tokens never move: a task turns a text into the lengths and
checksums of its pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.functions.batches import text_parts
from tocsin.llm.common import pin, rank_in_groups

CAPACITY = 1024
END_ID = 2
#: Pieces that one task ranks, on average.
RANGE_ROWS = 20_000
#: White space other than lone blanks and line ends between other characters.
ODD_WHITE = (
    r"[\t\v\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \n][ \n]|^[ \n]|[ \n]$"
)
WHITE = re.compile(r"\s")
CACHED, CACHED_LENGTH = 500_000, 64
#: Bytes of texts that are cut into words together, and words that are encoded as one text.
TOGETHER, JOINED = 4_000_000, 1_000


class TokenIds:
    """Ids of whole texts, word by word; words seen before are looked up.

    Encoding words one by one gives the ids of the whole text, as a byte-level
    tokenizer splits a text at every single blank or line end between other
    characters before it merges anything.  Texts with other white space are
    encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are its threads
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        #: Ids of tokens that begin with a blank or a line end, as the byte-level alphabet writes them.
        self.opens = {" ": np.zeros(size, bool), "\n": np.zeros(size, bool)}
        for token, i in vocab.items():
            self.opens[" "][i] = token.startswith("\u0120")
            self.opens["\n"][i] = token.startswith("\u010a")
        self.known: dict[str, bytes] = {}

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in found]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words as they stand inside a text: after a blank, unless they bring a line end.

        Words of one kind are encoded as one text, which a token with the
        blank or line end in front cuts into words again.
        """
        found: dict[str, bytes] = {}
        alone = []
        kinds: dict[str, list[str]] = {" ": [], "\n": []}
        for word in words:
            lead, rest = ("\n", word[1:]) if word.startswith("\n") else (" ", word)
            (kinds[lead] if rest and not WHITE.search(rest) else alone).append(word)
        for lead, group in kinds.items():
            blank = " " if lead == " " else ""
            for at in range(0, len(group), JOINED):
                part = group[at : at + JOINED]
                ids = self.encode_whole([blank + blank.join(part)])[0]
                cuts = (4 * np.flatnonzero(self.opens[lead][np.frombuffer(ids, "<u4")])).tolist()
                if len(cuts) == len(part) and cuts[0] == 0:
                    ends = [*cuts[1:], len(ids)]
                    found.update((w, ids[a:b]) for w, a, b in zip(part, cuts, ends, strict=True))
                else:
                    alone += part
        whole = [w if w.startswith("\n") else " " + w for w in alone]
        return found | dict(zip(alone, self.encode_whole(whole), strict=True))

    def _by_words(self, texts: pa.Array) -> list[bytes]:
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        flat = cut.flatten().dictionary_encode()
        words, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
        known = self.known
        new = self._learn([w for w in words if w not in known])
        ids = [known[w] if w in known else new[w] for w in words]
        # The first word of a text has no blank before it.
        first = offsets[:-1]
        opening = list(dict.fromkeys(words[c] for c in codes[first]))
        place = {w: len(words) + i for i, w in enumerate(opening)}
        ids += self.encode_whole(opening)
        codes[first] = [place[words[c]] for c in codes[first]]
        if len(known) > CACHED:
            known.clear()
        known.update((w, c) for w, c in new.items() if len(w) <= CACHED_LENGTH)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        each = lengths[codes]
        ends = np.cumsum(each)
        at = np.repeat(starts[codes] - (ends - each), each) + np.arange(each.sum())
        placed = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        cuts = [0, *(4 * ends[offsets[1:] - 1]).tolist()]
        return [placed[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_batch(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text; texts are taken together up to ``TOGETHER`` bytes."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        odd = pc.match_substring_regex(texts, ODD_WHITE).to_numpy(zero_copy_only=False)
        found: list[bytes] = [b""] * len(texts)
        plain = np.flatnonzero(~odd)
        run = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)[plain]) // TOGETHER
        for part in np.split(plain, np.flatnonzero(np.diff(run)) + 1) if len(plain) else ():
            for i, ids in zip(part, self._by_words(texts.take(pa.array(part))), strict=True):
                found[i] = ids
        for i in np.flatnonzero(odd):
            found[i] = self.encode_whole([texts[i].as_py()])[0]
        return found


@lru_cache(1)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def piece_lengths(total: int, capacity: int) -> list[int]:
    """Only the first piece may be shorter than a longer document's others."""
    if total <= capacity:
        return [total]
    first = total % capacity
    return [first] * bool(first) + [capacity] * (total // capacity)


def _piece_rows(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    end = np.array([end_id], np.uint32).tobytes()
    for batch in (part for whole in batches for part in text_parts(whole, "_text", TOGETHER)):
        encoder, rows, owner = token_ids(path), [], []
        for i, ids in enumerate(encoder.encode_batch(pc.fill_null(batch.column("_text"), ""))):
            ids, start = ids + end, 0
            for piece, length in enumerate(piece_lengths(len(ids) // 4, capacity)):
                rows.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                owner.append(i)
                start += length
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(owner, pa.int32()))]
            + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )


Pattern = tuple[tuple[int, ...], int]  # lengths, times used


class Histogram:
    """Counts of lengths that are still to be packed."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        for length, count in counts.items():
            self.counts[length] += count

    def largest(self, limit: int) -> int:
        """The largest length up to ``limit`` that is left, or 0."""
        found = np.flatnonzero(self.counts[1 : limit + 1]) if limit > 0 else ()
        return int(found[-1]) + 1 if len(found) else 0

    def smallest(self, count: int) -> list[int]:
        """The ``count`` smallest pieces left."""
        found: list[int] = []
        for length in np.flatnonzero(self.counts):
            found += [int(length)] * min(int(self.counts[length]), count - len(found))
            if len(found) == count:
                break
        return found

    def take(self, lengths: tuple[int, ...]) -> int:
        """Use up the set as often as the counts allow."""
        kinds = set(lengths)
        times = min(int(self.counts[x]) // lengths.count(x) for x in kinds)
        for x in kinds:
            self.counts[x] -= times * lengths.count(x)
        return times


def best_pair(hist: Histogram, limit: int) -> tuple[int, int] | None:
    """Two pieces left with the largest sum up to ``limit``, the longer first."""
    best = None
    for a in np.flatnonzero(hist.counts[: limit + 1])[::-1]:
        a = int(a)
        if best and 2 * a < sum(best):
            break
        hist.counts[a] -= 1
        b = hist.largest(min(a, limit - a))
        hist.counts[a] += 1
        if b and (best is None or a + b > sum(best)):
            best = (a, b)
    return best


def reduce_by_dominance(hist: Histogram) -> list[Pattern]:
    """Fix sets that some best packing has in any case, longest pieces first.

    With a longest piece j in a sequence, a set {j, ...} dominates if the
    others that j could be with can be exchanged for it without loss:

    - nothing fits with j: {j};
    - some piece fills the rest exactly: {j, that piece}, as whatever else
      would be with j fits where that piece would be;
    - at most one more piece fits: {j, the longest that fits};
    - at most two fit: that set again if no two are longer together, else
      the two with the largest sum, if the longer of them is the longest that
      fits and no length lies between the shorter and what they leave.
    """
    fixed: list[Pattern] = []
    for j in range(hist.capacity, 0, -1):
        while hist.counts[j]:
            hist.counts[j] -= 1
            room = hist.capacity - j
            one = hist.largest(room)
            small = hist.smallest(3)
            one_more = len(small) < 2 or sum(small[:2]) > room
            two_more = len(small) < 3 or sum(small) > room
            pair = best_pair(hist, room) if one and one < room and two_more and not one_more else None
            hist.counts[j] += 1
            if not one:
                chosen = (j,)
            elif one == room or one_more:
                chosen = (j, one)
            elif two_more and (pair is None or sum(pair) <= one):
                chosen = (j, one)
            elif pair and pair[0] == one and hist.largest(room - one) == pair[1] and _no_better(hist, pair, room):
                chosen = (j, *pair)
            else:
                break
            times = hist.take(chosen)
            if not times:
                break
            fixed.append((chosen, times))
    return fixed


def _no_better(hist: Histogram, pair: tuple[int, int], room: int) -> bool:
    """No two other pieces fit of which one is longer than the pair's shorter and none as long as its longer."""
    a, b = pair
    middle = [int(x) for x in np.flatnonzero(hist.counts[b + 1 : a]) + b + 1]
    return not middle or middle[0] + hist.smallest(1)[0] > room


def best_fit(hist: Histogram) -> list[Pattern]:
    """Falling lengths, each to the open sequences with the least room that takes it.

    Sequences with the same contents are one group; a step fills a whole
    group or uses up a length, so there are few.
    """
    open_groups: dict[int, list[Pattern]] = {}
    done: list[Pattern] = []
    for length in range(hist.capacity, 0, -1):
        left = int(hist.counts[length])
        while left:
            room = min((r for r in open_groups if r >= length), default=None)
            if room is None:
                each = min(hist.capacity // length, left)
                times = left // each
                contents, room = (length,) * each, hist.capacity
            else:
                contents, times = open_groups[room].pop()
                if not open_groups[room]:
                    del open_groups[room]
                each = min(room // length, left)
                if left < times * each:
                    used = max(1, left // each)
                    if used < times:
                        open_groups.setdefault(room, []).append((contents, times - used))
                    times = used
                contents = contents + (length,) * each
            left -= times * each
            room -= length * each
            (open_groups.setdefault(room, []) if room else done).append((contents, times))
        hist.counts[length] = 0
    return done + [p for group in open_groups.values() for p in group]


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    hist = Histogram(counts, capacity)
    return reduce_by_dominance(hist) + best_fit(hist)


def place_rows(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """Where ranks of a length go: ``length, first rank, end rank, pieces a sequence, first sequence, offset``."""
    rows, rank, sequence = [], {}, 0
    for contents, times in patterns:
        offset = 0
        for length in dict.fromkeys(contents):
            each = contents.count(length)
            first = rank.get(length, 0)
            rows.append((length, first, first + each * times, each, sequence, offset))
            rank[length] = first + each * times
            offset += each * length
        sequence += times
    return rows


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Place every piece of every document in a sequence.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``.  A null text counts as empty and is its end id
    alone.  Equal lengths are interchangeable, repeated rows are pieces of
    their own, an empty table gives an empty result; extra columns are not
    read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["doc_id"]
    pieces = pin(rows.mapInArrow(
        lambda it: _piece_rows(it, tokenizer_path, capacity, end_id),
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long",
    ))
    # At most ``capacity`` rows.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    ranges = max(1, sum(counts.values()) // RANGE_ROWS)
    places = docs.sparkSession.createDataFrame(
        place_rows(pack_histogram(counts, capacity)),
        "length long, _first long, _end long, _each long, _sequence long, _at long",
    )
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(ranges))
    ranked = rank_in_groups(
        pieces.withColumn("_range", bucket), ["length"], "_range", ["doc_id", "piece", "start", "ids_crc32"], "_rank"
    )
    # A few rows for each length, however many documents.
    met = ranked.join(F.broadcast(places), "length").filter("_rank >= _first and _rank < _end")
    within = F.col("_rank") - F.col("_first")
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(within / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + (within % F.col("_each")) * F.col("length")).alias("offset"),
    )
