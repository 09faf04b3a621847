"""Names of a table found in texts by Aho-Corasick automata.

The names are cut into shards of bounded size; a shard's automaton passes
once over a text, whatever the number and length of its names.  Nothing is
shuffled: texts stay where they are and yield only what is found in them.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.functions.batches import text_parts

#: Characters of names in one shard; its automaton takes some hundred MB at most.
SHARD_CHARS = 4_000_000
#: Automata that a task keeps at a time.
KEPT_SHARDS = 2

# Blocks of scripts written without blanks between words: Thai to Myanmar, Khmer, kana, Han.
UNSPACED = (
    (0x0E00, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
)
UNSPACED_FIRST = [first for first, _ in UNSPACED]

Found = tuple[int, int, str, float]  # start, end, kind, score


@lru_cache(1 << 16)
def is_unspaced(char: str) -> bool:
    at = bisect_right(UNSPACED_FIRST, ord(char)) - 1
    return at >= 0 and ord(char) <= UNSPACED[at][1]


@lru_cache(1 << 16)
def is_word(char: str) -> bool:
    """A letter, a number or an underscore."""
    return char == "_" or unicodedata.category(char)[0] in "LN"


def reaches_edge(text: str, at: int, step: int) -> bool:
    """Whether a word may end before ``at``, going by ``step``.

    Marks are passed; a blank or the text's end ends a word, and so does a
    letter of a script without blanks.
    """
    while 0 <= at < len(text) and text[at] != " ":
        if is_word(text[at]):
            return is_unspaced(text[at])
        at += step
    return True


def lowered(text: str) -> tuple[str, list[int] | None]:
    """Lower-cased text and, where lengths differ, the place each character came from."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    low, places = "", []
    for i, char in enumerate(text):
        low += (part := char.lower())
        places += [i] * len(part)
    return low, places


class Automaton:
    """One shard of names, each with a kind and a score."""

    def __init__(self, names: list[tuple[str, str, float]]) -> None:
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for key, kind, score in names:
            self.trie.add_word(key, (len(key), kind, score))
        self.trie.make_automaton()

    def matches(self, low: str) -> Iterator[Found]:
        if not len(self.trie):
            return
        for last, (length, kind, score) in self.trie.iter(low):
            start, end = last - length + 1, last + 1
            if (is_unspaced(low[start]) or reaches_edge(low, start - 1, -1)) and (
                is_unspaced(low[last]) or reaches_edge(low, end, 1)
            ):
                yield start, end, kind, score


def keep_longest(found: list[Found]) -> list[Found]:
    """The longest name at each place that does not end inside an earlier one."""
    longest: dict[int, Found] = {}
    for name in found:
        if name[0] not in longest or longest[name[0]][1] < name[1]:
            longest[name[0]] = name
    kept, reach = [], -1
    for start in sorted(longest):
        if longest[start][1] > reach:
            kept.append(longest[start])
        reach = max(reach, longest[start][1])
    return kept


@lru_cache(KEPT_SHARDS)
def automaton_of(shard: Broadcast) -> Automaton:
    return Automaton(shard.value)


def scan(batches: Iterator[pa.RecordBatch], shards: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    """Names in ``message_id, _text``, a small part of a batch at a time.

    With more shards than are kept, every shard passes over a whole batch
    before the next one is built; only what it found stays in memory.
    """
    for batch in batches:
        parts = list(text_parts(batch, "_text"))
        for group in [[p] for p in parts] if len(shards) <= KEPT_SHARDS else [parts]:
            found: list[list[list[Found]]] = [[[] for _ in range(p.num_rows)] for p in group]
            for shard in shards:
                automaton = automaton_of(shard)
                for part, names in zip(group, found, strict=True):
                    for text, into in zip(part.column("_text"), names, strict=True):
                        into.extend(automaton.matches(lowered(text.as_py())[0]))
            for part, names in zip(group, found, strict=True):
                yield _named_rows(part, names)


def _named_rows(part: pa.RecordBatch, found: list[list[Found]]) -> pa.RecordBatch:
    rows, owner = [], []
    for at, names in enumerate(found):
        if not names:
            continue
        text = part.column("_text")[at].as_py()
        _, places = lowered(text)
        for start, end, kind, score in keep_longest(names):
            if places is not None:
                start, end = places[start], places[end - 1] + 1
            rows.append((text[start:end], kind, score, start, end))
            owner.append(at)
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [part.column("message_id").take(pa.array(owner, pa.int32()))]
        + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
        ["message_id", "text", "kind", "score", "start", "end"],
    )


def shards_of(names: DataFrame, shard_chars: int = SHARD_CHARS) -> list[Broadcast]:
    """Broadcast ``key, kind, score`` in shards of bounded size; the driver holds one shard at a time."""
    total = names.agg(F.sum(F.char_length("key"))).first()[0] or 0
    count = -(-total // shard_chars)
    context = names.sparkSession.sparkContext
    if count <= 1:
        return [context.broadcast([tuple(r) for r in names.select("key", "kind", "score").collect()])]
    # Shards are even but for chance: their mean is half the bound.
    shard = F.pmod(F.xxhash64("key"), F.lit(2 * count))
    return [
        context.broadcast([tuple(r) for r in names.where(shard == i).select("key", "kind", "score").collect()])
        for i in range(2 * count)
    ]


def find_names(df: DataFrame, names: DataFrame, *, text_col: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Names in each text: ``message_id, text, kind, score, start, end``.

    A name begins and ends where a word does, punctuation apart; in scripts
    without blanks every letter may begin or end one.
    """
    shards = shards_of(names, shard_chars)
    rows = df.select("message_id", F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    kind = dict(rows.dtypes)["message_id"]
    return rows.mapInArrow(
        lambda batches: scan(batches, shards),
        f"message_id {kind}, text string, kind string, score double, start int, end int",
    )
