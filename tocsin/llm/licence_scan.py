"""Licence statements in texts, by Dice coefficient over word bigrams.

A text is compared whole, by its paragraphs and by its lines, and in passages:
stretches of words wherever they begin and end.  With a set of
``a`` bigrams against a template's ``b`` the coefficient is at most
``2 min(a, b) / (a + b)``, so only templates of about the same size can reach
the threshold; the others are skipped unseen.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.licence_texts import TEMPLATES

LEAST = 0.8
WORD = re.compile(r"[a-z0-9]+")
PARAGRAPH = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*")
LINE = re.compile(r"[^\n]*\S[^\n]*")
Match = tuple[str, int, str, int, int, float]  # licence, template, level, start, end, coefficient


def bigrams(text: str) -> set[tuple[str, str]]:
    words = WORD.findall(text.lower())
    return set(zip(words, words[1:], strict=False))


def units(text: str) -> Iterator[tuple[str, int, int]]:
    """Level, start and end of the whole text, of its paragraphs and of their lines.

    A paragraph that is the only one, or a line that is, is not listed again.
    """
    paragraphs = [m.span() for m in PARAGRAPH.finditer(text)]
    if paragraphs:
        yield "text", 0, len(text)
    for start, end in paragraphs:
        if len(paragraphs) > 1:
            yield "paragraph", start, end
        lines = [m.span() for m in LINE.finditer(text, start, end)]
        if len(lines) > 1:
            for line in lines:
                yield "line", *line


class Templates:
    """Templates by number of bigrams, and in which of them a bigram is."""

    def __init__(self, texts: list[tuple[str, str]], least: float) -> None:
        sets = sorted(
            ((len(b), i, name, b) for i, (name, text) in enumerate(texts) if (b := bigrams(text))),
            key=lambda x: x[:2],
        )
        self.least = least
        self.sizes = [x[0] for x in sets]
        self.names = [(x[2], x[1]) for x in sets]
        self.grams = [x[3] for x in sets]
        self.at = {name: at for at, name in enumerate(self.names)}
        self.holders: dict[tuple[str, str], list[int]] = defaultdict(list)
        for at, (_, _, _, grams) in enumerate(sets):
            for gram in grams:
                self.holders[gram].append(at)
        self.known = set(self.holders)

    def possible(self, grams: set[tuple[str, str]]) -> list[int]:
        """Templates with so many bigrams in a text that a passage of it can reach the threshold."""
        shared = Counter(at for g in grams & self.known for at in self.holders[g])
        return sorted(at for at, n in shared.items() if n >= self.sizes[at] * self.least / (2 - self.least) - 1e-9)

    def best(self, grams: set[tuple[str, str]]) -> tuple[float, str, int] | None:
        """The best template with at least the threshold; ties go to the earlier name, then template."""
        size = len(grams)
        low = bisect_left(self.sizes, math.ceil(size * self.least / (2 - self.least) - 1e-9))
        high = bisect_right(self.sizes, size * (2 - self.least) / self.least + 1e-9)
        if low >= high:
            return None
        shared = Counter(at for g in grams if g in self.holders for at in self.holders[g] if low <= at < high)
        found = [
            (-2 * n / (size + self.sizes[at]), *self.names[at]) for at, n in shared.items()
            if 2 * n / (size + self.sizes[at]) >= self.least
        ]
        if not found:
            return None
        score, name, template = min(found)
        return -score, name, template


def placed_words(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of a text, and where they start and end in it."""
    small = text.lower()
    spans = [m.span() for m in WORD.finditer(small)]
    words, starts, ends = [small[a:b] for a, b in spans], [a for a, _ in spans], [b for _, b in spans]
    if len(small) != len(text):  # a few capitals have two characters in lower case
        place = [i for i, c in enumerate(text) for _ in c.lower()]
        starts, ends = [place[a] for a in starts], [place[b - 1] + 1 for b in ends]
    return words, starts, ends


class Firsts:
    """The places from a start on where a bigram stands for the first time, kept while the start moves right.

    Every place enters and leaves once, however often the text repeats itself.
    """

    def __init__(self, before: np.ndarray) -> None:
        self.before = before.tolist()
        after = np.full(len(before), len(before), np.int64)
        again = np.flatnonzero(before >= 0)
        after[before[again]] = again
        self.after = after.tolist()
        self.start = self.reach = 0
        self.places: deque[int] = deque()

    def moved(self, start: int, count: int) -> list[int]:
        """The first ``count`` such places, or all."""
        if start >= self.reach:
            self.reach = start
            self.places.clear()
        else:
            for place in range(self.start, start):
                self.places.popleft()
                if self.after[place] < self.reach:
                    self._insert(self.after[place])
        self.start = start
        while self.reach < len(self.before) and len(self.places) < count:
            if self.before[self.reach] < start:
                self.places.append(self.reach)
            self.reach += 1
        return list(islice(self.places, count))

    def _insert(self, place: int) -> None:
        # A repeated bigram mostly comes back near the end of what is known.
        back = []
        while self.places and self.places[-1] > place:
            back.append(self.places.pop())
        self.places.append(place)
        self.places.extend(reversed(back))


def windows(grams: list[tuple[str, str]], before: np.ndarray, known: set, least: float) -> list[tuple[float, int, int, int]]:
    """Disjoint stretches of bigrams that reach the threshold, best first: coefficient, shared bigrams, first and last place.

    ``before`` has the place where each bigram last was, or -1.  A best
    stretch begins with a shared bigram and ends with one that is new in it,
    so only first places are looked at, as many as a stretch can hold.
    """
    hit = [g in known for g in grams]
    size, found = len(known), []
    most = size * (2 - least) / least
    firsts, count = Firsts(before), int(most + 1e-9)
    for start in (i for i, shared in enumerate(hit) if shared):
        shared, best, best_shared, end = 0, 0.0, 0, start
        for different, place in enumerate(firsts.moved(start, count), 1):
            shared += hit[place]
            dice = 2 * shared / (different + size)
            if dice > best:
                best, best_shared, end = dice, shared, place
        if best >= least:
            found.append((best, best_shared, start, end))
    taken: list[tuple[int, int]] = []
    kept = []
    for window in sorted(found, key=lambda x: (-x[0], x[2])):
        at = bisect_left(taken, (window[2], window[2]))
        if (at == 0 or taken[at - 1][1] < window[2]) and (at == len(taken) or taken[at][0] > window[3]):
            taken.insert(at, window[2:])
            kept.append(window)
    return kept


def overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of some disjoint spans in order shares a character with this one."""
    at = bisect_left(spans, (end, end))
    return at > 0 and spans[at - 1][1] > start


def passages(text: str, whole: set[tuple[str, str]], templates: Templates, units_found: list[Match]) -> list[Match]:
    """Stretches of words that state a licence, but for those that a unit or a fuller passage explains.

    Another match explains a passage if they overlap and its template holds
    more than half of what the passage shares with its own.
    """
    possible = templates.possible(whole)
    if not possible:
        return []
    words, starts, ends = placed_words(text)
    grams = list(zip(words, words[1:], strict=False))
    last: dict[tuple[str, str], int] = {}
    before = np.empty(len(grams), np.int64)
    for i, gram in enumerate(grams):
        before[i] = last.get(gram, -1)
        last[gram] = i
    found = [
        (shared, dice, at, first, end) for at in possible
        for dice, shared, first, end in windows(grams, before, templates.grams[at], templates.least)
    ]
    found.sort(key=lambda x: (-x[0], -x[1], templates.names[x[2]], x[3]))
    others: dict[int, list[tuple[int, int]]] = defaultdict(list)  # matches so far by template
    for name, template, _, start, end, _ in units_found:
        others[templates.at[name, template]].append((start, end))
    chosen = []
    fuller: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for _, dice, at, first, end in found:
        a, b = starts[first], ends[end + 1]
        mine = set(grams[first : end + 1]) & templates.grams[at]
        alike = [t for t in {*others, *fuller} if 2 * len(mine & templates.grams[t]) > len(mine)]
        if any(overlaps(fuller[t], a, b) for t in alike if t in fuller):
            continue
        fuller[at].insert(bisect_left(fuller[at], (a, b)), (a, b))
        if not any(c < b and d > a for t in alike for c, d in others.get(t, ())):
            chosen.append((*templates.names[at], "passage", a, b, dice))
    return sorted(chosen, key=lambda m: (m[3], m[4], m[0], m[1]))


def scan_text(text: str | None, templates: Templates) -> list[Match]:
    found, whole = [], set()
    for level, start, end in units(text or ""):
        grams = bigrams(text[start:end])
        whole = grams if level == "text" else whole
        best = templates.best(grams)
        if best:
            found.append((best[1], best[2], level, start, end, best[0]))
    return found + passages(text, whole, templates, found) if whole else found


def _scan_rows(batches: Iterator[pa.RecordBatch], texts: list[tuple[str, str]], least: float) -> Iterator[pa.RecordBatch]:
    templates = Templates(texts, least)
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
    for batch in batches:
        rows, owner = [], []
        for i, text in enumerate(batch.column("_text")):
            found = scan_text(text.as_py(), templates)
            rows += found
            owner += [i] * len(found)
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(owner, pa.int32()))]
            + [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            ["doc_id", "licence", "template", "level", "start", "end", "dice"],
        )


def find_licences(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    least: float = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every text, paragraph, line or passage that states a licence, with the best template.

    A passage is a stretch of words, wherever it begins and ends, that no
    match overlapping it explains.

    Returns ``doc_id, licence, template, level, start, end, dice``; spans are
    code points, end exclusive.  Null and empty texts and units of fewer than
    two words have none; repeated rows are scanned alike.
    """
    known = TEMPLATES if templates is None else templates
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        lambda it: _scan_rows(it, known, least),
        f"doc_id {kind}, licence string, template int, level string, start long, end long, dice double",
    )
