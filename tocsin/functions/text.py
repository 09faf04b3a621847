"""Column functions for message text.  All but ``to_nfc`` stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin import config as C
from tocsin.functions.batches import PART_BYTES, bounds, text_sizes


def is_blank(text: Column) -> Column:
    """True for null and for text of white space only."""
    return text.isNull() | ~text.rlike(C.NOT_SPACE)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{C.SPACE}+|{C.SPACE}+$", "")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.coalesce(found, no_strings())


def no_strings() -> Column:
    return F.expr("cast(array() as array<string>)")


# Cheap tests that spare most text the search with the full pattern.

def may_hold_url(text: Column) -> Column:
    return text.contains("://") | text.rlike(r"[wW]{3}\.")


def may_hold_mention(text: Column) -> Column:
    return text.contains("@")


def may_hold_hashtag(text: Column) -> Column:
    return text.contains("#")


def drop(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def collapse_spaces(text: Column) -> Column:
    # A single blank is no match: most texts are then searched and not rebuilt.
    return F.trim(F.regexp_replace(text, f" {C.SPACE}+|[{C.SPACE}&&[^ ]]{C.SPACE}*", " "))


def clip(text: Column, length: int, mark: str = "...") -> Column:
    """First ``length`` characters, with a mark if something was cut."""
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(mark))
    ).otherwise(text)


def segment_hashtags(text: Column) -> Column:
    """Drop ``#`` and split CamelCase inside hashtags; other text stays."""
    pieces = find_all(text, f"(?s)#{C.WORD}+|[^#]+|#")
    split = F.transform(
        pieces,
        lambda p: F.when(
            p.startswith("#") & (F.length(p) > 1),
            F.regexp_replace(F.regexp_replace(p, "^#", ""), C.CAMEL_PATTERN, " "),
        ).otherwise(p),
    )
    return F.when(may_hold_hashtag(text), F.array_join(split, "")).otherwise(text)


# --- symbols -------------------------------------------------------------

# Unicode blocks that hold pictographic symbols, and symbols outside them.
SYMBOL_BLOCKS = (
    (0x2600, 0x27BF), (0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F7E0, 0x1F7EB), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF),
)
LONE_SYMBOLS = (0x203C, 0x2049, 0x231A, 0x231B, 0x23F0, 0x23F1, 0x23F2, 0x23F3, 0x2B50, 0x2B55, 0x1F004, 0x1F0CF, 0x1F18E)
# The five skin tones, from light to dark, and what joins or styles the parts of a sequence.
SKIN_TONES = {
    0x1F3FB: "light_skin_tone", 0x1F3FC: "medium_light_skin_tone", 0x1F3FD: "medium_skin_tone",
    0x1F3FE: "medium_dark_skin_tone", 0x1F3FF: "dark_skin_tone",
}
EMOJI_STYLE, JOINER, KEYCAP = "\ufe0f", "\u200d", "\u20e3"
REGIONAL, TAG = 0x1F1E6, 0xE0000
FLAG = "[\\x{1F1E6}-\\x{1F1FF}]{2}"
KEYCAPS = "[0-9#*]\\x{FE0F}?\\x{20E3}"
TAGGED = "\\x{1F3F4}[\\x{E0020}-\\x{E007E}]+\\x{E007F}"


@lru_cache(maxsize=1)
def symbol_aliases() -> dict[str, str]:
    """Symbol -> word, by rule from the Unicode character names."""
    points = [p for first, last in SYMBOL_BLOCKS for p in range(first, last + 1)]
    names = ((chr(p), unicodedata.name(chr(p), "")) for p in (*points, *LONE_SYMBOLS))
    by_rule = {s: n.lower().replace(" ", "_") for s, n in names if n}
    return {**by_rule, **{chr(p): n for p, n in SKIN_TONES.items()}, **C.SYMBOL_NAMES}


def _runs(points: list[int], gap: int = 1) -> list[tuple[int, int]]:
    """Sorted code points as (first, last) runs, joining gaps up to ``gap``."""
    runs: list[list[int]] = []
    for p in points:
        if runs and p - runs[-1][1] <= gap:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return [(a, b) for a, b in runs]


def _ranges(points: list[int], gap: int = 1) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _runs(points, gap))


def _within(points: list[int], ranges: str) -> str:
    """Character class that tests the outer bounds before the many ranges."""
    return f"[\\x{{{points[0]:x}}}-\\x{{{points[-1]:x}}}&&[{ranges}]]"


def symbols_to_words(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Replace each symbol or sequence of symbols by one word with a space on both sides.

    A sequence is a base with a style, a skin tone and further bases behind
    joiners; its word has the words of its parts.  Flags become ``flag_`` and
    their letters, keycaps ``keycap_`` and their character.  Sequences that
    ``aliases`` names go first.  Single symbols are looked up by code point
    in literal arrays, one per run of code points, so a lookup costs one
    subtraction; text without symbols is not split.
    """
    aliases = symbol_aliases() if aliases is None else aliases
    sequences = sorted((s for s in aliases if len(s) > 1), key=len, reverse=True)
    for symbol in sequences:
        text = F.replace(text, F.lit(symbol), F.lit(f" {aliases[symbol]} "))
    points = sorted(ord(s) for s in aliases if len(s) == 1)
    if not points:
        return text
    symbol = _within(points, _ranges(points))
    part = f"{symbol}\\x{{FE0F}}?[\\x{{1F3FB}}-\\x{{1F3FF}}]?\\x{{FE0F}}?"
    cluster = f"{FLAG}|{KEYCAPS}|{TAGGED}|{part}(?:\\x{{200D}}{part})*"

    def name_of(char: Column) -> Column:
        name = F.lit("")
        for first, last in _runs(points, gap=512):
            words = "|".join(aliases.get(chr(p), "") for p in range(first, last + 1))
            at = F.ascii(char) - F.lit(first - 1)
            name = F.when(
                F.ascii(char).between(first, last),
                F.element_at(F.split(F.lit(words), r"\|"), at),
            ).otherwise(name)
        return name

    def letters(piece: Column, base: int) -> Column:
        return F.array_join(F.transform(F.split(piece, ""), lambda c: F.char(F.ascii(c) - F.lit(base))), "")

    def word_of(piece: Column) -> Column:
        first = F.substring(piece, 1, 1)
        keys = F.when(first == "#", "hash").when(first == "*", "asterisk").otherwise(first)
        bases = F.split(F.translate(piece, EMOJI_STYLE + JOINER, ""), "")
        return (
            F.when(piece.rlike(f"^{FLAG}"), F.concat(F.lit("flag_"), letters(piece, REGIONAL - ord("a"))))
            .when(piece.rlike(f"^{KEYCAPS}"), F.concat(F.lit("keycap_"), keys))
            .when(
                piece.rlike(f"^{TAGGED}"),
                F.concat(F.lit("flag_"), letters(F.regexp_replace(piece, "^.|.$", ""), TAG)),
            )
            .otherwise(F.array_join(F.transform(bases, name_of), "_"))
        )

    starts = f"\\x{{1F1E6}}-\\x{{1F1FF}}0-9#*{_ranges(points)}"
    pieces = find_all(text, f"{cluster}|[^{starts}]+|(?s:.)")
    named = F.transform(
        pieces, lambda p: F.when(p.rlike(f"^(?:{cluster})$"), F.concat(F.lit(" "), word_of(p), F.lit(" "))).otherwise(p)
    )
    # One range goes before the alternatives: most text ends there.
    lowest = min(points[0], ord(KEYCAP))
    present = text.rlike(f"[\\x{{{lowest:x}}}-\\x{{10FFFF}}]") & text.rlike(f"{symbol}|{FLAG}|\\x{{20E3}}")
    return F.when(present, F.array_join(named, "")).otherwise(text)


# --- normal form ---------------------------------------------------------

@lru_cache(maxsize=1)
def unstable_class() -> str:
    """Characters whose presence can make NFC change a text, by rule.

    These are all marks, the characters that are not in NFC themselves and
    those that can be the second half of a composition.  A few more are let
    in to keep the class short; they only cost a needless check.
    """
    points = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for point in range(0x300, 0x323B0):
        char = chr(point)
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            points.add(int(parts[1], 16))
        if not unicodedata.is_normalized("NFC", char):
            points.add(point)
    unmarked = sorted(p for p in points if unicodedata.category(chr(p))[0] != "M")
    return _within([0x300, 0x10FFFF], "\\p{M}" + _ranges(unmarked, gap=200))


@F.arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    parts = [
        pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts[low:high].to_pylist()], pa.string())
        for low, high in bounds(text_sizes(texts), PART_BYTES)
    ]
    return pa.concat_arrays(parts) if parts else texts


# Marked as not repeatable so that the optimiser does not copy the cleaning
# steps before it into every later filter on the cleaned text.  Filters on
# other columns belong before the cleaning.
_nfc = _nfc.asNondeterministic()


def to_nfc(text: Column) -> Column:
    """Unicode NFC.  Only text that could change is sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(unstable_class()), text)), text)


def drop_zero_width(text: Column) -> Column:
    present = reduce(or_, [text.contains(char) for char in C.ZERO_WIDTH])
    return F.when(present, F.translate(text, C.ZERO_WIDTH, "")).otherwise(text)
