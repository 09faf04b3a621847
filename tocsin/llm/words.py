"""64-bit codes of the words of a text, computed on whole arrays of bytes.

A word's code is a polynomial over random values of its bytes, taken from one
running sum over the text; sums are cut into segments, so a text of any
length needs a bounded amount of memory besides its codes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEGMENT = 1 << 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Separates words at everything in ASCII that is neither letter nor digit.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of the input over all 64 bits (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


@lru_cache(2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)
    out = []
    for factor in (base, inverse):
        steps = np.full(length, factor, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _segment_codes(data: np.ndarray, separators: np.ndarray) -> np.ndarray:
    powers, inverses = _powers(max(SEGMENT, 1 << (len(data) + 1).bit_length()))
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def word_codes(text: bytes, separators: np.ndarray = WHITE) -> np.ndarray:
    """Codes of all words in order; equal words have equal codes."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= SEGMENT:
        return _segment_codes(data, separators)
    found, start = [], 0
    while start < len(data):
        end = min(start + SEGMENT, len(data))
        while end < len(data) and not separators[data[end]]:  # to the end of the word
            more = np.flatnonzero(separators[data[end : end + SEGMENT]])
            end = end + int(more[0]) if len(more) else min(end + SEGMENT, len(data))
        found.append(_segment_codes(data[start:end], separators))
        start = end
    return np.concatenate(found)


def shingle_codes(words: np.ndarray, width: int) -> np.ndarray:
    """Codes of all runs of ``width`` words; a shorter text is one run, no words are none."""
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    codes = np.full(count, width, np.uint64)
    for i in range(width):
        codes = mix(codes * MULTIPLIER + words[i : i + count])
    return codes
