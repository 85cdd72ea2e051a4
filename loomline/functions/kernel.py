"""Vectorised text handling: Arrow string buffers in, word boundaries and word ids out.

Texts of a batch are looked at as one array of code points, so the cost is a few numpy passes
over the characters instead of a Python call per word.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_WORD = 48
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[[ord(c) for c in WHITE_SPACE]] = SPACE
    return table


@lru_cache(1)
def word_table() -> np.ndarray:
    """In one row, 1 for every code point that is alphabetic or a number."""
    table = np.zeros((1, sys.maxunicode + 1), np.uint8)
    every = "".join(" " if 0xD800 <= cp < 0xE000 else chr(cp) for cp in range(sys.maxunicode + 1))
    for m in regex.finditer(r"[\p{Alphabetic}\p{N}]+", every):
        table[0, m.start() : m.end()] = 1
    return table


@lru_cache(1)
def lower_table() -> np.ndarray:
    """One-to-one lower case of every code point (characters whose lower case is longer stay)."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for cp in range(sys.maxunicode + 1):
        low = chr(cp).lower()
        if len(low) == 1:
            table[cp] = ord(low)
    return table


_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for at least ``n`` places."""
    if not _tables or len(_tables[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _tables[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m)]), dtype=np.uint64) for m in (_MULTIPLIER, _INVERSE)]
    return _tables


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts (null as empty) and the offsets of the texts in them."""
    filled = texts.fill_null("") if texts.null_count else texts
    raw = pa.concat_arrays([filled.cast(pa.large_string())])
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    buffer = raw.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    cps = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cps) == len(data):
        return cps, offsets
    first = np.flatnonzero((data & 0xC0) != 0x80)
    return cps, np.searchsorted(first, offsets)


def slices(texts: pa.Array, most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text each; a longer text is a range of its own."""
    filled = texts.fill_null("") if texts.null_count else texts
    sizes = np.asarray(pa.compute.binary_length(filled), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def runs(kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the maximal runs of one class, never across two texts."""
    n = len(kinds)
    if n == 0:
        return np.empty(0, np.int64)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=new[1:])
    inner = offsets[(offsets > 0) & (offsets < n)]
    new[inner] = True
    return np.flatnonzero(new)


def hashes(cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial of its code points, from prefix sums over all characters."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    up, down = _powers(len(cps) + 1)
    sums = np.empty(len(cps) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(cps * up[: len(cps)], out=sums[1:])
    return mix((sums[starts + lengths] - sums[starts]) * down[starts] ^ (lengths.astype(np.uint64) << np.uint64(48)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``values[s : s + c]`` over all starts and counts."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return values[np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)]
