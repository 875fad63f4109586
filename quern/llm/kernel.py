"""Vectorised text kernels: whole Arrow batches are handled as numpy arrays, never word by word in Python.

A batch of texts becomes one array of code points with a line feed between texts.  Words are runs of letters,
digits and marks, lower-cased; everything else separates them.  A word's hash is a polynomial over its
characters taken from one running sum, so that hashing costs a few nanoseconds a character.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

U64 = np.uint64
#: Texts are handled in slices of about this many characters; a longer text is a slice of its own.
SLICE_CHARS = 1 << 18
_P = 0x9E3779B97F4A7C15
_STATE: dict[str, np.ndarray] = {}


def fold_table(first: int = 0, last: int = 1 << 16) -> np.ndarray:
    """For each of a range of code points: itself lower-cased if it is a letter, digit or mark, else 0.

    One character becomes one: of the only longer form, that of the dotted capital I, the i stays.
    """
    name = f"fold{first}"
    if name not in _STATE:
        table = np.zeros(last - first, np.uint32)
        for cp in range(first, last):
            c = chr(cp)
            if unicodedata.category(c)[0] in "LNM":
                table[cp - first] = ord(c.lower()[0])
        _STATE[name] = table
    return _STATE[name]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int, base: int, name: str) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, kept for the life of the worker."""
    have = _STATE.get(name)
    if have is None or len(have) < n:
        size = 1 << max(19, int(n - 1).bit_length())
        table = np.full(size, U64(base))
        table[0] = 1
        have = _STATE[name] = np.multiply.accumulate(table)
    return have[:n]


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most ``limit`` characters; a longer text comes alone."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, a line feed after each, and where each text starts (with the end, n+1 values)."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens, out=starts[1:])
    joined = "\n".join(texts) + "\n" if texts else ""
    order = "utf-32-le" if sys.byteorder == "little" else "utf-32-be"
    return np.frombuffer(joined.encode(order, "surrogatepass"), np.uint32), starts


def fold(cps: np.ndarray) -> np.ndarray:
    """Lower-cased code points of words; 0 for whatever separates them."""
    table = fold_table()
    if len(cps) and cps.max() >= 1 << 16:
        out = table[np.minimum(cps, 0xFFFF)]
        high = cps >= 1 << 16
        out[high] = fold_table(1 << 16, sys.maxunicode + 1)[cps[high] - (1 << 16)]
        return out
    return table[cps]


def running(values: np.ndarray, salt: int = 0) -> tuple[np.ndarray, int]:
    """The running sum that hashes of ranges of values are taken from."""
    x = values.astype(U64)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= powers(len(x), _P + 2 * salt, f"p{salt}")
    sums = np.zeros(len(x) + 1, U64)
    np.cumsum(x, out=sums[1:])
    return sums, salt


def range_hashes(sums: tuple[np.ndarray, int], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges start:end (0-valued elements don't count)."""
    total, salt = sums
    h = total[end] - total[start]
    h *= powers(len(total), pow(_P + 2 * salt, -1, 1 << 64), f"i{salt}")[start]
    h ^= (end - start).astype(U64) << U64(48)
    return mix(h)


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of values[start:end] for many ranges at once."""
    return range_hashes(running(values, salt), start, end)


def words(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, in order."""
    w = fold(cps)
    on = np.zeros(len(w) + 2, bool)
    on[1:-1] = w != 0
    edges = np.flatnonzero(on[1:] != on[:-1])
    start, end = edges[0::2], edges[1::2]
    return run_hashes(w, start, end), start, end


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty ranges give 0."""
    sums = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64) if values.dtype.kind in "iub" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
