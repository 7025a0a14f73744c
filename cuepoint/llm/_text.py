"""Vectorised work on the bytes of many texts at once: words, lines and their hashes.

Words are runs of bytes other than space and 0x09-0x0D, which no multi-byte character contains. Words
and lines are hashed by tabulation: a random value for each byte at each place, added up and mixed, so
two different runs of any length and form meet with a probability of 2**-64 a pair.

``prefix_hashes`` gives polynomials modulo 2**64 over random byte values, for suffixes of a bounded
depth that are compared byte by byte where they agree; from about a thousand bytes on there are pairs of
strings (Thue-Morse) that such polynomials can't tell apart, whatever their base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(20240301).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, SLICE_BYTES + 65_536), _BASE, np.uint64)
        factors[0] = 1
        _powers = np.cumprod(factors, dtype=np.uint64)
    return _powers[:n]


#: Random values by place (up to 256) and byte; later places mix the place into them.
_TABLE = np.random.default_rng(20240315).integers(0, 1 << 64, 1 << 16, dtype=np.uint64)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of bytes that follow one another without overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    step = np.zeros(len(data), np.int64)
    step[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(data)) - np.cumsum(step)
    values = _TABLE[((place & 255) << 8) | data]
    if int((ends - starts).max()) > 256:
        far = np.flatnonzero(place > 255)
        values[far] = mix(values[far] + (place[far] >> 8).astype(np.uint64) * _BASE)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``P`` such that bytes a to b hash to ``(P[b] - P[a]) * power(len - a)``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of spans; equal bytes give equal hashes within one ``prefix`` and, as lengths are
    brought to a fixed power, across all of them."""
    return mix((prefix[ends] - prefix[starts]) * _inverse_powers(len(prefix))[starts] + (ends - starts).astype(np.uint64))


_inverses = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        factors = np.full(max(n, SLICE_BYTES + 65_536), np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        factors[0] = 1
        _inverses = np.cumprod(factors, dtype=np.uint64)
    return _inverses[:n]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of the column's texts in bounded pieces; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        own = offsets[first : last + 1]
        yield first, data[own[0] : own[-1]], own - own[0]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z lower-cased; other bytes as they are."""
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words and the text that each is in."""
    inside = ~_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    heads, tails = offsets[full], offsets[full + 1] - 1
    begin[heads], end[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def windows(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words of one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    total = hashes[at] * _FACTORS[0]
    for k in range(1, size):
        total += hashes[at + k] * _FACTORS[k]
    return mix(total), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each text's set of word shingles as a sorted array of distinct hashes.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    low = lowered(data)
    starts, ends, text = words(low, offsets)
    hashes = run_hashes(low, starts, ends)
    shingles, at = windows(hashes, text, size)
    counts = np.bincount(text, minlength=len(offsets) - 1)
    per = np.maximum(counts - size + 1, 0)
    cuts = np.append(0, np.cumsum(per))
    out = [np.unique(shingles[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    first = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        own = hashes[first[i] : first[i] + counts[i]]
        out[i] = mix((own * _FACTORS[8 : 8 + len(own)]).sum(dtype=np.uint64, keepdims=True) + _FACTORS[16 + len(own)])
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that come twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys
