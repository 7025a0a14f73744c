"""Words of many texts as codes into a dictionary, exact and without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs of set flags and the text that each is in; texts' borders end runs."""
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(offsets))
    heads, tails = offsets[full], offsets[full + 1] - 1
    begin[heads], end[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def packed(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte strings that lie one behind the other; ``ends`` are theirs."""
    edges = np.zeros(len(ends) + 1, np.int64)
    edges[1:] = ends
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(np.frombuffer(data, np.uint8)))])


def unpacked(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """Bytes and ends of byte strings, as ``packed`` takes them."""
    values = values.cast(pa.large_binary())
    edges = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return (b"" if data is None else data[int(edges[0]) : int(edges[-1])].to_pybytes()), edges[1:] - edges[0]


def coded(words: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """A code for each word, and the distinct words by code."""
    if not words:
        return np.zeros(0, np.int32), packed(b"", np.zeros(0, np.int64))
    one = words[0] if len(words) == 1 else pa.concat_arrays(words)
    found = one.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary
