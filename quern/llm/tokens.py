"""Words of many texts at once: NumPy over the UTF-8 bytes of an Arrow column, without a Python object for each word.

A word's fingerprint is a polynomial over its bytes (each byte replaced by a fixed random 64-bit number), mixed with its
length; a window's fingerprint combines those of its words in order.  Fingerprints have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RANDOM = np.random.default_rng(20240229)
_BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=U64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes worked on at a time; a longer text is worked on whole.
CHUNK_BYTES = 1 << 20

_powers = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(np.concatenate(([U64(1)], np.cumprod(np.full(size - 1, x, U64)))) for x in (_BASE, _BASE_INVERSE))
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_class(inside) -> np.ndarray:
    """A table of 256 booleans from a predicate over byte values (after lower-casing A-Z)."""
    return np.array([bool(inside(b)) for b in range(256)])


#: ``[^\\x20\\x09-\\x0D]`` and ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALPHANUMERIC = byte_class(lambda b: not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F))
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_AS_IS >= 65) & (_AS_IS <= 90), _AS_IS + 32, _AS_IS).astype(np.uint8)


@dataclass
class Words:
    """The words of a run of texts: byte offsets into ``data``, fingerprints, and ``first[i]:first[i + 1]`` for text i."""

    data: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    marks: np.ndarray
    first: np.ndarray


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and each value's offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to ``most`` bytes each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    n, texts = len(data), len(offsets) - 1
    if lower:
        data = _LOWER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    mask = np.concatenate(([False], inside[data], [False]))
    starts = np.flatnonzero(mask[1:-1] & (~mask[:-2] | edge[:-1]))
    ends = np.flatnonzero(mask[1:-1] & (~mask[2:] | edge[1:])) + 1
    return Words(data, offsets, starts, ends, spans(data, starts, ends), np.searchsorted(starts, offsets))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of byte spans."""
    return Sums(_BYTE_CODES[data]).spans(starts, ends)


class Sums:
    """Fingerprints of any spans of a row of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _power_tables(len(codes) + 1)
        self.sums = np.concatenate(([U64(0)], np.cumsum(codes * up[: len(codes)])))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64) * _PLACES[63])


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of ``size`` words within one text, and the first window of each text.

    A window's first word is the word with the same rank in its text.
    """
    counts = np.diff(w.first)
    per_text = np.maximum(counts - size + 1, 0)
    first = np.concatenate(([0], np.cumsum(per_text)))
    total = len(w.marks) - size + 1
    if total <= 0:
        return np.zeros(0, U64), first
    hashes = w.marks[:total] * _PLACES[0]
    for k in range(1, size):
        hashes += w.marks[k : total + k] * _PLACES[k]
    at = np.repeat(w.first[:-1] - first[:-1], per_text) + np.arange(first[-1])
    return mixed(hashes[at] + U64(size)), first


def whole(w: Words, text: int) -> np.ndarray:
    """The fingerprint of a short text's words as one window of their number."""
    own = w.marks[w.first[text] : w.first[text + 1]]
    return mixed((own * _PLACES[: len(own)]).sum(dtype=U64, keepdims=True) + U64(len(own)))


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct windows, sorted, and where each text's begin; fewer words than ``size`` make one window."""
    hashes, first = windows(w, size)
    counts, sets = np.diff(w.first), []
    for i, n in enumerate(counts):
        sets.append(np.unique(hashes[first[i] : first[i + 1]]) if n >= size else whole(w, i) if n else hashes[:0])
    return np.concatenate(sets) if sets else hashes[:0], np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)
