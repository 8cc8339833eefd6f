"""Array primitives on the UTF-8 bytes of many texts at once (used inside Arrow batches).

A block is a run of whole texts: `data` holds their bytes end to end and `bounds` where each begins.
Everything is computed by array operations over the block, and hashes are 64-bit polynomials over
the bytes (prefix sums modulo 2**64) with a final mix, so a span costs a few operations whatever its
length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column of a batch with null texts as empty ones."""
    c = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(c.cast(pa.large_string()), "")


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES):
    """(first, last, data, bounds) for runs of texts of about `limit` bytes; a longer text is a run of its own."""
    n = len(texts)
    if n == 0:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


class Prefix:
    """Hashes of any spans of one block."""

    def __init__(self, data: np.ndarray):
        p, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


    def rolling(self, size: int) -> np.ndarray:
        """Hash of the `size` bytes at every position that has so many."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a text boundary."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends


def owner(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which text of the block each byte position belongs to."""
    return np.searchsorted(bounds, positions, "right") - 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every run of non-blank bytes."""
    starts, ends = runs(~BLANK[data], bounds)
    return starts, ends, owner(starts, bounds)


def windows(hashes: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every `size` consecutive words of one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:n] == text[size - 1:])
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h = (h ^ hashes[at + k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h), at


def strings(values, kind=pa.string()) -> pa.Array:
    return pa.array(values, kind)
