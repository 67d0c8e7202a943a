"""Words, word hashes and word n-gram hashes of whole Arrow batches in numpy.

Texts stay UTF-8 bytes: every separator is ASCII, so word bounds and hashes
come from the batch's one data buffer without making Python strings.  Hashes
depend on content alone, so they agree between executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: A slice of a batch holds about this many text bytes; one longer text is a slice of its own.
SLICE_BYTES = 2_000_000
_POSITIONS = 1 << 16


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values over all bits (the public splitmix64 finaliser)."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U), 1)
_PLACE = mix(np.arange(_POSITIONS, dtype=U), 2) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: ``[^\x20\x09-\x0D]+``
BLACK = (~_SPACE, np.arange(256, dtype=np.uint8))
_alnum = np.zeros(256, bool)
_alnum[0x30:0x3A] = _alnum[0x61:0x7B] = _alnum[0x80:] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = (_alnum, _lower)


@dataclass
class Words:
    """Words of some texts: byte bounds, hashes, and ``first[d]:first[d + 1]`` for text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part's texts have about SLICE_BYTES."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.fromiter((len(x) for x in _views(batch.column(column))), np.int64, batch.num_rows))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _views(col: pa.Array) -> Iterator[memoryview]:
    raw, offsets = buffer(col)
    view = memoryview(raw)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield view[a:b]


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each text's offsets; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        col, wide = col.cast(pa.large_string()), True
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def words(col: pa.Array, kind: tuple[np.ndarray, np.ndarray] = BLACK, masked: bool = False) -> Words:
    """Words of each text.  ``masked``: every word with an ASCII digit hashes alike."""
    data, offsets = buffer(col)
    inside = kind[0][kind[1][data]]
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = (inside[0], inside[-1]) if len(data) else (False, False)
    cut = np.unique(offsets[1:-1])
    cut = cut[(cut > 0) & (cut < len(data))]
    joined = cut[inside[cut] & inside[cut - 1]]  # two texts' words touch here
    at = np.flatnonzero(edge)
    at = np.sort(np.concatenate([at, joined, joined])) if len(joined) else at
    start, end = at[::2], at[1::2]
    h = hashes(data, start, end, kind, inside)
    if masked and len(start):
        digits = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
        h = np.where(digits[end] > digits[start], U(0x5DEECE66D), h)
    return Words(data, start, end, h, np.searchsorted(start, offsets))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind, inside: np.ndarray) -> np.ndarray:
    """64-bit multilinear hash of each word's bytes, with its length."""
    if not len(start):
        return np.zeros(0, U)
    length = end - start
    letters = np.where(inside, _BYTE[kind[1][data]], U(0))[start[0] : end[-1]]
    place = np.arange(start[0], end[-1])
    place -= np.repeat(start, np.diff(np.append(start, end[-1])))
    letters *= _PLACE[place & (_POSITIONS - 1)] + (place >> 16).astype(U)
    return mix(np.add.reduceat(letters, start - start[0]) + length.astype(U))


_R = {1: 0x9E3779B97F4A7C15 | 1, 2: 0xC2B2AE3D27D4EB4F | 1}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U)
    step = 1
    factor = base
    while step < n:
        take = min(step, n - step)
        out[step : step + take] = out[:take] * U(factor)
        factor = factor * factor % (1 << 64)
        step *= 2
    return out


class Rolling:
    """Hashes of any run of words, from prefix sums."""

    def __init__(self, h: np.ndarray, which: int = 1):
        h = h if which == 1 else mix(h, 7)
        self.back = _powers(pow(_R[which], -1, 1 << 64), len(h) + 1)
        self.sum = np.zeros(len(h) + 1, U)
        np.cumsum(h * _powers(_R[which], len(h)), out=self.sum[1:])
        self.which = which

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.back[start] + (end - start).astype(U), self.which)

    def grams(self, k: int) -> np.ndarray:
        """Hash of k words from each place; places too near the end are left out."""
        n = len(self.sum) - k
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sum[k:] - self.sum[:n]) * self.back[:n] + U(k), self.which)


def argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (leftmost of equal ones) in each run of ``width``."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = best[: len(best) - step], best[step:]
        left = a <= b
        best, at = np.where(left, a, b), np.where(left, at[: len(at) - step], at[step:])
        size += step
    return at[:n]


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over places of one array of words: k words from here stay in one text."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return left >= k


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
