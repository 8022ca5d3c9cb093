"""Word hashing over the UTF-8 buffers of Arrow string columns.

A word has two lanes of 64 bits. Words of up to 64 bytes are absorbed by numpy, eight bytes of all words at a time, and both lanes
are mixed after each step, with seeds of their own; words of up to eight bytes never agree in a lane. Longer words, and
sequences of any length, are hashed by BLAKE2b. Nothing is linear in bytes or words, so no order of them makes different ones agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on 64-bit words."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(33))
        x = x * U(0xFF51AFD7ED558CCD)
        x ^= x >> U(33)
        x = x * U(0xC4CEB9FE1A85EC53)
        x ^= x >> U(33)
    return x


_LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], U)
_ODD = np.array([0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9], U)


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit lanes of each part ``start[i]:end[i]`` of the bytes, by BLAKE2b."""
    view = memoryview(np.ascontiguousarray(data))
    return np.frombuffer(b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), U).reshape(-1, 2)


def lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two lanes of each word of the bytes, one row for each."""
    size = end - start
    out = mix(size.astype(U)[:, None] + _SEEDS)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    for at in range(0, min(int(size.max(initial=0)), _LONG), 8):
        some = np.flatnonzero((size > at) & (size <= _LONG)) if at or size.max() > _LONG else slice(None)
        eight = eights[start[some] + at] & _MASKS[np.minimum(size[some] - at, 8)]
        with np.errstate(over="ignore"):
            out[some] = mix((out[some] ^ eight[:, None]) * _ODD)
    long = np.flatnonzero(size > _LONG)
    if len(long):
        out[long] = digests(data, start[long], end[long])
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """The words of a batch: ``start`` and ``end`` in bytes, ``first[i]:first[i + 1]`` the words of text i, ``lanes`` their two hashes."""

    def __init__(self, column: pa.Array, lower: bool = False, hashes: bool = True):
        self.raw, self.at = buffers(column)
        inside = ~_SPACES[self.raw]
        n = len(self.raw)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edge = self.at[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.at)
        if hashes:
            self.lanes = lanes(_LOWER[self.raw] if lower else self.raw, self.start, self.end)
            self.hash = np.ascontiguousarray(self.lanes[:, 0])

    def texts(self) -> Iterator[tuple[int, int, int]]:
        """Number of each text and its range of words."""
        for i in range(len(self.at) - 1):
            yield i, int(self.first[i]), int(self.first[i + 1])

    def code_points(self, byte: np.ndarray) -> np.ndarray:
        """Code points from the batch's start before each byte position."""
        lead = np.concatenate(([0], np.cumsum((self.raw & 0xC0) != 0x80)))
        return lead[byte]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * U(0xBF58476D1CE4E5B9) + b)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive hashes, from runs of half the length."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, span, runs = np.full(n, size, U), 0, 1, hashes
    while span <= size:
        if size & span:
            out = _joined(out, runs[done : done + n])
            done += span
        runs = _joined(runs[: len(runs) - span], runs[span:]) if 2 * span <= size else runs
        span *= 2
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one text at least."""
    n = batch.num_rows
    if not n:
        return
    _, at = buffers(batch.column(column))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
