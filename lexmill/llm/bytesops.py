"""Vectorised text kernels over the UTF-8 bytes of Arrow string columns.

A batch's texts are one byte buffer with row offsets. Words, hashes and counts are computed
on slices of that buffer with numpy, so no Python loop runs over words. Slices hold whole
rows and about ``SLICE`` bytes; a longer single text is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
WINDOW = 1 << 20
U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_MIX = U(0xBF58476D1CE4E5B9)
_rng = np.random.default_rng(20250101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lean(kernel):
    """A kernel of batches that gives memory back to the system when it ends: workers are used again, by task after task."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Unused memory of Arrow and of the C library's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def table_of(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~table_of(b" \t\n\x0b\x0c\r")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased
WORD = table_of(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n at least."""
    if len(_pow[0]) < n:
        size = max(n, WINDOW + 1)
        inverse = U(pow(int(_P), -1, 1 << 64))
        for k, base in enumerate((_P, inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _pow[k] = np.multiply.accumulate(x)
    return _pow[0], _pow[1]


def buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, pa.scalar("", col.type))
    big = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(col: pa.Array | pa.ChunkedArray, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, their offsets from 0)."""
    data, at = buffer(col)
    lo, rows = 0, len(at) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (limit or SLICE), "right")) - 1)
        hi = min(hi, rows)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of bytes in ``inside``; no run crosses a row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ok = inside[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = ok[0], ok[-1]
    np.not_equal(ok[1:], ok[:-1], out=edge[1:-1])
    cut = at[(at > 0) & (at < len(data))]
    cut = cut[ok[cut] & ok[cut - 1]]
    flip = np.flatnonzero(edge)
    if len(cut):  # a row ends and the next begins inside a run
        cut = np.unique(cut)
        flip = np.sort(np.concatenate([flip, cut, cut]))
    starts, ends = flip[::2], flip[1::2]
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def spread(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches the high bits."""
    x = (x ^ (x >> U(30))) * _MIX
    x = (x ^ (x >> U(27))) * _P
    return x ^ (x >> U(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, cuts: tuple[int, ...] = (), lower: bool = True) -> list[np.ndarray]:
    """64-bit hashes of the spans, then of their first k bytes for each k in ``cuts`` (whole span if shorter)."""
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(cuts))]
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + WINDOW, "right")))
        part = data[base : int(ends[j - 1])]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[part] if lower else part] * up[: len(part)], out=sums[1:])
        s = starts[i:j] - base
        e = ends[i:j] - base
        for x, k in zip(out, (0, *cuts), strict=True):
            stop = np.minimum(e, s + k) if k else e
            x[i:j] = spread((sums[stop] - sums[s]) * down[s] + (stop - s).astype(np.uint64))
        i = j
    return out


def shingles(h: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the runs of ``size`` words; a row with fewer words, but not none, has all of them as one."""
    n = np.bincount(row, minlength=rows)
    k = len(h) - size + 1
    if k > 0:
        x = spread(h[:k])
        for d in range(1, size):
            x = spread(x * _P + h[d : d + k])
        ok = row[:k] == row[size - 1 :]
        x, r = x[ok], row[:k][ok]
    else:
        x, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        first = np.cumsum(n) - n
        y = np.empty(len(few), np.uint64)
        for t, q in enumerate(few):
            z = spread(h[first[q] : first[q] + 1])
            for d in range(1, n[q]):
                z = spread(z * _P + h[first[q] + d : first[q] + d + 1])
            y[t] = spread(z + U(n[q]))[0]
        x, r = np.concatenate([x, y]), np.concatenate([r, few])
        order = np.argsort(r, kind="stable")
        x, r = x[order], r[order]
    return x, r


def bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's entries begin in sorted ``row``; one more entry than rows."""
    return np.searchsorted(row, np.arange(rows + 1))
