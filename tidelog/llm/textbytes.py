"""Vectorised work on UTF-8 text in Arrow batches: words and rolling hashes without a Python loop over characters."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}
#: For pieces() where nothing depends on the size of a piece: its arrays take up to fifty times as much.
SMALL_PIECE = 1 << 17


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string or binary array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes at most, one row at least: memory is bounded by the longest text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offs = buffers(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, len(col))
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if "p" not in _tables or len(_tables["p"]) < n:
        m = max(n, 1 << 16)
        for key, base in (("p", BASE), ("q", INVERSE)):
            a = np.full(m, base, U64)
            a[0] = 1
            _tables[key] = np.multiply.accumulate(a)
    return _tables["p"], _tables["q"]


#: Longer tables of powers go when a task ends: they take 16 bytes each, and making them anew a few milliseconds.
KEPT_POWERS = 2 * SMALL_PIECE


def release() -> None:
    """Gives memory that is free in this process back to the system, as far as its C library can."""
    if len(_tables.get("p", ())) > KEPT_POWERS:
        _tables.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(function):
    """function of Arrow batches (a generator) or of a table, with release() at its end: Python workers wait for their next
    task with all memory that they once needed, several of them beside each executor's heap."""
    if inspect.isgeneratorfunction(function):

        @wraps(function)
        def run(batches):
            try:
                yield from function(batches)
            finally:
                release()

    else:

        @wraps(function)
        def run(t):
            try:
                return function(t)
            finally:
                release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on all others."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def lower_table(is_word) -> np.ndarray:
    """For each byte: A-Z lower-cased; 0 where it is outside words."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[not is_word(i) for i in range(256)]] = 0
    return t


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with inside[byte], none across texts; and the first word of each text (len+1)."""
    m = inside[data]
    n = len(m)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:-1]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span."""
    p, q = powers(len(values) + 1)
    # In place: eight bytes for each of values are enough.
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    total[1:] = values
    total[1:] += U64(1)
    total[1:] *= p[: len(values)]
    np.cumsum(total[1:], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive values of h, len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for i in range(n):
        out = out * BASE + h[i : len(h) - n + 1 + i]
    return mix(out)


def runs(*cols: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of rows with equal values."""
    n = len(cols[0])
    if not n:
        return []
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    at = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return list(zip(at[:-1], at[1:], strict=True))
