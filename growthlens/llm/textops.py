"""Vectorised helpers over Arrow batches of text.

Every helper works on one flat byte buffer with document offsets, so the cost of
Python is paid once for a slice of a batch and not once for a row.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 18
#: `[\x20\x09-\x0D]`: the bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Gives a worker's free memory back to the machine when a task ends: workers live on and wait beside others."""

    @functools.wraps(run)
    def tidied(*args: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return tidied


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about SLICE_BYTES of text each."""
    column = batch.column(text)
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(column).fill_null(0), np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield start, stop
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        base = np.uint64(_P_INV if inverse else _P)
        have = np.ones(max(n, SLICE_BYTES + 1024), np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if n > 4 * SLICE_BYTES:
            return have[:n]
        _POWERS[inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: span_hash() takes differences of it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in each [start, end), whatever their place."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each document has."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = firsts[1:] - 1 if len(firsts) else firsts
    ends[lasts] = inside[lasts]
    ends[-1] = inside[-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes in a flat sequence."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= np.uint64(_P)
        out += hashes[i : i + n]
    return mix(out)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and n + 1 offsets into them.

    A document with fewer than `width` words has its whole sequence as its one
    shingle; one without words has none.
    """
    data = LOWER[data]
    start, end, count = words(data, offsets)
    each = span_hash(prefix_hash(data), start, end) if len(start) else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(count)])
    have = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), have)
    lead = np.concatenate([[0], np.cumsum(have)])
    place = np.arange(lead[-1]) - lead[doc] + first[doc]
    out = np.zeros(lead[-1], np.uint64)
    full = count[doc] >= width
    run = windows(each, width)
    out[full] = run[place[full]]
    for row in np.flatnonzero(~full):
        d = doc[row]
        part = each[first[d] : first[d + 1]]
        value = np.full(1, len(part), np.uint64)
        for x in part:
            value = value * np.uint64(_P) + x
        out[row] = mix(value)[0]
    for a, b in zip(lead[:-1].tolist(), lead[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    doc, out = doc[fresh], out[fresh]
    return out, np.searchsorted(doc, np.arange(len(count) + 1))
