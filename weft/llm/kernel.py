"""Vectorised text primitives shared by the operators: numpy over Arrow's own UTF-8 buffers.

A block is a run of whole documents of about ``BLOCK_BYTES``; a document is never split, so memory is
bounded by the larger of a block and the longest document.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20

U = np.uint64
_C1, _C2, _C3 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)
#: A word longer than this is hashed by xxh3 rather than in eight-byte steps.
_LONG = 1024


def table(members: bytes) -> np.ndarray:
    """A 256-entry lookup: true for the bytes named."""
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


#: White space of the word pattern [^\x20\x09-\x0D]+.
SPACE = table(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x = x * _C1
    x ^= x >> U(29)
    x *= _C2
    x ^= x >> U(32)
    return x


def trimmed(f):
    """f, followed by trim()."""

    @functools.wraps(f)
    def run(table):
        try:
            return f(table)
        finally:
            trim()

    return run


def text_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (from 0) of a string column; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2] if len(column) else None
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, dtype=np.uint8)
    return raw, offsets - first


def trim() -> None:
    """Gives freed memory back: a worker that waits for its next task should not hold what its last one needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks(batches, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of whole documents: the slice, its bytes, its offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = text_of(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
    trim()


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends where its document ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    padded = np.zeros(n + 2, dtype=np.int8)
    padded[1:-1] = inside
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    starts, ends = edges[0::2], edges[1::2]
    cut = np.unique(off[1:-1])
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[inside[cut] & inside[cut - 1]]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def doc_of(starts: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document its first item (with one past the last at the end); per item its document."""
    first = np.searchsorted(starts, off)
    first[-1] = len(starts)
    return first, np.repeat(np.arange(len(off) - 1), np.diff(first))


def hash_slices(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte slice, the same in every process."""
    n = ends - starts
    h = mix(n.astype(U) * _C3 + U(seed))
    if not len(n):
        return h
    wide = np.ndarray(shape=(len(raw),), dtype="<u8", buffer=np.concatenate([raw, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    active, j = np.flatnonzero((n > 0) & (n <= _LONG)), 0
    while len(active):
        x = wide[starts[active] + 8 * j] & _MASK[np.minimum(n[active] - 8 * j, 8)]
        h[active] = mix((h[active] ^ x) + _C3)
        j += 1
        active = active[n[active] > 8 * j]
    for i in np.flatnonzero(n > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed=seed)
    return h


def windows(h: np.ndarray, item_doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-sensitive hashes of every k consecutive items within one document, and the index of their first items."""
    if len(h) < k:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= _C3
        out += h[j : len(h) - k + 1 + j]
    at = np.flatnonzero(item_doc[: len(h) - k + 1] == item_doc[k - 1 :])
    return mix(out[at]), at


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending, by a plain sort."""
    s = np.sort(x)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def clashing(keys: np.ndarray) -> np.ndarray:
    """Positions, ascending, of keys that may occur twice or more: all that do, and few others.

    Positions ride in the low bits of the keys, so that one plain sort of numbers finds equal high bits.
    """
    low = U(max(1, int(len(keys)).bit_length()))
    s = np.sort((keys >> low << low) | np.arange(len(keys), dtype=U))
    high = s >> low
    same = high[1:] == high[:-1]
    near = np.zeros(len(keys), dtype=bool)
    near[1:] = same
    near[:-1] |= same
    return np.sort((s[near] & ((U(1) << low) - U(1))).astype(np.int64))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key: whether it occurs twice or more, and whether an equal key stands before it."""
    any_, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        some = clashing(keys)
        order = some[np.argsort(keys[some], kind="stable")]
        s = keys[order]
        same = s[1:] == s[:-1]
        later[order[1:][same]] = True
        any_[order[1:][same]] = True
        any_[order[:-1][same]] = True
    return any_, later


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values in each of the segments [first[i], first[i + 1])."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def code_points(raw: np.ndarray) -> np.ndarray:
    """At each byte position the number of code points that begin before it."""
    out = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each segment, one segment after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return at + np.arange(total)


def slices(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte slices as an Arrow binary array."""
    n = ends - starts
    offsets = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(raw[ragged(starts, n)])])
