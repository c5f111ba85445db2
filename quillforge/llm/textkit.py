"""Vectorised text primitives shared by the training-data operators.

Texts are handled as the UTF-8 buffers of Arrow batches: one byte array and
document offsets.  Words are byte runs of a class; their 64-bit hashes come
from prefix sums, so the cost per byte is a few array passes and no Python
object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A chunk ends before the document that would take it beyond this size.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def _byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TABLE = _byte_table(20240501)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED_TABLE = _TABLE[_LOWER]


def _byte_class(allowed) -> np.ndarray:
    return np.array([bool(allowed(b)) for b in range(256)])


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased
ALNUM = _byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: [^\x20\x09-\x0D]+
NONSPACE = _byte_class(lambda b: b != 32 and not 9 <= b <= 13)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) >= n:
            return cls.up[:n], cls.down[:n]
        up, down = _powers(_BASE, n), _powers(_INV, n)
        if n <= CHUNK_BYTES + 1:
            cls.up, cls.down = up, down
        return up, down


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on every byte."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """c, n + 1 long, for span_hash()."""
    c = np.zeros(len(data) + 1, np.uint64)
    up, _ = _Powers.get(len(data) + 1)
    np.cumsum((_LOWERED_TABLE if lower else _TABLE)[data] * up[:-1], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), the same wherever they stand."""
    _, down = _Powers.get(len(c))
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns what the worker has freed to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most `limit` bytes each, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of some documents: byte ranges, hashes, and for document d the words first[d] up to first[d + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool = True):
        n = len(data)
        inside = member[data]
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | begins[1:n]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | begins[1:n]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.hash = span_hash(prefix_hash(data, lower), self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


_STEP = np.uint64(0x9FB21C651E98DF25)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k items in a row at each of the first len(h) - k + 1 places."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _STEP + h[j : j + n]
    return mix(out + np.uint64(k))


def doc_grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each k-word gram inside a document; one with fewer words, but not none, gives all of them as one."""
    counts = words.counts
    all_grams = grams(words.hash, k)
    full = np.maximum(counts - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), full)
    place = within(words.first[:-1], full)
    hashes = all_grams[place]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for size in range(1, k):
            pick = counts[short] == size
            if pick.any():
                extra[pick] = grams_at(words.hash, words.first[short[pick]], size)
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, extra])
        order = np.argsort(doc, kind="stable")
        doc, hashes = doc[order], hashes[order]
    return doc, hashes


def grams_at(h: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    out = h[place].copy()
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _STEP + h[place + j]
    return mix(out + np.uint64(k))


def within(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... counts[i] of them, for each i in turn."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - first, counts)
