"""Vectorised text kernel: words and hashes of whole Arrow string columns with numpy, no Python loop over words.

A word is hashed eight bytes at a time, each block mixed with what came before; sequences of words are hashed by doubling,
each half mixed with the other. Neither is a polynomial, so no pattern of letters or words makes unequal texts agree; two
families, of other constants, agree by chance alone. Memory is about 20 bytes for each byte of text, so callers
go through `chunks`, which cuts columns at row borders into small pieces; one longer text stands alone."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 18
#: Words of more bytes are hashed one by one.
LONG = 64
_SEED = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
_STEP = (U(0xC2B2AE3D27D4EB4F), U(0xA0761D6478BD642F))
_JOIN = (U(0x8CB92BA72F3D8DD7), U(0xE7037ED1A0B428DB))
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns memory that a worker has freed to the system; called when a task has read all its rows."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sequences(x: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of x[i:i+k] for every i, from those of one, two, four and more values."""
    n, have, width, out = len(x) - k + 1, 0, 1, None
    if n <= 0:
        return np.zeros(0, U)
    while True:
        if k & width:
            piece = x[have : have + n]
            out = piece if out is None else mix(out * _STEP[which] + piece)
            have += width
            if have == k:
                return out
        x = mix(x[:-width] * _JOIN[which] + x[width:])
        width *= 2


class Words:
    """Words of a column: `start`, `end` are byte places in `data`, `doc` the row, `first[i]:first[i+1]` row i's words."""

    inside = ~_SPACE

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        column = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.rows = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + self.rows + 1] if self.rows else np.zeros(1, np.int64)
        raw = column.buffers()[2]
        text = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and self.rows else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.padded = np.zeros(len(text) + 8, np.uint8)
        self.data = self.padded[: len(text)]
        if lower:
            np.take(_LOWER, text, out=self.data)
        else:
            self.data[:] = text
        inside = np.zeros(len(text) + 2, np.int8)
        inside[1:-1] = self.inside[self.data]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows, dtype=np.int32), self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; `which` selects one of two independent families."""
        blocks = np.ndarray((len(self.data) + 1,), "<u8", self.padded, strides=(1,))
        size = self.end - self.start
        h = mix((blocks[self.start] & _BYTES[np.minimum(size, 8)]) + (size.astype(U) + U(1)) * _SEED[which])
        more, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
        while len(more):
            left = size[more] - at
            h[more] = mix(h[more] * _STEP[which] + (blocks[self.start[more] + at] & _BYTES[np.minimum(left, 8)]))
            more, at = more[left > 8], at + 8
        for i in np.flatnonzero(size > LONG):
            h[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8, salt=bytes([which])).digest())
        return h

    def kept_text(self, gone: np.ndarray) -> pa.Array:
        """Each row's words but those that are gone, joined by one space."""
        keep = np.flatnonzero(~gone)
        step = np.zeros(len(self.data) + 2, np.int8)
        doc = self.doc[keep]
        last = np.ones(len(keep), bool)
        last[:-1] = doc[1:] != doc[:-1]
        step[self.start[keep]] += 1
        np.add.at(step, self.end[keep] + ~last, -1)
        inside = np.cumsum(step[:-2], dtype=np.int8) > 0
        inside[self.end[keep[~last]]] = True
        data = self.data.copy()
        data[self.end] = 0x20
        size = np.concatenate([[0], np.cumsum(inside)])
        offsets = size[self.offsets].astype(np.int64)
        return pa.LargeStringArray.from_buffers(self.rows, pa.py_buffer(offsets), pa.py_buffer(data[inside])).cast(pa.string())


def chunks(*columns: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text in all columns together (a longer row stands alone)."""
    n = len(columns[0])
    if not n:
        return
    total = np.zeros(n, np.int64)
    for c in columns:
        total += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cum = np.cumsum(total + 1)
    at = 0
    while at < n:
        base = cum[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(cum, base + size, "right")))
        yield at, to
        at = to


def grams(words: Words, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word sequences inside one row, and the index of each one's first word."""
    h = sequences(x, k)
    at = np.flatnonzero(words.doc[: len(h)] == words.doc[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    return h[at], at


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted by (row, hash): hashes and rows. Rows with 1 to k-1 words have one, the whole sequence."""
    x = words.hashes()
    h, at = grams(words, x, k)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        extra = words.count[short].astype(U) * _SEED[1]
        for j in range(k - 1):
            has = words.count[short] > j
            extra[has] = mix(extra[has] * _JOIN[1] + x[words.first[short[has]] + j])
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short.astype(doc.dtype)])
    order = np.argsort(h)
    narrow = doc[order].astype(np.uint16) if words.rows < 65536 else doc[order]
    order = order[np.argsort(narrow, kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]
