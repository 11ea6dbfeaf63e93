"""Vectorised word views of Arrow text columns, shared by the operators of this subpackage.

Everything here runs inside a task on one Arrow batch: Spark partitions and
shuffles, numpy does the arithmetic.  Batches are walked in slices of a few
megabytes of text so that temporaries stay small however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_PAD = 16

#: byte -> is a word separator: \x20 and \x09-\x0D
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: byte -> is no letter, digit or non-ASCII byte
NON_WORD = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])

_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (a bijection of 64-bit integers)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def text_slices(col: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) over whole rows; null texts are empty.

    A slice holds one row at least, so one text may exceed ``max_bytes``; the
    byte array ends with zero padding that offsets never reach.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1)
        size = int(off[j] - off[i])
        buf = np.zeros(size + _PAD, np.uint8)
        buf[:size] = raw[off[i]:off[j]]
        yield i, j, buf, off[i:j + 1] - off[i]
        i = j


def word_bounds(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, ptr): words of row r are starts/ends[ptr[r]:ptr[r + 1]]; no word crosses rows."""
    size = int(off[-1])
    inside = ~separators[buf[:size]]
    before = np.zeros(size + 1, dtype=bool)
    before[1:] = inside
    before[off] = False  # a row begins anew
    starts = np.flatnonzero(inside & ~before[:size])
    after = np.zeros(size + 1, dtype=bool)
    after[:size] = inside
    after[off] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every word from its length and bytes, eight bytes a step."""
    size = ends - starts
    eight = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    h = mix(size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    h = mix(h ^ (eight[starts] & _LOW_BYTES[np.minimum(size, 8)]))
    more, k = np.flatnonzero(size > 8), 8
    while more.size:
        left = size[more] - k
        h[more] = mix(h[more] ^ (eight[starts[more] + k] & _LOW_BYTES[np.minimum(left, 8)]))
        k += 8
        more = more[left > 8]
    return h


class Memo:
    """Word hash -> row number of a value store that grows with the words met.

    Two-choice hashing over a fixed number of slots: a word that finds both
    its slots taken is stored but not found again, so it is computed once
    more; results never depend on it.  ``clear`` starts anew (the caller
    bounds the rows).
    """

    def __init__(self, bits: int = 22):
        self.shift = np.uint64(64 - bits)
        self.slots = np.empty(1 << bits, np.int32)
        self.clear()

    def clear(self) -> None:
        self.slots[:] = -1
        self.hashes = np.zeros(1 << 18, np.uint64)
        self.rows = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is new."""
        row = self.slots[h >> self.shift]
        row = np.where(self.hashes[row] == h, row, np.int32(-1))  # row -1 reads the last entry, a spare one
        miss = np.flatnonzero(row < 0)
        if miss.size:
            hm = h[miss]
            second = self.slots[(hm * _M2) >> self.shift]
            row[miss] = np.where(self.hashes[second] == hm, second, np.int32(-1))
        return row

    def add(self, h: np.ndarray) -> np.ndarray:
        """Rows of new distinct hashes."""
        while self.rows + len(h) >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        row = np.arange(self.rows, self.rows + len(h), dtype=np.int32)
        self.hashes[self.rows:self.rows + len(h)] = h
        self.rows += len(h)
        slot = h >> self.shift
        taken = self.slots[slot] >= 0
        slot = np.where(taken, (h * _M2) >> self.shift, slot)
        free = self.slots[slot] < 0
        self.slots[slot[free]] = row[free]
        return row


def grown(a: np.ndarray, size: int) -> np.ndarray:
    """``a`` with room for ``size`` entries, doubled as needed."""
    while size > len(a):
        a = np.concatenate([a, np.empty_like(a)])
    return a
