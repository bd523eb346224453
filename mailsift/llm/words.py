"""Whole-batch word and window hashing for Arrow tasks.

Texts arrive as Arrow string columns. Words (runs of non-white-space bytes,
ASCII white space only) are located and hashed for a whole slice of rows at
once with numpy; no Python object is made per word. Slices are bounded by
bytes, so memory follows the slice size and the longest single text, never
the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (one longer text is a slice of its own).
SLICE_BYTES = 2 << 20
#: Rows handled at once: a row number fits 12 bits of a 64-bit sort key.
SLICE_ROWS = 1 << 12
_LONG_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xBF58476D1CE4E5B9)
_C3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def text_column(batch: pa.RecordBatch, name: str) -> pa.LargeStringArray:
    """The text column with nulls as empty texts."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()).fill_null("")


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batch`` with at most ``limit`` bytes of
    text each (a single longer row stands alone) and SLICE_ROWS rows."""
    if batch.num_rows == 0:
        return
    sizes = np.diff(_offsets(text_column(batch, name)))
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit or i - start == SLICE_ROWS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def _offsets(texts: pa.LargeStringArray) -> np.ndarray:
    raw = np.frombuffer(texts.buffers()[1], np.int64) if len(texts) else np.zeros(1, np.int64)
    return raw[texts.offset: texts.offset + len(texts) + 1] if len(texts) else raw


class Words:
    """The words of every row of one slice, in order.

    ``hash``: 64-bit hash per word; ``row``: row number per word; ``start``
    and ``end``: byte range within ``data``; ``first``: index of each row's
    first word (one more entry than rows)."""

    def __init__(self, texts: pa.LargeStringArray, lower: bool = False):
        off = _offsets(texts)
        base = int(off[0])
        self.offsets = off - base
        n = int(self.offsets[-1])
        raw = texts.buffers()[2]
        data = np.zeros(n + 8, np.uint8)  # 8 spare bytes: words are read eight bytes at a time
        if n:
            data[:n] = np.frombuffer(raw, np.uint8)[base: base + n]
        if lower:
            data = _LOWER[data]
        self.data = data
        self.rows = len(texts)
        word = ~_SPACE[data[:n]]
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        begins = self.offsets[:-1]
        before[begins[begins < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        ends = self.offsets[1:]
        after[ends[ends > 0] - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.row = np.searchsorted(self.offsets[1:], self.start, side="right")
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        length = self.end - self.start
        h = length.astype(np.uint64) * _C1
        eight = np.ndarray(shape=(len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        short = length <= _LONG_WORD
        live = np.flatnonzero(short)
        step = 0
        while len(live):
            left = length[live] - step
            w = eight[self.start[live] + step]
            cut = left < 8
            w[cut] &= (np.uint64(1) << (left[cut].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            h[live] = mix((h[live] ^ w) + _C1)
            step += 8
            live = live[left > 8]
        for i in np.flatnonzero(~short).tolist():
            digest = hashlib.blake2b(self.data[self.start[i]: self.end[i]].tobytes(), digest_size=8).digest()
            h[i] = np.frombuffer(digest, np.uint64)[0]
        return h

    def windows(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, 64-bit hash) of every run of ``n``
        consecutive words of one row."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:count] == self.row[n - 1:])
        odd = mix(np.arange(1000 * seed + 1, 1000 * seed + n + 1, dtype=np.uint64)) | np.uint64(1)
        acc = np.zeros(count, np.uint64)
        for k in range(n):
            acc += self.hash[k: k + count] * odd[k: k + 1]
        return at, mix(acc[at])

    def words_of(self, row: int) -> list[bytes]:
        a, b = self.first[row], self.first[row + 1]
        return [self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b])]


def by_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """(row, key) as one number: 12 bits of row above the key's leading 52."""
    return (row.astype(np.uint64) << np.uint64(52)) | (key >> np.uint64(12))


def row_of(number: np.ndarray) -> np.ndarray:
    return (number >> np.uint64(52)).astype(np.int64)


def distinct(number: np.ndarray) -> np.ndarray:
    """Mask of the first of equal neighbours in a sorted array."""
    new = np.ones(len(number), bool)
    new[1:] = number[1:] != number[:-1]
    return new


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as the int64 that Spark's long column holds."""
    return np.ascontiguousarray(x).view(np.int64)
