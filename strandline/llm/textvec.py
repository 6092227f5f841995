"""Vectorised work on batches of texts: words, their hashes and shingle sets, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

#: The bytes that separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
#: A-Z to a-z; all other bytes as they are.
LOWER = _lower


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a public 64-bit generator (splitmix64): a bijection on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random unsigned 64-bit numbers, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = stream(11, 256)
_BYTE_LOWER = _BYTE[LOWER]
for _t in (_BYTE, _BYTE_LOWER):
    _t[SPACE] = 0
_PERIOD = 1024
_POWER = stream(12, _PERIOD) | np.uint64(1)
_POWER_FAR = stream(13, _PERIOD) | np.uint64(1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each text (one more than rows). Null texts are empty."""
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, dtype=np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and len(held) else np.zeros(0, dtype=np.uint8)
    return data, off


def row_ranges(off: np.ndarray, most_bytes: int, most_rows: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most so many bytes together, or one longer text."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + most_rows, n)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of consecutive texts: bytes, first byte and end of each word, and the first word of each text (one more)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word's bytes (A-Z lowered)."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        lo = int(self.start[0])
        b = self.data[lo : int(self.end[-1])]
        mark = np.zeros(len(b), dtype=np.int32)
        mark[self.start[1:] - lo] = 1
        at = np.arange(len(b), dtype=np.int64) - (self.start - lo)[np.cumsum(mark, dtype=np.int32)]
        v = (_BYTE_LOWER if lower else _BYTE)[b] * _POWER[at & (_PERIOD - 1)]
        size = self.end - self.start
        if int(size.max()) > _PERIOD:
            far = at >= _PERIOD
            v[far] *= _POWER_FAR[(at[far] // _PERIOD) & (_PERIOD - 1)]
        return mix(np.add.reduceat(v, self.start - lo) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """The words of texts data[off[i]:off[i + 1]]; no word crosses from one text to the next. space: bytes between words."""
    base = int(off[0])
    b = data[base : int(off[-1])]
    inside = ~space[b]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    bounds = off[1:-1] - base
    bounds = bounds[(bounds > 0) & (bounds < len(b))]
    begins[bounds] = inside[bounds]
    ends[bounds - 1] = inside[bounds - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(b, start, end, np.searchsorted(start, off - base))


def word_codes(words: Words, space: np.ndarray = SPACE) -> np.ndarray:
    """A number for each word, the same for equal words of these texts alone; words are compared by their bytes."""
    size = words.end - words.start
    held = words.data[~space[words.data]] if len(size) else words.data[:0]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held))])
    return array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def joined(words: Words, chosen: np.ndarray) -> pa.Array:
    """For each row of chosen (numbers of words, as many in each row) its words joined by one space."""
    m, k = chosen.shape
    flat = chosen.ravel()
    size = (words.end - words.start)[flat] + 1  # with a space behind each
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[ends[1:] - 1] = False
    to = np.flatnonzero(inside)
    out[to] = words.data[to + np.repeat(words.start[flat] - ends[:-1], size - 1)]
    last = np.ones(len(out), dtype=bool)
    last[ends[k::k] - 1] = False  # no space behind a row's last word
    offsets = ends[::k] - np.arange(m + 1)
    return pa.Array.from_buffers(pa.large_string(), m, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[last])])


_A = stream(21, 16) | np.uint64(1)


def runs(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text, and for each the number of its text."""
    n = np.maximum(np.diff(first) - (k - 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        out = out * _A[k & 15] + h[at + j] * _A[j & 15]
        out ^= out >> np.uint64(29)
    return mix(out), doc


#: Bits of a shingle's hash; the bits above hold the number of the text while a batch is sorted.
SHINGLE_BITS = 52
MOST_DOCS = 1 << (64 - SHINGLE_BITS)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of at most MOST_DOCS texts: (hash of 52 bits, text), sorted by text and hash.

    A text with fewer words has its whole sequence as its one shingle, one without words has none.
    """
    h = words.hashes()
    s, doc = runs(h, words.first, k)
    n = words.counts
    parts, docs = [s], [doc]
    for j in range(1, k):
        own = np.flatnonzero(n == j)
        if len(own):
            x = np.full(len(own), j, dtype=np.uint64)
            for i in range(j):
                x = mix(x * _A[i] + h[words.first[own] + i])
            parts.append(mix(x ^ np.uint64(0xA5A5A5A5)))
            docs.append(own)
    low = np.uint64((1 << SHINGLE_BITS) - 1)
    key = np.concatenate(docs).astype(np.uint64) << np.uint64(SHINGLE_BITS) | (np.concatenate(parts) & low)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & low, (key >> np.uint64(SHINGLE_BITS)).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as compressed byte planes: leading zeros take no room."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
