"""Words, shingles and their 64-bit hashes of a whole chunk of texts at once, over the bytes of an Arrow column.

A word's hash is a polynomial over its bytes, read off one running sum for the chunk; shingles mix word hashes. Nothing
is made per word in Python. Two different words or shingles share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random value per byte, so that the polynomial isn't one over small numbers.
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: Bytes 09-0D and 20 part words; every other byte belongs to one.
SPACE_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 19)
        for i, base in enumerate((_P, _P_INV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts, lower-cased if asked
    text_at: np.ndarray  #: for n texts n + 1 places in data
    start: np.ndarray  #: of each word, in data
    end: np.ndarray
    hash: np.ndarray  #: of each word
    first: np.ndarray  #: for n texts n + 1 places in the words
    sums: np.ndarray  #: running sums for hash_spans

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column and the places where its values begin; a null is empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = 8 if pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type) else 4
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(col.buffers()[1], f"<i{wide}", len(col) + 1, col.offset * wide).astype(np.int64)
    size = int(at[-1] - at[0])
    data = np.frombuffer(col.buffers()[2], np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    return data, at - at[0]


def running_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _power(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def hash_spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end."""
    return mix((sums[end] - sums[start]) * _power(len(sums))[1][start] + (end - start).astype(np.uint64))


def words(col: pa.Array, lower: bool = False, table: np.ndarray = SPACE_WORD) -> Words:
    """The words of each text: runs of bytes that `table` marks. lower: A-Z are lower-cased first."""
    data, at = column_bytes(col)
    if lower:
        data = LOWER[data]
    inside = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    text_start = np.zeros(len(data) + 1, bool)
    text_start[at[:-1]] = True
    start = np.flatnonzero(inside & (~before[:-1] | text_start[:-1]))
    after = np.zeros(len(data) + 1, bool)
    after[: len(data)] = inside
    text_start[-1] = True
    end = np.flatnonzero(inside & (~after[1:] | text_start[1:])) + 1
    sums = running_sums(data)
    first = np.searchsorted(start, at)
    return Words(data, at, start, end, hash_spans(sums, start, end), first, sums)


def units(data: np.ndarray, at: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start and end of each unit, and each text's first: texts are cut where cut[byte, next byte] says so."""
    begins = np.zeros(len(data) + 1, bool)
    begins[1 : len(data)] = cut.ravel()[(data[:-1].astype(np.uint16) << 8) | data[1:]]
    begins[at] = True
    start = np.flatnonzero(begins[: len(data)])
    return start, np.append(start[1:], len(data))[: len(start)], np.searchsorted(start, at)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles in order, and for k texts k + 1 places in them.

    A text of fewer words, but not none, has its whole sequence as its one shingle; no words, none.
    """
    counts = w.counts()
    own = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(own, out=first[1:])
    out = np.zeros(int(first[-1]), np.uint64)
    full = len(w.hash) - n + 1
    if full > 0:
        run = np.zeros(full, np.uint64)
        for i in range(n):
            run += w.hash[i : i + full] * np.uint64(pow(_P, i + 1, 1 << 64))
        run = mix(run)
        long = counts >= n
        take = np.repeat(w.first[:-1][long] - first[:-1][long], own[long])
        place = np.flatnonzero(np.repeat(long, own))
        out[place] = run[place + take]
    for i in np.flatnonzero((counts < n) & (counts > 0)):
        h = sum(int(x) * pow(_P, j + 1, 1 << 64) for j, x in enumerate(w.hash[w.first[i] : w.first[i + 1]])) % (1 << 64)
        out[first[i]] = mix(np.array([h ^ (int(counts[i]) << 56)], np.uint64))[0]
    return out, first
