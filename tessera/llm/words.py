"""Vectorised tokenising and hashing of Arrow text columns.

All functions work on the concatenated UTF-8 bytes of many rows at once, so
cost is a few array passes per byte and never a Python step per word, but for
words of more than TABLED bytes. A word's hash is a sum of one random value for
each (place, byte), so no pattern of bytes makes two words collide, as there
are for polynomials modulo 2^64.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bytes of a word that the value tables cover; longer words are hashed by BLAKE2b.
TABLED = 40


def _values(seed: int) -> np.ndarray:
    """A random value for each byte at each place of a word."""
    with np.errstate(over="ignore"):
        return mix(mix(np.arange(TABLED * 256, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)))


_FIRST, _SECOND = _values(11), _values(1_000_003)


class Alphabet(NamedTuple):
    """Which bytes belong to words, and the byte that each counts as."""

    inside: np.ndarray
    fold: np.ndarray


def _alphabet(inside: np.ndarray, lower: bool) -> Alphabet:
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return Alphabet(inside, fold)


def _inside(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words between white space, case kept or A-Z folded.
SPACED = _alphabet(~_inside((0x20, 0x20), (0x09, 0x0D)), False)
SPACED_LOWER = _alphabet(~_inside((0x20, 0x20), (0x09, 0x0D)), True)
#: Digits, letters and all bytes above ASCII, A-Z folded.
ALNUM_LOWER = _alphabet(_inside((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)), True)


class Words(NamedTuple):
    """Words of a slice: byte range, row, and 64-bit hash (hash2: a second, independent family)."""

    data: np.ndarray
    n_rows: int
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    hash2: np.ndarray | None

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def tokenize(column: pa.Array, alphabet: Alphabet, second: bool = False) -> Words:
    offsets, data = text_buffer(column)
    n, n_rows = len(data), len(offsets) - 1
    inside = alphabet.inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if n:
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    else:
        start = end = np.zeros(0, np.int64)
    row = np.searchsorted(offsets[1:], start, side="right").astype(np.int32)

    length = end - start
    folded = alphabet.fold[data[inside]]  # words are what lies inside, one after another
    first, other = hashes(folded, np.cumsum(length) - length, length, second)
    return Words(data, n_rows, start, end, row, first, other)


def hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Hash, and second hash if wanted, of the stretches that data consists of, none of them empty."""
    if not len(start):
        return np.zeros(0, U64), np.zeros(0, U64) if second else None
    cell = np.arange(len(data), dtype=np.int32) - np.repeat(start.astype(np.int32), length) if len(data) < 1 << 31 else np.arange(len(data)) - np.repeat(start, length)
    cell = np.minimum(cell, TABLED - 1, out=cell)
    cell *= 256
    cell += data
    long = np.flatnonzero(length > TABLED)
    digests = [hashlib.blake2b(data[start[i] : start[i] + length[i]].tobytes(), digest_size=16).digest() for i in long]

    def hashed(values: np.ndarray, part: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = mix(np.add.reduceat(values[cell], start) + length.astype(U64))
        out[long] = [int.from_bytes(d[8 * part : 8 * part + 8], "little") for d in digests]
        return out

    return hashed(_FIRST, 0), hashed(_SECOND, 1) if second else None


def grams(h: np.ndarray, k: int, base: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """Hash of the k items from each position on, for the len(h)-k+1 positions that have k."""
    if len(h) < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        done, power, total = 0, 1, None  # total: hash of `done` items, combined from runs of doubled length
        part, size, factor, left = h, 1, base, k
        while left:
            if left & 1:
                if total is None:
                    total, done, power = part, size, factor
                else:
                    m = min(len(total), len(part) - done)
                    total = total[:m] * U64(factor) + part[done : done + m]
                    done, power = done + size, power * factor % (1 << 64)
            left >>= 1
            if left:
                m = len(part) - size
                part = part[:m] * U64(factor) + part[size:]
                size, factor = size * 2, factor * factor % (1 << 64)
        return mix(total[: len(h) - k + 1])


def within(row: np.ndarray, k: int) -> np.ndarray:
    """Which of the k-item windows lie in one row."""
    return row[: len(row) - k + 1] == row[k - 1 :] if len(row) >= k else np.zeros(0, bool)


def sliding(values: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over each w consecutive values."""
    if len(values) < w:
        return values[:0]
    size = 1
    while size * 2 <= w:
        values = op(values[:-size], values[size:])
        size *= 2
    rest = w - size
    return op(values[: len(values) - rest], values[rest:]) if rest else values


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[first, last) of the runs of equal adjacent keys."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    first = np.concatenate([[0], np.flatnonzero(change) + 1])
    return first, np.concatenate([first[1:], [n]])


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, which): an order that sorts x, where each distinct value begins in it, and the number of each element's value."""
    order = np.argsort(x)  # the default kind is several times faster than a stable one
    first, last = runs(x[order])
    which = np.empty(len(x), np.int64)
    which[order] = np.repeat(np.arange(len(first)), last - first)
    return order, first, which


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
