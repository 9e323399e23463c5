"""Vectorised helpers on the buffers of Arrow batches; used inside tasks only."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: An odd multiplier for sums of hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Longer spans are hashed one by one by a cryptographic hash; shorter ones in steps of eight bytes, many at once.
LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def spans_hash(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans of bytes raw[start : start + length]."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    h = mix(length.astype(U64) * U64(BASE) + U64(0x5851F42D4C957F2D))
    left = np.flatnonzero((length > 0) & (length <= LONG))
    at, rest = start[left], length[left]
    while len(left):
        part = eight[at] & _MASKS[np.minimum(rest, 8)]
        h[left] = mix((h[left] ^ part) * U64(BASE) + U64(1))
        go = rest > 8
        left, at, rest = left[go], at[go] + 8, rest[go] - 8
    for i in np.flatnonzero(length > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : start[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indexes start[i], start[i] + 1, ... of each i, one after the other."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's offsets into them; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, most: int):
    """Ranges (i, j) of rows with about ``most`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word between white space of ASCII, and the number of words before each row."""
    word = ~_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[firsts] = word[firsts]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    ends[lasts] = word[lasts]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's word shingles (A-Z lower-cased), and each row's offsets into them.

    A row with fewer than ``width`` words has its whole sequence as the one shingle; without words none.
    """
    start, end, before = word_spans(raw, offsets)
    words = spans_hash(_LOWER[raw], start, end - start)
    n = np.diff(before)
    sums = np.zeros(max(0, len(words) - width + 1), U64)
    weight = 1
    for k in range(width):
        weight = weight * BASE % (1 << 64)
        sums += words[k : k + len(sums)] * U64(weight)
    sums = mix(sums)
    many = np.maximum(n - width + 1, 0)
    size = np.where(n < width, np.minimum(n, 1), many)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.zeros(int(at[-1]), U64)
    out[ragged(at[:-1], many)] = sums[ragged(before[:-1], many)]
    for r in np.flatnonzero((n > 0) & (n < width)):
        h = int(n[r])
        for w in words[before[r] : before[r + 1]]:
            h = (h * BASE + int(w)) % (1 << 64)
        out[at[r]] = h * 0xBF58476D1CE4E5B9 % (1 << 64)
    new = np.ones(len(out), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b].sort()
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][size > 0]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return out[new], kept[at]


def code(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte, rounded up: exact up to 127, then in quarter octaves."""
    high = 127 + np.ceil(4 * np.log2(np.maximum(counts, 127) / 127)).astype(np.int64)
    return np.where(counts <= 127, counts, np.minimum(high, 255)).astype(np.uint8)


#: What each code stands for.
CODED = np.where(np.arange(256) <= 127, np.arange(256), 127 * 2.0 ** ((np.arange(256) - 127) / 4)).astype(np.int64)
