"""Splitting of texts at the public byte-level BPE pattern, many texts at once, and a cache of encoded pieces.

Pieces are found on arrays of code points, hashed to 64 bits, looked up in a sorted table and compared with the piece
that stands there, so that two pieces with one hash never share ids; only pieces not seen before by the worker reach
the encoder. The table is bounded: when it is full only pieces stay that several blocks had.
"""

from __future__ import annotations

import itertools
import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import regex

from .arrays import U64, ragged, spans_hash

SPACE, LETTER, NUMBER, OTHER, END = range(5)
#: Code points of Unicode's White_Space. Fixed values.
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Characters in one array; a longer text is cut where a single space stands between two words.
BLOCK = 1 << 19
#: Characters of a piece that the cache holds.
LONGEST = 32
SEPARATOR = sys.maxunicode + 1
_CUT = re.compile(r"(?<=[a-zA-Z]) (?=[a-zA-Z])")


def classes(joins: Callable[[str, list[str]], list[bool]]) -> np.ndarray:
    """The class of every code point, as the library has it that encodes.

    Two versions of Unicode are at hand, an older and a newer one. Where they differ, the library itself is asked:
    ``joins(first, others)`` tells of which of the other characters it makes one piece with the first.
    """
    every = [chr(c) for c in range(sys.maxunicode + 1)]
    kinds, newer = (np.full(sys.maxunicode + 2, OTHER, np.uint8) for _ in range(2))
    for c, x in enumerate(every):
        k = unicodedata.category(x)[0]
        if k == "L" or k == "N":
            kinds[c] = LETTER if k == "L" else NUMBER
    text = "".join(x for x in every if not "\ud800" <= x <= "\udfff")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            newer[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = kind
    asked = [every[c] for c in np.flatnonzero(kinds != newer)]
    if asked:
        at = np.array([ord(x) for x in asked])
        kinds[at] = np.where(joins("a", asked), LETTER, np.where(joins("1", asked), NUMBER, OTHER))
    kinds[WHITE] = SPACE
    kinds[SEPARATOR] = END
    return kinds


def segments(text: str, size: int = BLOCK):
    """Parts of about ``size`` characters whose pieces are those of the whole text."""
    at = 0
    while len(text) - at > 2 * size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def pieces(texts: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, start and end of each piece, and the number of pieces before each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(lengths.sum()) + len(texts)
    cp = np.full(total, SEPARATOR, np.uint32)
    at = np.cumsum(lengths + 1) - lengths - 1
    keep = np.ones(total, bool)
    keep[at + lengths] = False
    cp[keep] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[cp]
    starts = np.ones(total, bool)
    starts[1:] = kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END)) + 1
    starts[after - 1] = True
    starts[after[cp[after - 1] == 32]] = False
    quotes = np.flatnonzero((cp[:-1] == 39) & starts[:-1] & (kind[1:] == LETTER))
    if quotes.size:
        one = cp[quotes + 1]
        two = cp[np.minimum(quotes + 2, total - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, n in ((quotes[short], 2), (quotes[long & ~short], 3)):
            starts[found + 1] = False
            starts[found + n] = True
    first = np.flatnonzero(starts)
    last = np.append(first[1:], total)
    real = kind[first] != END
    first, last = first[real], last[real]
    return cp, first, last, np.searchsorted(first, np.append(at, total))


def equal(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a[at_a : at_a + n] equals b[at_b : at_b + n], for each; of 16-bit items, with three more behind the last."""
    x, y = (np.ndarray((len(v) - 3,), "<u8", v, strides=(2,)) for v in (a, b))
    out, left = np.ones(len(n), bool), np.arange(len(n))
    while len(left):
        differ = (x[at_a] ^ y[at_b]) & _MASKS[np.minimum(n, 4)]
        out[left[differ != 0]] = False
        go = (n > 4) & (differ == 0)
        left, at_a, at_b, n = left[go], at_a[go] + 4, at_b[go] + 4, n[go] - 4
    return out


_MASKS = np.array([(1 << 16 * k) - 1 for k in range(5)], U64)


class Pool:
    """An array that grows at its end."""

    def __init__(self, kind=np.uint32) -> None:
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> int:
        """The place of the added values."""
        if self.used + len(values) + 4 > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros((self.used >> 2) + len(values) + 4, self.data.dtype)])
        self.data[self.used : self.used + len(values)] = values
        self.used += len(values)
        return self.used - len(values)


class PieceCache:
    """Ids of pieces; ``encode`` gets a list of new pieces and returns a list of id lists.

    Pieces of more than ``LONGEST`` characters or with one beyond 16 bits are encoded in each block anew. At ``most``
    pieces or ``characters`` of them those go that few blocks had, so that frequent pieces stay.
    """

    def __init__(self, encode, kinds: np.ndarray, most: int = 400_000, characters: int = 4_500_000) -> None:
        self.encode, self.kinds, self.most, self.characters = encode, kinds, most, characters
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, U64), np.zeros(0, np.int32)
        # by slot: ends in the pools, and in how many blocks the piece was
        self.ids_end, self.text_end, self.blocks = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, np.uint8)
        self.ids_pool, self.texts = Pool(), Pool(np.uint16)

    def _trim(self) -> None:
        """Keeps at most half of the pieces, those that most blocks had."""
        n, size = np.diff(self.ids_end), np.diff(self.text_end)
        least = 2
        while (stay := self.blocks >= least).sum() > self.most // 2 or size[stay].sum() > self.characters // 2:
            if least > 255:
                return self.clear()
            least *= 2
        old, (keys, slot) = (self.ids_end, self.ids_pool.data, self.text_end, self.texts.data, self.blocks), (self.keys, self.slot)
        self.clear()
        kept = np.flatnonzero(stay)
        self.ids_pool.add(old[1][ragged(old[0][kept].astype(np.int64), n[kept])])
        self.texts.add(old[3][ragged(old[2][kept].astype(np.int64), size[kept])])
        self.ids_end, self.text_end = (np.concatenate([[0], np.cumsum(x[kept])]).astype(np.int32) for x in (n, size))
        self.blocks = old[4][kept] >> 1
        here = stay[slot]
        self.keys, self.slot = keys[here], (np.cumsum(stay) - 1)[slot[here]].astype(np.int32)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and their number for each."""
        lists = self.encode(words)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(n.sum())), n

    def _add(self, keys: np.ndarray, short: np.ndarray, said: str, first: np.ndarray, size: np.ndarray) -> None:
        flat, n = self._encoded([said[i : i + k] for i, k in zip(first.tolist(), size.tolist(), strict=True)])
        slots = np.arange(len(self.blocks), len(self.blocks) + len(keys), dtype=np.int32)
        self.ids_end = np.concatenate([self.ids_end, (self.ids_pool.add(flat) + np.cumsum(n)).astype(np.int32)])
        self.text_end = np.concatenate([self.text_end, (self.texts.add(short[ragged(first, size)]) + np.cumsum(size)).astype(np.int32)])
        self.blocks = np.concatenate([self.blocks, np.zeros(len(keys), np.uint8)])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, where, keys), np.insert(self.slot, where, slots)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's offsets into them."""
        cp, first, last, before = pieces(texts, self.kinds)
        size = last - first
        odd = size > LONGEST
        wide = np.flatnonzero(cp > 0xFFFF)  # separators as well
        if len(first):
            at = np.maximum(np.searchsorted(first, wide, "right") - 1, 0)
            odd[at[wide < last[at]]] = True
        cp[cp == SEPARATOR] = 0
        said = cp.tobytes().decode("utf-32-le", "surrogatepass")
        short = np.zeros(len(cp) + 4, np.uint16)
        short[: len(cp)] = cp
        del cp, wide
        usual = np.flatnonzero(~odd)
        start, length = first[usual], size[usual]
        hashes, index, inverse = np.unique(spans_hash(short.view(np.uint8), 2 * start, 2 * length), return_index=True, return_inverse=True)
        if len(self.keys) > self.most or self.texts.used > self.characters:
            self._trim()
        where = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        inside = where < len(self.keys)
        new[inside] = self.keys[where[inside]] != hashes[inside]
        if new.any():
            self._add(hashes[new], short, said, start[index[new]], length[index[new]])
            where = np.searchsorted(self.keys, hashes)
        slots = self.slot[where]
        self.blocks[slots] = np.minimum(self.blocks[slots], 254) + 1
        slots = slots[inverse]
        text_at = self.text_end[slots].astype(np.int64)
        same = self.text_end[slots + 1] - text_at == length
        same[same] = equal(short, start[same], self.texts.data, text_at[same], length[same])
        n, at = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        at[usual] = self.ids_end[slots]
        n[usual] = self.ids_end[slots + 1] - at[usual]
        odd[usual[~same]] = True  # another piece has their hash
        sums = np.zeros(len(n) + 1, np.int64)
        rest = np.flatnonzero(odd)
        if not len(rest):
            np.cumsum(n, out=sums[1:])
            return self.ids_pool.data[ragged(at, n)], sums[before]
        number: dict[str, int] = {}
        which = np.array([number.setdefault(said[i:j], len(number)) for i, j in zip(first[rest].tolist(), last[rest].tolist(), strict=True)])
        flat, count = self._encoded(list(number))
        n[rest] = count[which]
        np.cumsum(n, out=sums[1:])
        at[rest] = 0
        out = np.zeros(int(sums[-1]), np.uint32)
        few = np.where(odd, 0, n)
        out[ragged(sums[:-1], few)] = self.ids_pool.data[ragged(at, few)]
        out[ragged(sums[rest], n[rest])] = flat[ragged((np.cumsum(count) - count)[which], n[rest])]
        return out, sums[before]


def documents_ids(texts: list[str | None], cache: PieceCache):
    """For each text in order (null: empty) parts of its ids: yields (row, ids, whether the row ends)."""
    batch: list[tuple[int, str, bool]] = []
    size = 0

    def flush():
        ids, offsets = cache.ids([part for _, part, _ in batch])
        for k, (row, _, done) in enumerate(batch):
            yield row, ids[offsets[k] : offsets[k + 1]], done

    for row, text in enumerate(texts):
        parts = list(segments(text or ""))
        for k, part in enumerate(parts):
            batch.append((row, part, k == len(parts) - 1))
            size += len(part)
            if size >= BLOCK:
                yield from flush()
                batch, size = [], 0
    if batch:
        yield from flush()
