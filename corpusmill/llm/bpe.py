"""Byte-level BPE encoding and decoding.

The merge ranks are compiled into a transducer over bytes that is determinised lazily: a state holds the last
emitted token and the bytes after it whose split may still change; the transitions of a state are made when a
piece first needs them. A token is emitted as soon as every split that later bytes can still prefer goes
through its end, so the lookahead is bounded by the longest token. Decoding streams: the bytes of tokens go
through an incremental UTF-8 state machine that holds back an unfinished character only.

Nulls are encoded as empty texts (no ids); repeated rows give repeated results, an empty table none. A very long text
is worked on in parts, cut where no piece can end differently. ``encode`` and ``decode`` keep all other columns and
replace one that has the name of theirs; ``round_trip`` returns the key and its figures only.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import ragged
from .common import kept, small_batches
from .pretokens import PieceCache, classes, documents_ids

#: States kept by a worker before it starts anew; a state with its moves and token pairs takes some 500 bytes.
MOST_STATES = 60_000
#: Where a state has no last token: it is of no use any more, or nothing came before.
NO_TOKEN, BEGIN = -2, -1
#: Places of the filter that keeps moves out which are asked for once only.
DOORS = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file: base64 and rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Transducer:
    """Encodes pieces of bytes by merge ranks.

    A state is one string of bytes: the rank of the last token (four bytes; see ``NO_TOKEN`` and ``BEGIN``), the pending
    bytes, and for each of them the length of the token that ends there, or 0 (a byte each, or two with long tokens).
    """

    def __init__(self, ranks: dict[bytes, int], most: int = MOST_STATES) -> None:
        self.ranks, self.most = ranks, most
        self.single = [bytes([i]) for i in range(256)]
        self.size = "B" if max(map(len, ranks)) < 256 else "H"
        # for tokens and their beginnings: rank * 2, -2 for no token, and 1 more if a longer token begins so
        self.known = {t: 2 * i for t, i in ranks.items()}
        for t in ranks:
            for k in range(len(t) - 1, 0, -1):
                if (x := self.known.get(t[:k], -2)) & 1:
                    break
                self.known[t[:k]] = x + 1
        self.tokens = {i: t for t, i in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.clear()

    def clear(self) -> None:
        self.good: set[int] = set()  # pairs of tokens, as rank << 32 | rank
        self.bad: set[int] = set()
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.moves: dict[int, int] = {}  # by state * 256 + byte: emitted << 32 | state
        self.ends = array("l")  # what a piece that ends there emits, -1 if not asked yet
        self.emitted: list[tuple[int, ...]] = []
        self.emits: dict[tuple[int, ...], int] = {}
        self.emit(())
        self.doors, self.opened = bytearray(DOORS), 0
        self.saved(self.packed(BEGIN, b"", []))

    def emit(self, ids: tuple[int, ...]) -> int:
        if ids not in self.emits:
            self.emits[ids] = len(self.emitted)
            self.emitted.append(ids)
        return self.emits[ids]

    def packed(self, u: int, p: bytes, ends: list[int]) -> bytes:
        return (u + 2).to_bytes(4, "little") + p + (bytes(ends) if self.size == "B" else array("H", ends).tobytes())

    def saved(self, key: bytes) -> int:
        """The number of the state."""
        number = self.number.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
            self.ends.append(-1)
        return number

    def asked(self, key: bytes, byte: int) -> bool:
        """Whether the state's move was asked for before (or one of the same door): only such moves are saved."""
        door = (hash(key) ^ byte * 0x9E3779B1) % DOORS
        if self.doors[door]:
            return True
        self.doors[door] = 1
        self.opened += 1
        if 2 * self.opened > DOORS:
            self.doors, self.opened = bytearray(DOORS), 0
        return False

    def unpacked(self, number: int) -> tuple[int, bytes, list[int]]:
        key = self.states[number]
        m = (len(key) - 4) // (2 if self.size == "B" else 3)
        return int.from_bytes(key[:4], "little") - 2, key[4 : 4 + m], list(key[4 + m :] if self.size == "B" else array("H", key[4 + m :]))

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            whole = self.tokens[token]
            have = [self.single[i] for i in whole]
            while len(have) > 2:
                low = min(((self.ranks[j], i) for i in range(len(have) - 1) if (j := have[i] + have[i + 1]) in self.ranks and len(j) < len(whole)), default=None)
                if low is None:
                    break
                have[low[1] : low[1] + 2] = [have[low[1]] + have[low[1] + 1]]
            self.halves[token] = (self.ranks[have[0]], self.ranks[have[1]]) if len(have) == 2 else None
        return self.halves[token]

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b apart: undoes their merges, the latest first, and looks for one across."""
        pair = a << 32 | b
        if pair in self.good:
            return True
        if pair in self.bad:
            return False
        x, y, limit, good, tokens = a, b, len(self.ranks) + 1, True, self.tokens
        while True:
            if self.ranks.get(tokens[x] + tokens[y], limit) < limit:
                good = False
                break
            px, py = self.parts(x), self.parts(y)
            if px is None and py is None:
                break
            if py is None or px is not None and x > y:
                limit, x = x, px[1]  # at one rank the left merge comes first
            else:
                limit, y = y + 1, py[0]
        (self.good if good else self.bad).add(pair)
        return good

    def step(self, u: int, p: bytes, ends: list[int], byte: int) -> tuple[tuple[int, ...], int, bytes, list[int]]:
        """What a state (last token, pending bytes, lengths of the tokens that end there) emits at a byte, and the next state."""
        known, good, p, m, found = self.known, self.good, p + self.single[byte], len(p) + 1, 0
        live = []  # ends after which a longer token may still begin
        for s in range(m):
            n = ends[s - 1] if s else u != NO_TOKEN
            if not n or (k := known.get(p[s:])) is None:
                continue
            if k & 1:
                live.append(s)
            if k >= 0 and not found:
                k >>= 1
                before = self.ranks[p[s - n : s]] if s else u
                if before == BEGIN or before << 32 | k in good or self.follows(before, k):
                    found = m - s
        ends = [*ends, found]
        if found:
            live.append(m)
        while len(live) > 1:  # the last position that every way still open goes through
            at = live.pop()
            if (back := at - ends[at - 1]) not in live:
                live.append(back)
                live.sort()
        cut, emitted = live[0] if live else 0, ()
        if cut:
            emitted = self.tail(p, ends, cut)
            u, rest = emitted[-1], []
            for j in range(cut + 1, m + 1):  # ends whose way avoids the cut are of no use any more
                at = j if ends[j - 1] else 0
                while at > cut:
                    at -= ends[at - 1]
                rest.append(ends[j - 1] if at == cut else 0)
            p, ends = p[cut:], rest
        if p and not known.get(p, 0) & 1:  # no later token starts at the cut
            u = NO_TOKEN
        return emitted, u, p, ends

    def tail(self, p: bytes, ends: list[int], at: int) -> tuple[int, ...]:
        """The tokens that lead from the start of p to the position, in order."""
        out = []
        while at:
            n = ends[at - 1]
            out.append(self.ranks[p[at - n : at]])
            at -= n
        return tuple(out[::-1])

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > self.most:
            self.clear()
        at, out, moves, here = 0, [], self.moves, None  # at: the state's number, -1 if it is not saved
        for byte in piece:
            if at >= 0:
                move = moves.get(at << 8 | byte)
                if move is not None:
                    at, here = move & 0xFFFFFFFF, None
                    if move != at:
                        out.extend(self.emitted[move >> 32])
                    continue
                if here is None:
                    here, key = self.unpacked(at), self.states[at]
            emitted, *after = self.step(*here, byte)
            out.extend(emitted)
            again, was, here = self.asked(key, byte), at, after
            key = self.packed(*here)
            if again:
                at = self.saved(key)
                if was >= 0:
                    moves[was << 8 | byte] = (self.emit(emitted) if emitted else 0) << 32 | at
            else:
                at = self.number.get(key, -1)
        if at < 0:
            return out + list(self.tail(here[1], here[2], len(here[1])))
        if self.ends[at] < 0:
            _, p, ends = here or self.unpacked(at)
            self.ends[at] = self.emit(self.tail(p, ends, len(p)))
        out.extend(self.emitted[self.ends[at]])
        return out


class Decoder:
    """Bytes of ids, as arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.n) - self.n
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes(self, ids: np.ndarray) -> bytes:
        return self.pool[ragged(self.at[ids], self.n[ids])].tobytes()


class Utf8Stream:
    """An incremental UTF-8 state machine: text of whole characters now, an unfinished one with the next part."""

    def __init__(self) -> None:
        self.kept = b""

    def feed(self, part: bytes, last: bool = False) -> str:
        part, cut = self.kept + part, len(part) + len(self.kept)
        if not last:
            for back in range(1, min(3, len(part)) + 1):
                lead = part[-back]
                if lead < 0x80:
                    break
                if lead >= 0xC0:
                    if (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) > back:
                        cut = len(part) - back
                    break
        self.kept = part[cut:]
        return part[:cut].decode("utf-8", "replace")


def joined_by_tiktoken(first: str, others: list[str]) -> list[bool]:
    """Whether tiktoken makes one piece of ``first`` and each of the other characters, at the public pattern."""
    import public_tokenizers
    import tiktoken

    # of the merges only those over the seam exist, so a token of two bytes shows that there is none between pieces
    ranks = {bytes([i]): i for i in range(256)} | {first.encode() + bytes([i]): 256 + i for i in range(256)}
    coding = tiktoken.Encoding("seams", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    items = [first + x + "\n" for x in others]
    ids = np.array(coding.encode_ordinary("".join(items)))
    size = np.where(ids > 255, 2, 1)
    starts = np.cumsum([0, *(len(x.encode()) for x in items)])[:-1]
    return (ids[np.searchsorted(np.cumsum(size) - size, starts)] > 255).tolist()


@functools.cache
def _kinds() -> np.ndarray:
    return classes(joined_by_tiktoken)


def _shared(spark: SparkSession, ranks_path: str):
    """What every worker needs, as a broadcast: a name of the vocabulary, the ranks and the classes of characters."""
    ranks = read_ranks(ranks_path)
    name = hashlib.md5(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast((name, ranks, _kinds()))


def _coder(shared: tuple) -> tuple[PieceCache, Decoder]:
    """A worker's transducer and decoder; they stay for its later tasks."""
    name, ranks, kinds = shared

    def make():
        t = Transducer(ranks)
        return PieceCache(lambda words: [t.encode(w.encode("utf-8", "surrogatepass")) for w in words], kinds), Decoder(ranks)

    return kept(("bpe", name), make)


def encode(df: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each text as array<int>."""
    small_batches(df.sparkSession)
    shared = _shared(df.sparkSession, ranks_path)
    df = df.drop(ids)
    schema = df.select("*", F.lit(None).cast("array<int>").alias(ids)).schema

    def run(batches):
        cache, _ = _coder(shared.value)
        for b in batches:
            rows: list[list[int]] = [[] for _ in range(b.num_rows)]
            for row, part, _ in documents_ids(b.column(text).to_pylist(), cache):
                rows[row].extend(part.tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.int32()))], [*b.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids, decoded as a stream of parts; null ids give an empty text."""
    small_batches(df.sparkSession)
    shared = _shared(df.sparkSession, ranks_path)
    df = df.drop(text)
    schema = df.select("*", F.lit(None).cast("string").alias(text)).schema

    def run(batches):
        _, decoder = _coder(shared.value)
        for b in batches:
            out = []
            for row in b.column(ids).to_pylist():
                stream, a = Utf8Stream(), np.array(row or [], np.int64)
                out.append("".join(stream.feed(decoder.bytes(a[i : i + 65536])) for i in range(0, len(a), 65536)) + stream.feed(b"", True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, text])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, decodes its ids and returns the digests of both: key, n_tokens, ids_sha256,
    decoded_sha256 and round_trip_ok (whether the decoded text equals the text)."""
    small_batches(df.sparkSession)
    shared = _shared(df.sparkSession, ranks_path)
    src = df.select(F.col(key), F.col(text))
    schema = src.select(key, F.lit(0).cast("long").alias("n_tokens"), *(F.lit("").alias(c) for c in ("ids_sha256", "decoded_sha256")), F.lit(True).alias("round_trip_ok")).schema

    def run(batches):
        cache, decoder = _coder(shared.value)
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            n, ids_hash, bytes_hash, stream, at, ok = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream(), 0, True
            for row, ids, done in documents_ids(texts, cache):
                n += len(ids)
                ids_hash.update(ids.astype("<u4").tobytes())
                raw = decoder.bytes(ids)
                bytes_hash.update(raw)
                said = stream.feed(raw, done)
                ok = ok and (texts[row] or "").startswith(said, at)
                at += len(said)
                if done:
                    out.append((n, ids_hash.hexdigest(), bytes_hash.hexdigest(), ok and at == len(texts[row] or "")))
                    n, ids_hash, bytes_hash, stream, at, ok = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream(), 0, True
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_())))], schema.names)

    return src.mapInArrow(run, schema)
