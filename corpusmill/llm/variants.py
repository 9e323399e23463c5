"""Spelling variants by a frequency-vector trie.

A word's vector counts its letters by group (code points modulo 32, so that an accented letter mostly falls to another
group than its plain one). In the trie, level 0 is the number of letters and each further level the count of one group,
frequent letters first. One inserted, deleted or replaced letter changes a vector by a surplus of at most one in one
group and a deficit of at most one in another, so a depth-first search spends a budget of one of each; the words of the
leaves that it reaches are verified letter by letter.

The upper levels of the trie deal out its subtrees: as many levels as it takes until none has more than ``SUBTREE`` words,
up to ``DEPTH``; larger subtrees are salted. Each word is looked for in the subtrees that the budget can reach, once in
each, and only sums leave a subtree: how many near words a word has in it and the best one.

Null texts have no words and a null doc_id stands as an empty string in the key of a run; an empty table gives no rows;
repeated rows count again, other columns, of whatever name, are not read. Texts and words may be of any length. Of near
words with equal n the smallest in code-point order is the form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BASE, U64, mix, ragged, utf8
from .common import ascii_lower, maybe_broadcast, release, small_batches, tidy, written

#: Words have so many letters and occurrences at least, and forms so many times the occurrences of their variants.
LETTERS, LEAST, RATIO = 6, 5, 5
#: One in so many (document, run) pairs loses a letter.
EVERY = 199
GROUPS = 32
#: Letters by how frequent they are in European languages, about; the trie's levels follow them. Any order is right.
ORDER = "eainrtosldcumhgpbfvkwyzxjq"
LEVELS = np.array([*(ord(c) % GROUPS for c in ORDER), *(g for g in range(GROUPS) if g not in {ord(c) % GROUPS for c in ORDER})])
#: Words of a subtree, and the most levels that name one.
SUBTREE, DEPTH = 5_000, 8
#: A node of at most so many vectors is searched without going down further.
NODE = 48
#: Longer words are verified one by one.
WIDE = 48
#: Words searched for together; pairs compared together.
QUERIES, PAIRS = 4096, 1 << 20


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words, after the loss of letters."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.explode(F.split(text, r"[^A-Za-zÀ-ÿ]+")).alias("_run"))
    runs = runs.where(F.length("_run") >= LETTERS).select("_id", ascii_lower(F.col("_run")).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run"))
    hashed = runs.select("_run", h.alias("_h"))
    at = f"cast(_h % length(_run) as int)"
    lost = F.expr(f"concat(substring(_run, 1, {at}), substring(_run, {at} + 2))")
    words = hashed.select(F.when(F.col("_h") % EVERY == 0, lost).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words and each word's offsets into them."""
    text = "".join(words.to_pylist())
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), at


def vectors(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each word: its length and its letters by group, in the order of the levels."""
    m = len(at) - 1
    spot = np.repeat(np.arange(m), np.diff(at)) * GROUPS + (cp % GROUPS).astype(np.int64)
    counts = np.bincount(spot, minlength=m * GROUPS).reshape(m, GROUPS)
    return np.column_stack([np.diff(at), counts[:, LEVELS]]).astype(np.int32)


def _name(rows: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of counts. Subtrees that share a name are searched as one."""
    h = np.zeros(len(rows), U64)
    for k in range(rows.shape[1]):
        h = mix((h ^ rows[:, k].astype(U64)) * U64(BASE) + U64(k + 1))
    return h.view(np.int64)


def moves(depth: int) -> np.ndarray:
    """The changes of the upper levels (length, then ``depth`` groups) that the budgets allow."""
    out = []
    for up in range(-1, depth):
        for down in range(-1, depth):
            if up == down != -1:
                continue
            step = np.zeros(depth + 1, np.int64)
            if up >= 0:
                step[up + 1] = 1
            if down >= 0:
                step[down + 1] = -1
            # a surplus or deficit that is not seen here may be spent further down
            for length in {-1, 0, 1} - ({-1} if up >= 0 else set()) - ({1} if down >= 0 else set()):
                out.append([length, *step[1:]])
    return np.array(out)


class Trie:
    """The words of a subtree, sorted by their vectors, so that each node is a range."""

    def __init__(self, words: pa.Array, n: np.ndarray) -> None:
        cp, at = letters(words)
        v = vectors(cp, at)
        order = np.lexsort(v.T[::-1])
        self.words, self.n = words.take(pa.array(order)), n[order]
        self.cp, self.at = letters(self.words)
        self.vectors, first = np.unique(v[order], axis=0, return_index=True)
        self.first = np.append(first, len(order))
        self.padded = _padded(self.cp, self.at)
        self.texts = self.words.to_pylist()

    def search(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, place in the trie) of near words."""
        cp, at = letters(words)
        self.asked, self.q = words.to_pylist(), vectors(cp, at)
        self.q_padded, self.q_length = _padded(cp, at), np.diff(at)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        here = np.arange(len(words))
        self._down(0, len(self.vectors), 0, here, np.zeros(len(here), np.int8), np.zeros(len(here), np.int8))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64),) * 2

    def _down(self, i: int, j: int, level: int, asked: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        """Vectors i to j agree above ``level``; ``asked`` are the words that still can afford what differs from them there."""
        if not len(asked):
            return
        if j - i <= NODE or level == self.vectors.shape[1]:
            self._leaves(i, j, level, asked, surplus, deficit)
            return
        column = self.vectors[i:j, level]
        edges = np.flatnonzero(np.diff(column)) + 1
        wanted = self.q[asked, level]
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), j - i], strict=True):
            more = column[a] - wanted
            if level:
                s, d = surplus + (more > 0), deficit + (more < 0)
                go = (np.abs(more) <= 1) & (s <= 1) & (d <= 1)
            else:  # the length takes nothing from the budgets
                s, d, go = surplus, deficit, np.abs(more) <= 1
            self._down(i + a, i + b, level + 1, asked[go], s[go], d[go])

    def _leaves(self, i: int, j: int, level: int, asked: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        step = max(1, PAIRS // (j - i) // 8)
        for k in range(0, len(asked), step):
            own = asked[k : k + step]
            go = np.ones((len(own), j - i), bool)
            s, d = (np.repeat(x[k : k + step, None], j - i, 1) for x in (surplus, deficit))
            for x in range(level, self.vectors.shape[1]):
                more = self.vectors[None, i:j, x] - self.q[own, x][:, None]
                if x:
                    s, d = s + np.maximum(more, 0), d + np.maximum(-more, 0)
                    go &= (s <= 1) & (d <= 1)
                else:
                    go &= np.abs(more) <= 1
            rows, leaves = np.nonzero(go)
            self._verify(own[rows], i + leaves)

    def _verify(self, asked: np.ndarray, leaves: np.ndarray) -> None:
        size = self.first[leaves + 1] - self.first[leaves]
        for many in np.flatnonzero(size > NODE * NODE):  # a leaf of very many words: by halves
            self.found.append(self._halves(asked[many], int(leaves[many])))
        few = size <= NODE * NODE
        asked, leaves, size = asked[few], leaves[few], size[few]
        ends = np.cumsum(size)
        k = 0
        while k < len(size):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
            x, y = np.repeat(asked[k:stop], size[k:stop]), ragged(self.first[leaves[k:stop]], size[k:stop])
            near = self._near(x, y)
            self.found.append((x[near], y[near]))
            k = stop

    def _halves(self, asked: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Near words of a large leaf: they share their first or their last half with the word that is asked."""
        a, b = int(self.first[leaf]), int(self.first[leaf + 1])
        if getattr(self, "_leaf", None) != leaf:
            self._leaf, self._by = leaf, {}
        q, length = self.asked[asked], int(self.vectors[leaf, 0])
        half = min(len(q), length) // 2
        if half not in self._by:
            starts: dict[str, list[int]] = {}
            stops: dict[str, list[int]] = {}
            for y in range(a, b):
                w = self.texts[y]
                starts.setdefault(w[:half], []).append(y)
                for cut in (half, half + 1):
                    stops.setdefault(w[cut:], []).append(y)
            self._by[half] = starts, stops
        starts, stops = self._by[half]
        y = np.array(sorted({*starts.get(q[:half], ()), *stops.get(q[half:], ()), *stops.get(q[half + 1 :], ())}), np.int64)
        x = np.full(len(y), asked)
        near = self._near(x, y)
        return x[near], y[near]

    def _near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs differ by exactly one letter."""
        n, m = self.q_length[x], self.vectors[:, 0][np.searchsorted(self.first, y, "right") - 1]
        out = np.zeros(len(x), bool)
        wide = np.maximum(n, m) > WIDE
        for k in np.flatnonzero(wide):
            out[k] = one_edit(self.asked[x[k]], self.texts[y[k]])
        for longer in (-1, 0, 1):  # by how many letters y is longer
            own = np.flatnonzero(~wide & (m - n == longer))
            if not len(own):
                continue
            a, b = self.q_padded[x[own]], self.padded[y[own]]
            if longer < 0:
                a, b = b, a
            if not longer:
                out[own] = (a != b).sum(1) == 1
            else:  # what b starts with, and what follows one letter later, make up a
                size = np.minimum(n[own], m[own])
                inside = np.arange(WIDE)[None, :] < size[:, None]
                start = np.minimum.accumulate((a[:, :WIDE] == b[:, :WIDE]) & inside, 1).sum(1)
                later = (a[:, :WIDE] == b[:, 1 : WIDE + 1]) | ~inside
                stop = np.minimum.accumulate(later[:, ::-1], 1).sum(1) - (WIDE - size)
                out[own] = start + stop >= size
        return out


def _padded(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of up to ``WIDE`` letters as rows of that width and one; longer ones are cut and not compared here."""
    size = np.minimum(np.diff(at), WIDE)
    out = np.zeros((len(size), WIDE + 1), np.uint32)
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, ragged(np.zeros(len(size), np.int64), size)] = cp[ragged(at[:-1], size)]
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def subtrees(words: DataFrame) -> tuple[int, DataFrame]:
    """How many levels name a subtree, and the words (key, n_words) of each."""

    def run(batches):
        release()
        for b in batches:
            v = vectors(*letters(b.column(0)))
            for depth in range(1, DEPTH + 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), depth, np.int32)), pa.array(_name(v[:, : depth + 1]))], ["depth", "key"])

    sizes = written(words.select("word").mapInArrow(run, "depth int, key long").groupBy("depth", "key").agg(F.count("*").alias("n_words")))
    most = {r.depth: r.n for r in sizes.groupBy("depth").agg(F.max("n_words").alias("n")).collect()}  # DEPTH rows
    depth = next((d for d in sorted(most) if most[d] <= SUBTREE), DEPTH)
    return depth, sizes.where(F.col("depth") == depth).select("key", "n_words")


def routes(words: DataFrame, depth: int) -> DataFrame:
    """Each word (role 0) under its own subtree's key, and (role 1) under those of all that it is looked for in."""
    steps = moves(depth)
    schema = "key long, role int, word string, n long"

    def batch(key: np.ndarray, role: int, words: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), role, np.int32)), words, n], ["key", "role", "word", "n"])

    def run(batches):
        release()
        for b in batches:
            words, n = b.column(0), b.column(1)
            v = vectors(*letters(words))[:, : depth + 1].astype(np.int64)
            yield batch(_name(v), 0, words, n)
            to = v[:, None, :] + steps[None]
            real = (to >= 0).all(2)
            keys = np.where(real, _name(to.reshape(-1, depth + 1)).reshape(real.shape), 0)
            order = np.argsort(keys, 1, kind="stable")
            keys, real = np.take_along_axis(keys, order, 1), np.take_along_axis(real, order, 1)
            real[:, 1:] &= (keys[:, 1:] != keys[:, :-1]) | ~real[:, :-1]  # a subtree once
            row, k = np.nonzero(real)
            yield batch(keys[row, k], 1, words.take(pa.array(row)), n.take(pa.array(row)))

    return words.select("word", "n").mapInArrow(run, schema)


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (a struct: minus n, word) of all words with near words."""
    depth, sizes = subtrees(words)
    salts = written(sizes.select("key", (1 + F.floor(F.col("n_words") / SUBTREE)).cast("int").alias("salts")))
    dealt = routes(words, depth).join(maybe_broadcast(salts), "key")  # subtrees without words are left out
    salt = F.when(F.col("role") == 0, F.array(F.pmod(F.hash("word"), F.col("salts")))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    dealt = dealt.withColumn("salt", F.explode(salt)).select("key", "salt", "role", "word", "n")
    schema = "word string, n_near long, best struct<neg: long, word: string>"

    def run(batches):
        release()
        here, trie, stored = None, None, []

        def answers(words: pa.Array) -> pa.RecordBatch:
            x, y = trie.search(words)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            rows, begin, many = np.unique(x, return_index=True, return_counts=True)
            top = np.maximum.reduceat(trie.n[y], begin) if len(x) else np.zeros(0, np.int64)
            # of the words with the largest n, the smallest
            first = np.flatnonzero(trie.n[y] == np.repeat(top, many))
            best: dict[int, str] = {}
            for k in first.tolist():
                w = trie.texts[y[k]]
                if w < best.get(x[k], w + "\0"):
                    best[x[k]] = w
            struct = pa.StructArray.from_arrays([pa.array(-top), pa.array([best[r] for r in rows.tolist()], pa.string())], ["neg", "word"])
            return pa.RecordBatch.from_arrays([words.take(pa.array(rows)), pa.array(many.astype(np.int64)), struct], ["word", "n_near", "best"])

        for b in batches:
            key, salt, role = (b.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(salt) != 0) | (np.diff(role) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if i == j:
                    continue
                if here != (key[i], salt[i]):
                    here, trie, stored = (key[i], salt[i]), None, []
                if role[i] == 0:
                    stored.append((b.column(3).slice(i, j - i), b.column(4).slice(i, j - i)))
                    continue
                if trie is None:
                    if not stored:
                        continue
                    trie = Trie(pa.concat_arrays([w for w, _ in stored]), np.concatenate([n.to_numpy() for _, n in stored]))
                for k in range(i, j, QUERIES):
                    yield answers(b.column(3).slice(k, min(QUERIES, j - k)))

    found = dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "role").mapInArrow(run, schema)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


@tidy
def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): the end of each word's chain of forms.

    Chains are halved in each round; as n grows by ``RATIO`` with each step, they are short.
    """
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        now = written(now.join(on, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        if now.where("_moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


@tidy
def group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of all words."""
    words = written(occurrences(docs, key, text))
    small_batches(docs.sparkSession, 20_000)
    near = neighbours(words)
    enough = -F.col("best.neg") >= RATIO * F.col("n")
    known = words.join(near, "word", "left")
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.neg")).alias("form_n")))
    ends = roots(known.where("form is not null").select("word", "form"))
    return written(known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
