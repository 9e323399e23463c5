"""Language identification by interpolated Kneser-Ney character models.

A model of order 5 is fitted for every language on a bounded sample of labelled rows. Its grams are 64-bit hashes
in sorted arrays with a directory over their leading bits; the arrays of all languages are merged, so that one
lookup gives a character's probabilities in every language. A text gets the language of the lowest cross-entropy
per character; texts far above the entropies that held-back labelled texts had are rejected. Letters are
lower-cased, all other characters count as one space.

Nulls and texts without letters: ``und`` with score 0, not rejected as foreign but marked rejected (there is
nothing to keep). Null labels are never learned from. Equal entropies go to the first language by name. Without
any labelled row every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import U64, mix
from .common import maybe_broadcast, release, small_batches, tidy, written

ORDER = 5
#: Labelled rows that are learned from, for each language; every fifth of them calibrates the rejection.
SAMPLE_ROWS = 500
#: A text is rejected this far (nats a character) above the calibration texts, or as far as 1.5 times their spread.
SLACK = 1.0
DISCOUNT = 0.75
UNKNOWN = "und"
#: Characters scored at once; bounds the memory for very long texts.
BLOCK = 1 << 16
_STEP = U64(0x9E3779B97F4A7C15 | 1)
_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code points to lower-cased letters; all else to a space. The end mark stays 0."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(65, 0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        table[0] = 0
        _FOLD = table
    return _FOLD


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts, each behind ORDER zeros, and the number of the text of each."""
    text = "".join("\0" * ORDER + (t or "").replace("\0", " ") for t in texts)
    c = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter((len(t or "") + ORDER for t in texts), np.int64, len(texts)))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) & (c[:-1] != 0)
    return c[keep], owner[keep]


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n characters up to each position; the first n - 1 positions are of no use."""
    h = np.zeros(len(c), U64)
    c = c.astype(U64) + U64(1)
    for k in range(n - 1, -1, -1):
        h *= _STEP
        h[k:] += c[: len(c) - k] if k else c
    return mix(h + U64(n))


def grams_at(c: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """As ``grams``, at some positions only."""
    h = np.zeros(len(at), U64)
    for k in range(n - 1, -1, -1):
        h *= _STEP
        h += c[at - k] + U64(1)
    return mix(h + U64(n))


class Sorted:
    """A sorted hash array with a directory over the leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = int(len(keys)).bit_length() + 2
        self.shift = U64(64 - self.bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << self.bits) + 1, dtype=U64)).astype(np.int64)
        self.keys = np.append(keys, U64(2**64 - 1))  # the last one ends every search

    def find(self, q: np.ndarray) -> np.ndarray:
        """The index of each q, or -1."""
        at = self.first[(q >> self.shift).view(np.int64)]
        have = self.keys[at]
        out = np.where(have == q, at, -1)
        left = np.flatnonzero(have < q)
        q, at = q[left], at[left]
        while len(left):  # as often as the fullest cell of the directory has keys
            at = at + 1
            have = self.keys[at]
            out[left[have == q]] = at[have == q]
            go = have < q
            left, q, at = left[go], q[go], at[go]
        return out


def fit_language(texts: list[str]) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
    """An interpolated Kneser-Ney model as rows (order, sorted gram hashes, probabilities, suffixes, contexts).

    Order n has the grams with their interpolated probabilities; order -n the contexts with what they leave to the
    order below.
    """
    c, _ = codes(texts)
    real = c != 0
    at = np.flatnonzero(real)
    hashes = {n: grams(c, n)[at] if n else np.zeros(len(at), U64) for n in range(ORDER + 1)}
    before = {n: grams(c, n)[at - 1] if n else np.zeros(len(at), U64) for n in range(ORDER)}
    shorter = {}  # of each distinct gram: its suffix, its context and the suffix without the last character
    counts = {}
    for n in range(ORDER, 0, -1):
        keys, index, count = np.unique(hashes[n], return_index=True, return_counts=True)
        shorter[n] = hashes[n - 1][index], before[n - 1][index]
        if n < ORDER:  # continuation counts: distinct longer grams that end in this one
            suffix = shorter[n + 1][0]
            k, count = np.unique(suffix, return_counts=True)
            assert len(k) == len(keys)
        counts[n] = keys, count.astype(np.float64)
    rows = []
    symbols = len(counts[1][0]) + 1
    keys, count = counts[1]
    p = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * len(keys) / symbols) / max(count.sum(), 1)
    below = keys, p
    rows.append((1, keys.tobytes(), p.tobytes(), np.array([DISCOUNT * len(keys) / max(count.sum(), 1) / symbols]).tobytes(), b""))
    for n in range(2, ORDER + 1):
        keys, count = counts[n]
        suffix, context = shorter[n]
        ctx, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, count, len(ctx))
        rest = DISCOUNT * np.bincount(inverse, minlength=len(ctx)) / total
        lower = below[1][np.searchsorted(below[0], suffix)]
        p = np.maximum(count - DISCOUNT, 0) / total[inverse] + rest[inverse] * lower
        rows.append((n, keys.tobytes(), p.tobytes(), suffix.tobytes(), context.tobytes()))
        rows.append((-n, ctx.tobytes(), rest.tobytes(), b"", b""))
        below = keys, p
    return rows


class Models:
    """The merged models of all languages."""

    def __init__(self, rows: dict[str, list[tuple[int, bytes, bytes, bytes, bytes]]]) -> None:
        self.langs = sorted(rows)
        self.limits: dict[str, tuple[float, float]] = {}
        self.gram: dict[int, tuple[Sorted, np.ndarray]] = {}
        self.rest: dict[int, tuple[Sorted, np.ndarray]] = {}
        if not rows:
            return
        one = {lang: {n: (np.frombuffer(k, U64), np.frombuffer(p), s, c) for n, k, p, s, c in r} for lang, r in rows.items()}
        self.floor = np.log([np.frombuffer(one[x][1][2])[0] for x in self.langs]).astype(np.float32)
        for n in range(1, ORDER + 1):
            if n > 1:
                self.rest[n] = self.merged([one[x][-n][:2] for x in self.langs], 0.0)
            table, values = self.merged([one[x][n][:2] for x in self.langs], np.nan)
            lower = np.broadcast_to(self.floor, values.shape)
            if n > 1:  # where a language lacks a gram, its value comes from the orders below
                suffix, context = np.zeros(len(values), U64), np.zeros(len(values), U64)
                for x in self.langs:
                    where = np.searchsorted(table.keys, one[x][n][0])
                    suffix[where], context[where] = np.frombuffer(one[x][n][2], U64), np.frombuffer(one[x][n][3], U64)
                lower = self.rest[n][1][self.rest[n][0].find(context)] + self.gram[n - 1][1][self.gram[n - 1][0].find(suffix)]
            self.gram[n] = table, np.where(np.isnan(values), lower, values)
        nothing = np.zeros((1, len(self.langs)), np.float32)  # the row that index -1 finds
        for tables in (self.gram, self.rest):
            for n, (table, values) in tables.items():
                tables[n] = table, np.concatenate([values, nothing])

    def merged(self, each: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[Sorted, np.ndarray]:
        """The sorted keys of all languages and the logarithms of their values, one column a language."""
        keys = np.unique(np.concatenate([k for k, _ in each]))
        values = np.full((len(keys), len(each)), missing, np.float32)
        for i, (k, v) in enumerate(each):
            values[np.searchsorted(keys, k), i] = np.log(v)
        return Sorted(keys), values

    def log_probabilities(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the characters at the positions, one column a language."""
        table, values = self.gram[ORDER]
        found = table.find(grams(c, ORDER)[at])
        out = np.take(values, found, axis=0)
        left = np.flatnonzero(found < 0)
        c = c.astype(U64)
        for n in range(ORDER - 1, 0, -1):
            if not len(left):
                return out
            part = at[left]
            table, values = self.rest[n + 1]
            add = np.take(values, table.find(grams_at(c, part - 1, n)), axis=0)
            table, values = self.gram[n]
            found = table.find(grams_at(c, part, n))
            out[left] += add + np.take(values, found, axis=0)
            left = left[found < 0]
        out[left] += self.floor
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's cross-entropy per character in every language, and its number of letters and spaces."""
        sums, n, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts)), np.zeros(len(texts))
        held: list[tuple[int, str]] = []
        size = 0

        def score() -> None:
            c, owner = codes([t for _, t in held])
            row = np.array([r for r, _ in held], np.int64)
            at = np.flatnonzero(c != 0)
            for i in range(0, len(at), BLOCK):
                part = at[i : i + BLOCK]
                lo = max(0, int(part[0]) - ORDER)
                logs = self.log_probabilities(c[lo : int(part[-1]) + 1], part - lo)
                own = row[owner[part]]
                firsts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                np.add.at(sums, own[firsts], np.add.reduceat(logs, firsts, axis=0, dtype=np.float64))
                n[:] += np.bincount(own, minlength=len(texts))
                letters[:] += np.bincount(own, c[part] != 32, len(texts))

        for r, t in enumerate(texts):
            held.append((r, t or ""))
            size += len(t or "")
            if size >= BLOCK:
                score()
                held, size = [], 0
        if held:
            score()
        with np.errstate(invalid="ignore", divide="ignore"):
            return -sums / n[:, None], np.where(letters > 0, n, 0)

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Mean entropy and admitted excess of each language, from labelled texts that the model has not seen."""
        for i, x in enumerate(self.langs):
            h, n = self.entropies(texts.get(x) or [])
            h, n = h[n > 0, i] if len(n) else h[:0, 0], n[n > 0]
            mean = float(np.average(h, weights=n)) if len(h) else float(-self.floor[i] / 2)
            long = h[n >= 50] - mean
            self.limits[x] = mean, max(SLACK, 1.5 * float(np.quantile(long, 0.995)) if len(long) else SLACK)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1 and whether it is rejected."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, n = self.entropies(texts)
        empty = n == 0
        h[empty] = 0
        best = h.argmin(1)
        odds = np.exp((h.min(1)[:, None] - h) * np.minimum(n, 100)[:, None])
        score = np.round(np.where(empty, 0, 1 / odds.sum(1)), 6)
        mean, slack = (np.array([self.limits[x][i] for x in self.langs])[best] for i in (0, 1))
        rejected = empty | (h.min(1) > mean + slack + 4 / np.sqrt(np.maximum(n, 1)))
        return [UNKNOWN if e else self.langs[b] for e, b in zip(empty, best, strict=True)], score, rejected


def held_out(df: DataFrame, key: str = "doc_id"):
    """Whether crc32 of the key as text, modulo 5, is 0; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """(doc_id, lang, text) of up to ``rows`` labelled texts of each language, the first by a hash of doc_id and text.

    Texts without letters are of no use and repeated rows count once. The languages' sizes tell below which hash the
    first ones lie, about four times as many, so that only those are sorted and no language's rows meet in one task.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(docs) & F.col("text").rlike("\\p{L}"))
    known = known.withColumn("_h", F.xxhash64("doc_id", "text"))
    sizes = written(known.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n")))
    share = (4 * rows + 200) / F.col("_n")
    low = known.join(maybe_broadcast(sizes), "lang").where(F.pmod("_h", F.lit(1 << 31)) < share * (1 << 31))
    once = low.groupBy("lang", "doc_id", "_h").agg(F.first("text").alias("text"))
    order = W.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 31)), "_h", "doc_id")
    return written(once.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= rows).select("doc_id", "lang", "text"))


@tidy
def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Models:
    """Fits on up to ``rows`` labelled texts of each language."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"])
        every = np.arange(len(group)) % 5 == 4
        seen, kept = list(group.text[~every]), list(group.text[every])
        out = fit_language(seen or kept) if any(codes(seen or kept)[0]) else []
        return pd.DataFrame([(group.lang.iloc[0], *x, "") for x in out] + [(group.lang.iloc[0], 0, b"", b"", b"", b"", t) for t in kept if out], columns=["lang", "n", "keys", "p", "suffix", "context", "text"])

    models: dict[str, list] = {}
    kept: dict[str, list[str]] = {}
    for x in sample(docs, rows).groupBy("lang").applyInPandas(run, "lang string, n int, keys binary, p binary, suffix binary, context binary, text string").collect():
        if x.n:
            models.setdefault(x.lang, []).append((x.n, *map(bytes, x[2:6])))
        else:
            kept.setdefault(x.lang, []).append(x.text)
    made = Models(models)
    made.calibrate(kept)
    return made


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """Adds held_out, lang_pred, score and rejected to each row; only ``text`` is an input of the prediction."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    new = ["lang_pred", "score", "rejected"]
    src = docs.drop("held_out", *new).withColumn("held_out", held_out(docs))
    schema = src.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema

    def run(batches):
        release()
        for b in batches:
            langs, score, rejected = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], schema.names)

    return src.mapInArrow(run, schema)
