"""Phrase collocations by stripes: each prefix keys an associative counter of the words that follow it.

A stripe is (lang, prefix of one or two words, next words, their counts, the prefix's total). Tasks build the stripes of
their own texts; a shuffle brings those of one prefix together, sorted, and they are merged elementwise. The merged
stripes hold all that is asked: the extensions (phrases of two and three words), the prefix totals (how often a first
word occurs, followed by whatever) and the subsumption maxima (the most frequent extension of a phrase to either side).
The empty prefix's total is the number of words.

Stripes of words come first, then those of pairs; words that occur less than ``least`` times are left out of both, and
pairs that do out of the second. Tasks know them by tables of bounded size: a sketch of the words' counts, each cell at
least the count of any word that falls on it, and a map of the pairs that were found frequent. A full table holds nothing
back; results are the same. A prefix is split by its next words' hashes into as many chunks as its cell, which all tasks
see alike, asks for, so that no stripe outgrows a task.

Null texts are empty, a null language is ``und``; an empty table gives no rows, repeated rows count again, and other
columns, of whatever name, are not read. Texts of any length are read in blocks that end where a piece ends. Ties are
ordered by a and phrase. Counts are exact below 1e15.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import _LOWER, BASE, CODED, U64, code, mix, spans_hash, utf8
from .common import maybe_broadcast, release, small_batches, tidy, written

#: Candidates occur so often at least.
LEAST = 10
#: A candidate goes if a longer one has this share of its occurrences, in hundredths.
SUBSUMED = 50
#: Phrases returned for each language.
TOP = 2000
#: Cells of the word sketch, within these bounds and between them 32 for each document; and of the map of pairs.
CELLS, PAIR_CELLS = (1 << 16, 1 << 22), (1 << 16, 1 << 24)
#: Cells of the sketch that are added up together.
CHUNK = 1 << 14
#: Occurrences of a prefix for each of its chunks.
STRIPE = 100_000
#: Rows and bytes of a text batch, whose stripes are built together.
ROWS, BLOCK = 10_000, 8 << 20
#: A stripe on its way: next words one after the other, each with a blank behind it, and their counts as 64-bit integers.
STRIPES = "lang string, w1 string, w2 string, chunk int, total long, nexts string, counts binary"
#: A merged one.
MERGED = "lang string, w1 string, w2 string, chunk int, total long, nexts array<string>, counts array<long>"
_NAMES = [x.split()[0] for x in STRIPES.split(", ")]
_KEYS = _NAMES[:4]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
#: What a byte is: part of a word, a blank between words, or the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 9]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2


class Block:
    """The words of some texts: ``vocab`` and each word's ``ids`` in it, ``lang`` and whether the next word follows in its piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> None:
        kind = _KIND[raw]
        word = kind == 0
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(raw)]
        begins[firsts] = word[firsts]
        start = np.flatnonzero(begins)
        before = np.append(np.cumsum(word, dtype=np.int32)[start] - 1, word.sum()).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(before), pa.py_buffer(raw[word])])
        coded = words.dictionary_encode()
        self.vocab, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        row = np.searchsorted(offsets, start, "right") - 1
        self.lang = langs[row]
        piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        self.joined = np.zeros(len(start), bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        self.hashes = spans_hash(*_spans(self.vocab))
        self.spaced = pc.binary_join_element_wise(self.vocab, "", " ")


def blocks(batch: pa.RecordBatch, size: int):
    """(Block, languages) of a batch with columns lang, text, some ``size`` bytes each; long texts are cut where a piece
    ends."""
    coded = batch.column(0).dictionary_encode()
    langs, of_row = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    raw, offsets = utf8(batch.column(1))
    raw = _LOWER[raw]
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        part = raw[offsets[i] : offsets[j]]
        if len(part) <= 2 * size:
            yield Block(part, offsets[i : j + 1] - offsets[i], of_row[i:j]), langs
        else:  # one long text
            ends = np.flatnonzero(_KIND[part] == 2)
            ends = ends[np.unique(np.searchsorted(ends, np.arange(size, len(part), size)))[:-1]] if len(ends) else ends
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(part)], strict=True):
                yield Block(part[a:b], np.array([0, b - a]), of_row[i:j]), langs
        i = j


def _cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes >> U64(64 - (cells.bit_length() - 1))).astype(np.int64)


def chunks(codes: np.ndarray, stripe: int) -> np.ndarray:
    """Chunks of the stripes of prefixes with these cells, one for each ``stripe`` occurrences."""
    return 1 + CODED[codes] // stripe


def _table(rows: DataFrame, cells: int) -> np.ndarray:
    """Coded sums of the tasks' tables, rows (task, chunk, counts): a byte for each cell, whatever the input."""

    def add(group: pd.DataFrame) -> np.ndarray:
        total = np.zeros(CHUNK, np.int64)
        for x in group.counts:
            part = np.frombuffer(zlib.decompress(x), np.int64)
            total[: len(part)] += part
        return total

    def some(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [group.chunk.iloc[0]], "counts": [zlib.compress(add(group).tobytes(), 1)]})

    def every(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [group.chunk.iloc[0]], "codes": [code(add(group)).tobytes()]})

    parts = rows.select(F.expr("task div 128").alias("part"), "chunk", "counts").groupBy("part", "chunk").applyInPandas(some, "chunk int, counts binary")
    out = np.zeros(cells, np.uint8)
    for r in parts.groupBy("chunk").applyInPandas(every, "chunk int, codes binary").collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.codes, np.uint8)[: max(0, cells - r.chunk * CHUNK)]
    return out


def _chunked(counts: np.ndarray, task: int):
    parts = [(task, c // CHUNK, zlib.compress(counts[c : c + CHUNK].astype(np.int64).tobytes(), 1)) for c in range(0, len(counts), CHUNK) if counts[c : c + CHUNK].any()]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in parts], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["task", "chunk", "counts"])


def word_sketch(docs: DataFrame, cells: int) -> np.ndarray:
    """The coded counts of all words."""
    size = BLOCK

    def run(batches):
        release()
        counts = np.zeros(cells, np.uint32)
        task = 0
        for b in batches:
            task = b.column(2)[0].as_py() if b.num_rows else task
            for block, langs in blocks(b, size):
                key, many = np.unique(block.lang.astype(np.int64) * len(block.vocab) + block.ids, return_counts=True)
                if len(key):
                    np.add.at(counts, _cell(_word_hashes(block, langs, *np.divmod(key, len(block.vocab))), cells), many.astype(np.uint32))
        yield from _chunked(counts, task)

    return _table(docs.withColumn("_task", F.spark_partition_id()).mapInArrow(run, "task int, chunk int, counts binary"), cells)


def pair_map(pairs: DataFrame, cells: int) -> np.ndarray:
    """Which cells the pairs (lang, w1, w2) fall on."""

    def run(batches):
        release()
        seen = np.zeros(cells, np.uint8)
        task = 0
        for b in batches:
            task = b.column(3)[0].as_py() if b.num_rows else task
            lang, one, two = (spans_hash(*_spans(b.column(k))) for k in range(3))
            seen[_cell(_pair_hash(mix(one ^ lang * U64(BASE)), two), cells)] = 1
        yield from _chunked(seen, task)

    return _table(pairs.select("lang", "w1", "w2", F.spark_partition_id().alias("_task")).mapInArrow(run, "task int, chunk int, counts binary"), cells)


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, at = utf8(column)
    return data, at[:-1], np.diff(at)


def _word_hashes(block: Block, langs: pa.Array, lang: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(block.hashes[ids] ^ (spans_hash(*_spans(langs)) * U64(BASE))[lang])


def _pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """From the first word's hash with its language and the second word's own."""
    return mix(one * U64(BASE) + two)


def _stripes(langs: pa.Array, block: Block, lang: np.ndarray, w1: np.ndarray | None, w2: np.ndarray | None, chunk: np.ndarray, total: np.ndarray, ends: np.ndarray, nexts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A stripe for each lang, w1 and w2; its entries end at ``ends``."""
    m = len(lang)
    none = pa.array([""] * m, pa.string())
    words = block.spaced.take(pa.array(nexts))
    data, at = utf8(words)
    rows = np.concatenate([[0], ends]).astype(np.int64)
    joined = pa.Array.from_buffers(pa.string(), m, [None, pa.py_buffer(at[rows].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    packed = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((8 * rows).astype(np.int32)), pa.py_buffer(counts.astype("<i8"))])
    ones, twos = (none if w is None else block.vocab.take(pa.array(w)) for w in (w1, w2))
    return pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), ones, twos, pa.array(chunk.astype(np.int32)), pa.array(total.astype(np.int64)), joined, packed], _NAMES)


def _striped(prefix: np.ndarray, nexts: np.ndarray, parts: np.ndarray, block: Block) -> tuple[np.ndarray, ...]:
    """(place of a prefix's first entry, chunk, end of entries, next words, counts) of each stripe of the occurrences."""
    v, most = len(block.vocab), int(parts.max(initial=1))
    _, first, inverse = np.unique(prefix, return_index=True, return_inverse=True)
    split = (block.hashes[nexts] % parts.astype(U64)).astype(np.int64) if most > 1 else 0
    stripes, own = np.unique(inverse * most + split, return_inverse=True)
    entry, count = np.unique(own * v + nexts, return_counts=True)
    ends = np.searchsorted(entry // v, np.arange(len(stripes)), "right")
    which, chunk = np.divmod(stripes, most)
    return first[which], chunk, ends, entry % v, count


def stripes(docs: DataFrame, codes: np.ndarray, least: int = LEAST, known: np.ndarray | None = None) -> DataFrame:
    """The stripes of each block of texts: of the empty prefix and of words, or with the map of frequent pairs those of pairs."""
    shared = docs.sparkSession.sparkContext.broadcast((codes, known))
    size, stripe = BLOCK, STRIPE

    def run(batches):
        release()
        codes, known = shared.value
        none, cells = np.zeros(0, np.int64), len(codes)
        for b in batches:
            for block, langs in blocks(b, size):
                if not len(block.ids):
                    continue
                ids, lang, v = block.ids, block.lang.astype(np.int64), len(block.vocab)
                key, first, inverse, total = np.unique(lang * v + ids, return_index=True, return_inverse=True, return_counts=True)
                hashes = _word_hashes(block, langs, lang[first], ids[first])
                cell = codes[_cell(hashes, cells)]
                word = (cell >= least)[inverse]
                pair = np.zeros(len(ids), bool)
                pair[:-1] = block.joined[:-1] & word[:-1] & word[1:]
                if known is None:
                    n = np.bincount(lang, minlength=len(langs))
                    used = np.flatnonzero(n)
                    yield _stripes(langs, block, used, None, None, np.zeros(len(used)), n[used], np.zeros(len(used)), none, none)
                    alone = cell >= least  # words whose total has no stripe of theirs to go with
                    at = np.flatnonzero(pair)
                    prefix, parts = inverse[at], chunks(cell, stripe)[inverse[at]]
                    nexts = ids[at + 1]
                else:
                    at = np.flatnonzero(pair)
                    pair[at] = known[_cell(_pair_hash(hashes[inverse[at]], block.hashes[ids[at + 1]]), len(known))] > 0
                    at = np.flatnonzero(pair[:-1] & pair[1:])
                    prefix, parts = inverse[at] * v + ids[at + 1], np.minimum(*(chunks(cell, stripe)[inverse[at + k]] for k in (0, 1)))
                    nexts = ids[at + 2]
                if len(at):
                    place, chunk, ends, nexts, counts = _striped(prefix, nexts, parts, block)
                    at = at[place]
                    sums = np.zeros(len(at), np.int64)
                    if known is None:
                        own = inverse[at]
                        sums[chunk == 0] = total[own[chunk == 0]]
                        alone[own[chunk == 0]] = False
                    yield _stripes(langs, block, lang[at], ids[at], None if known is None else ids[at + 1], chunk, sums, ends, nexts, counts)
                if known is None:
                    at = first[alone]
                    yield _stripes(langs, block, lang[at], ids[at], None, np.zeros(len(at)), total[alone], np.zeros(len(at)), none, none)

    return docs.mapInArrow(run, STRIPES)


def _entries(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The next words of all stripes one after the other, how many each has, and their counts."""
    raw, at = utf8(rows.column(5))
    blank = raw == 32
    before = np.concatenate([[0], np.cumsum(blank, dtype=np.int32)])
    ends = np.cumsum(~blank, dtype=np.int32)[blank]
    words = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(raw[~blank])])
    packed, _ = utf8(rows.column(6))
    return words, np.diff(before[at]), np.frombuffer(packed.tobytes(), "<i8")


def _elementwise(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """One row for each run of rows with equal keys, its total, and of all entries their stripe, word and count."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for k in range(4):
        c = rows.column(k)
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    of = np.cumsum(new) - 1
    total = np.zeros(int(of[-1]) + 1, np.int64)
    np.add.at(total, of, rows.column(4).to_numpy())
    words, size, counts = _entries(rows)
    coded = words.dictionary_encode()
    v = max(1, len(coded.dictionary))
    entry, inverse = np.unique(np.repeat(of, size) * v + coded.indices.to_numpy(), return_inverse=True)
    sums = np.zeros(len(entry), np.int64)
    np.add.at(sums, inverse, counts)
    return rows.take(pa.array(np.flatnonzero(new))), total, entry // v, coded.dictionary.take(pa.array(entry % v)), sums


def merged(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """The elementwise sum of the stripes of each prefix and chunk, without entries below ``least`` and stripes without
    any entry or total."""

    def run(batches):
        release()
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, _TYPES, strict=True)], _NAMES)
            both = pa.Table.from_batches([held, b] if held else [b]).combine_chunks().to_batches()[0]
            heads, total, of, words, counts = _elementwise(both)
            last = heads.num_rows - 1
            yield frequent(heads, total, of, words, counts, last)
            mine = of == last  # may go on in the next batch
            text = "".join(w + " " for w in words.filter(pa.array(mine)).to_pylist())
            row = heads.slice(last, 1)
            held = pa.RecordBatch.from_arrays([*(row.column(k) for k in range(4)), pa.array(total[last:]), pa.array([text]), pa.array([counts[mine].astype("<i8").tobytes()], pa.binary())], _NAMES)
        if held:
            yield frequent(*_elementwise(held), 1)

    def frequent(heads: pa.RecordBatch, total: np.ndarray, of: np.ndarray, words: pa.Array, counts: np.ndarray, upto: int) -> pa.RecordBatch:
        keep = (counts >= least) & (of < upto)
        rows = np.flatnonzero((total[:upto] > 0) | np.isin(np.arange(upto), of[keep]))
        offsets = pa.array(np.searchsorted(of[keep], np.append(rows, upto)).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, words.filter(pa.array(keep))), pa.ListArray.from_arrays(offsets, pa.array(counts[keep]))
        some = heads.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([*(some.column(k) for k in range(4)), pa.array(total[rows]), *lists], _NAMES)

    return parts.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(run, MERGED)


def scored(a: str, left: str, right: str) -> str:
    """SQL for floor(1000000 a a / (left right)), exact."""
    return f"cast(cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * cast(1000000 as decimal(7,0)) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0))) as long)"


@tidy
def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    n_docs = docs.count()
    sized = lambda bounds, each: min(max(bounds[0], 1 << max(0, each * n_docs - 1).bit_length()), bounds[1])
    small_batches(spark, ROWS)
    codes = word_sketch(docs, sized(CELLS, 32))
    found = written(merged(stripes(docs, codes, least), least))

    totals = written(found.where("w2 = ''").groupBy("lang", "w1").agg(F.sum("total").alias("f")).where(f"f >= {least} or w1 = ''"))
    n = totals.where("w1 = ''").select("lang", F.col("f").alias("n"))  # one row for each language
    opened = lambda df: df.select("lang", "w1", "w2", F.explode(F.arrays_zip("nexts", "counts")).alias("e")).select("lang", "w1", "w2", F.col("e.nexts").alias("next"), F.col("e.counts").alias("a"))
    size = maybe_broadcast(totals)
    first, second = size.select("lang", "w1", F.col("f").alias("f1")), size.select("lang", F.col("w1").alias("w2"), F.col("f").alias("f2"))
    pairs = opened(found).select("lang", "w1", F.col("next").alias("w2"), "a").join(first, ["lang", "w1"]).join(second, ["lang", "w2"])
    pairs = written(pairs.select("lang", "w1", "w2", "a", "f1", "f2"))
    longer = written(merged(stripes(docs, codes, least, pair_map(pairs, sized(PAIR_CELLS, 256))), least))
    known = maybe_broadcast(pairs)
    left = known.select("lang", "w1", "w2", F.col("a").alias("f12"), "f1")
    right = known.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
    triples = opened(longer).select("lang", "w1", "w2", F.col("next").alias("w3"), "a").join(left, ["lang", "w1", "w2"]).join(right, ["lang", "w2", "w3"])
    triples = written(triples.select("lang", "w1", "w2", "w3", "a", "f1", "f12", "f23", "f3"))

    around = triples.select("lang", "w1", "w2", "a").union(triples.select("lang", "w2", "w3", "a"))
    extended = around.groupBy("lang", "w1", "w2").agg(F.max("a").alias("_longer"))
    alone = pairs.join(extended, ["lang", "w1", "w2"], "left").where(f"_longer is null or 100 * _longer < {subsumed} * a")
    twos = alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), F.expr(scored("a", "f1", "f2")).alias("score"))
    cuts = triples.withColumns({"s1": F.expr(scored("a", "f1", "f23")), "s2": F.expr(scored("a", "f12", "f3"))})
    early = F.col("s1") <= F.col("s2")
    threes = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    every = twos.union(threes)
    # the best of each share of a language, then the best of those
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    share = every.withColumn("_share", F.pmod(F.hash("phrase"), F.lit(64)))
    best = share.withColumn("_k", F.row_number().over(W.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_k") <= top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return written(ranked.join(maybe_broadcast(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
