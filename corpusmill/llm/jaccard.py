"""Exact Jaccard join of word-shingle sets, as components of linked documents.

Documents with equal sets are one node. Sets are named by a 64-bit hash; names that a second hash shows to
stand for different sets are given anew, so that 128 bits tell sets apart. A node goes by its smallest doc_id, as ids that
lie close together take few bytes in a shuffle, or by its set's name where rows of one doc_id have different sets. The shingles have one global order: by frequency rank (from a count
sketch over all documents), then by hash. A node's prefix is as long as needed so that two sets of the asked
similarity must share, inside their prefixes, one shingle of the rare level or k shingles of one class of a
frequent level; rare shingles are indexed alone, those of frequent classes as combinations of k. Of small sets, a shingle
that more than ``HOT`` documents have is indexed together with each of the prefix's next ones, one more included: similar
sets share two shingles of prefixes that are longer by one, so that texts with one frequent shingle do not all meet.
Candidates are then verified on the whole sets.

Why nothing is lost: let x and y share at least ``least(x)`` shingles, and x's prefix end first in the order. At most
e = |x| - least(x) of its shingles are missing in y, and y's prefix holds all shingles of y that x's prefix holds.
The prefix is extended until the sum over its classes of max(0, shingles - k + 1) exceeds e, so some class has k
shared ones. The classes of frequent levels are ranges of hashes whose number follows the set size; a set takes
part with the ranges of every size that a similar set can have.

Only links that tell components apart are verified: first each index entry against one centre, then those in
different components against fresh centres as long as that settles something, at last the pairs of one entry that are
still in different components. Whole sets are only shuffled for pairs that parity bitmaps of a bit or two for each shingle
leave in doubt. An entry drops the nodes that can be similar to none of its others: too few of their
shingles are left behind the entry's place in the order for any size that the entry has. A pair is not verified if
its sizes or places forbid a link, if the distances to a common pivot differ by more than similar sets' can, or if
parity bitmaps differ in more bits than similar sets have shingles of their own. Entries of the same centre are folded into one, and entries with the same
nodes are met once. Hot entries are salted by the sketched frequency, and where pairs of one entry are left at last, by
its size: each share of its nodes meets the others in a task of its own.

Null and empty texts have no shingles and their own component; null doc_ids are never linked and get a null
component; rows that repeat a doc_id share its fate. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import CODED, U64, blocks, code, mix, shingle_sets, utf8
from .common import BROADCAST_BYTES, maybe_broadcast, release, size_in_bytes, small_batches, tidy, written
from .components import components

WIDTH = 5
#: Similarity in hundredths.
SIMILARITY = 80
#: Cells of the count sketch, within these bounds; between them up to 16 for each document.
CELLS = (1 << 18, 1 << 23)
#: Frequencies are ranked in half octaves above the mean of all cells; from these ranks on a shingle is of level k.
LEVELS = {2: 6, 3: 12}
#: Sets that may be similar to one of fewer shingles use single shingles only.
SMALL = 32
#: Documents of a shingle that a small set does not index alone.
HOT = 1000
#: Rows of an index entry that share one salt, and nodes of an entry whose pairs meet in one task.
SALT_ROWS, MEETING = 20_000, 2_000
#: Ratio of the sizes that fall into one class of an entry.
STEP = 1.02
CHUNK = 1 << 14
#: 64-bit words of a set's parity bitmap in the join of an entry's pairs; before whole sets are met, bitmaps with a bit for
#: each shingle or more are.
WORDS = 8
#: Text that a worker hashes at once.
BYTES = 1 << 20


def least_common(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n must share with any similar one."""
    return (SIMILARITY * n + 99) // 100


def _sets(batch: pa.RecordBatch):
    """(first row, shingles, offsets) of parts of a batch with columns doc_id, text."""
    raw, offsets = utf8(batch.column(1))
    for i, j in blocks(offsets, BYTES):
        yield i, *shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], WIDTH)


def _sums(sets: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
    sums = np.zeros(len(sets) + 1, U64)
    np.cumsum(mix(sets ^ U64(seed)), out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U64)).view(np.int64)


def _names(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    return _sums(sets, at, 0x5851F42D4C957F2D)


def _twins(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Another one."""
    return _sums(sets, at, 0x14057B7EF767814F)


#: The names that different sets share, by their second hash, and what they are called instead.
Anew = dict[tuple[int, int], int]


def _nodes(sets: np.ndarray, at: np.ndarray, anew: Anew) -> np.ndarray:
    """The name of each set."""
    names = _names(sets, at)
    if anew:
        again = np.flatnonzero(np.isin(names, np.fromiter({k for k, _ in anew}, np.int64)))
        if len(again):
            twins = _twins(sets, at)
            names = names.copy()
            for i in again.tolist():
                names[i] = anew[int(names[i]), int(twins[i])]
    return names


def clashes(profiled: DataFrame) -> Anew:
    """Names of several sets: among n sets some n * n / 2**65, so a handful even of 1e10."""
    twice = profiled.where("node is not null").groupBy("node").agg(F.min("twin").alias("_lo"), F.max("twin").alias("_hi")).where("_lo <> _hi").select("node")
    if twice.isEmpty():
        return {}
    rows = profiled.join(twice, "node").select("node", "twin").distinct().collect()
    return {(r.node, r.twin): int(mix(np.array([r.node ^ (r.twin << 1 & (1 << 63) - 1)], np.int64).view(U64) + U64(1)).view(np.int64)[0]) for r in rows}


def _cells(sets: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    bits = U64(cells.bit_length() - 1)
    return (sets >> (U64(64) - bits)).astype(np.int64), (mix(sets) >> (U64(64) - bits)).astype(np.int64)


def squeezed(counts: np.ndarray) -> bytes:
    """A chunk of counts in as few bytes each as the largest needs, which go first, compressed by their frequencies only."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    coder = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY if kind.itemsize == 1 else zlib.Z_DEFAULT_STRATEGY)
    return bytes([kind.itemsize]) + coder.compress(counts.astype(kind).tobytes()) + coder.flush()


def unsqueezed(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x[1:]), f"<u{x[0]}").astype(np.int64)


def profile(docs: DataFrame, cells: int) -> DataFrame:
    """Rows (doc_id, n, node, twin) of the documents, and rows (task, chunk, counts) of the tasks' count sketches."""
    schema = "doc_id long, n int, node long, twin long, task int, chunk int, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        release()
        counts = np.zeros(2 * cells, np.uint32)
        task = 0
        for b in batches:
            task = b.column(2)[0].as_py() if b.num_rows else task
            for i, sets, at in _sets(b):
                for k, cell in enumerate(_cells(sets, cells)):
                    np.add.at(counts, cell + k * cells, np.uint32(1))
                m = len(at) - 1
                none = pa.nulls(m, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, m), pa.array(np.diff(at), pa.int32()), pa.array(_names(sets, at)), pa.array(_twins(sets, at)), none, none, pa.nulls(m, pa.binary())], names)
        used = [c for c in range(0, 2 * cells, CHUNK) if counts[c : c + CHUNK].any()]
        if used:
            rows = [(None, None, None, None, task, c // CHUNK, squeezed(counts[c : c + CHUNK])) for c in used]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names)

    return docs.withColumn("_task", F.spark_partition_id()).mapInArrow(run, schema)


def sketch(profiled: DataFrame, cells: int) -> tuple[np.ndarray, float]:
    """The sum of all tasks' sketches as a code for each cell, and the mean of the first row of cells; tasks are added up in
    groups of 128 first. The driver gets a byte for each cell."""

    def total(group: pd.DataFrame) -> np.ndarray:
        out = np.zeros(CHUNK, np.int64)
        for x in group.counts:
            out += unsqueezed(x)
        return out

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [group.chunk.iloc[0]], "counts": [squeezed(total(group))]})

    def last(group: pd.DataFrame) -> pd.DataFrame:
        sums = total(group)
        return pd.DataFrame({"chunk": [group.chunk.iloc[0]], "codes": [code(sums).tobytes()], "n": [int(sums.sum())]})

    parts = profiled.where("counts is not null").select(F.expr("task div 128").alias("part"), "chunk", "counts")
    once = parts.groupBy("part", "chunk").applyInPandas(add, "chunk int, counts binary")
    codes, n = np.zeros(2 * cells, np.uint8), 0
    for r in once.groupBy("chunk").applyInPandas(last, "chunk int, codes binary, n long").collect():
        codes[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.codes, np.uint8)
        n += r.n if r.chunk * CHUNK < cells else 0
    return codes, n / cells


def _long_prefix(one: np.ndarray, level: np.ndarray, count: np.ndarray, band: int) -> list[tuple[int, int, int]]:
    """(signature, frequency, most) of one set for one band of sizes; ``one`` is in the global order."""
    e = len(one) - int(least_common(np.int64(len(one))))
    ranges = {2: max(1, 3 * (1 << band) // 8), 3: max(1, (1 << band) // 8)}
    got: dict[tuple[int, int], list[int]] = {}
    have, out, frequent = 0, [], int((level > 1).sum())
    for i, (h, k) in enumerate(zip(one.tolist(), level.tolist(), strict=True)):
        if have > e:
            break
        c = (1, 0) if k == 1 else (k, h * ranges[k] >> 64)
        got.setdefault(c, []).append(i)
        have += k == 1 or len(got[c]) >= k
    for (k, place), members in got.items():
        for combination in itertools.combinations(members, k):
            if k == 1:
                sig = int(one[combination[0]])
            else:
                sig = band * 64 + k
                for i in combination:
                    sig = (sig * 0x5851F42D4C957F2D + int(one[i])) % (1 << 64)
            out.append((sig, min(int(count[i]) for i in combination), len(one) - combination[0] if k == 1 else frequent))
    return out


def _small_prefix(one: np.ndarray, count: np.ndarray, need: int, hot: int) -> list[tuple[int, int, int]]:
    """(signature, frequency, most) of one small set in the global order: shingles of its prefix, frequent ones with each
    of those behind them, up to one beyond the prefix."""
    alone = mix(one[: need + 1] + U64(1))
    out = []
    for p in range(need):
        if count[p] <= hot:
            out.append((int(alone[p]), int(count[p]), len(one) - p))
        else:
            both = mix(alone[p] * U64(0x5851F42D4C957F2D) + alone[p + 1 :])
            out += ((int(h), int(min(count[p], c)), len(one) - p) for h, c in zip(both, count[p + 1 : need + 1], strict=True))
    return out


def packed(n: np.ndarray, most: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An entry's n, most and salts in one number, ``most`` in 255ths of n rounded up; n apart where it takes over 16 bits.

    From the lowest byte on, what is the same in most entries comes first, so that the rest lies beside the signature.
    """
    large = np.where(n < 1 << 16, 0, n)
    head = np.where(large > 0, 0, n).astype(U64) << U64(48) | (-(-255 * most // n)).astype(U64) << U64(40) | salts.astype(U64)
    return head.view(np.int64), large.astype(np.int32)


#: SQL for the salts in ``packed``.
SALTS = f"int(head & {(1 << 40) - 1})"


def unpacked(entries: DataFrame) -> DataFrame:
    """The entries with n, most (not less than it was) and salts instead of head and large."""
    n = F.when(F.col("large") > 0, F.col("large")).otherwise(F.shiftrightunsigned("head", 48).cast("int"))
    out = entries.withColumns({"n": n, "salts": F.expr(SALTS)})
    return out.withColumn("most", F.expr("int((shiftrightunsigned(head, 40) & 255) * n div 255)")).drop("head", "large")


def signatures(docs: DataFrame, codes: np.ndarray, mean: float, cells: int, names: Callable[..., np.ndarray]) -> DataFrame:
    """Index entries (head, sig, node, large) of the documents' sets, see ``unpacked``; ``names`` gives the nodes.

    ``most`` bounds the overlap with a set whose first common shingle is that of the entry: the shingles from it on.
    For combinations, the frequent shingles: sets that share a rare one in their prefixes meet in its entry too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    mean, hot = max(1.0, mean), HOT
    schema = "head long, sig long, node long, large int"

    def run(batches):
        release()
        codes = shared.value
        for b in batches:
            for row, sets, at in _sets(b):
                if not len(sets):
                    continue
                n, nodes = np.diff(at), names(b, row, sets, at)
                first, second = _cells(sets, cells)
                count = CODED[np.minimum(codes[:cells][first], codes[cells:][second])]
                rank = np.minimum(2 * np.log2(count / mean + 1), 31).astype(np.uint8)
                level = np.ones(len(sets), np.int8)
                for k, r in LEVELS.items():
                    level[rank >= r] = k
                key = rank.astype(U64) << U64(58) | sets >> U64(6)
                rare = np.zeros(len(sets) + 1, np.int64)
                np.cumsum(level == 1, out=rare[1:])
                need = n - least_common(n) + 1
                alone = rare[at[1:]] - rare[at[:-1]] >= need  # rare shingles fill the prefix
                sigs, salts, who, most = [], [], [], []
                for r, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if i == j:
                        continue
                    order = i + np.argsort(key[i:j], kind="stable")
                    first = order[: need[r]]
                    if small := SIMILARITY * n[r] < 100 * SMALL:  # shingles of any level, apart from the others
                        if (count[first] > hot).any():
                            found = _small_prefix(sets[order], count[order], int(need[r]), hot)
                            sigs.append(np.fromiter((x[0] for x in found), U64, len(found)))
                            salts.append(np.fromiter((x[1] for x in found), np.int64, len(found)))
                            who.append(np.full(len(found), r))
                            most.append(np.fromiter((x[2] for x in found), np.int64, len(found)))
                        else:
                            sigs.append(mix(sets[first] + U64(1)))
                    elif alone[r]:
                        sigs.append(sets[first])
                    if len(sigs) > len(salts):
                        salts.append(count[first])
                        who.append(np.full(len(first), r))
                        most.append(n[r] - np.arange(len(first)))
                    if n[r] >= SMALL and (small or not alone[r]):
                        bands = range(max(SMALL, math.ceil(0.8 * n[r])).bit_length() - 1, int(1.25 * n[r]).bit_length())
                        found = {s for band in bands for s in _long_prefix(sets[order], level[order], count[order], band)}
                        sigs.append(np.fromiter((x[0] for x in found), U64, len(found)))
                        salts.append(np.fromiter((x[1] for x in found), np.int64, len(found)))
                        who.append(np.full(len(found), r))
                        most.append(np.fromiter((x[2] for x in found), np.int64, len(found)))
                who = np.concatenate(who)
                head, large = packed(n[who], np.concatenate(most), 1 + np.concatenate(salts) // SALT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(np.concatenate(sigs).view(np.int64)), pa.array(nodes[who]), pa.array(large)], ["head", "sig", "node", "large"])

    return docs.mapInArrow(run, schema)


def bitmap(one: np.ndarray) -> bytes:
    """A parity bitmap of one set as in ``parities``, of as many bits as the next power of two, 64 * WORDS at least."""
    bits = max(64 * WORDS, 1 << max(0, len(one) - 1).bit_length())
    spot = (mix(one ^ U64(0x2545F4914F6CDD1D)) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(spot, minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Shingles that are in one of two sets only, at least: the larger bitmap is folded to the size of the other."""
    p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def beside(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], *columns: str) -> DataFrame:
    """The pairs (a, b), a written table, with these columns of both nodes; ``sets`` gives them for the nodes asked for."""
    hint = maybe_broadcast(pairs)
    left, right = (sets(pairs.select(F.col(c).alias("node"))).select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in columns)) for c in "ab")
    # only the sets that pairs need are shuffled
    return left.join(hint, "a").join(right.join(hint, "b"), ["a", "b"]).select("a", "b", *(f"{x}_{c}" for x in columns for c in "ab"))


def measured(pairs: DataFrame, sets: DataFrame, whole: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The pairs (a, b) with bounds of their Jaccard distance (least, most), and whether they are linked.

    Pairs that their bitmaps forbid to be linked stop there; the others are measured on the whole sets, which ``whole``
    gives for the nodes asked for, or else are a column of ``sets``.
    """

    def bound(batches):
        release()
        for b in batches:
            apart = np.array([least_apart(x, y) for x, y in zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist(), strict=True)], np.int64)
            both = b.column("m_a").to_numpy().astype(np.int64) + b.column("m_b").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(2 * apart / (both + apart), pa.float64()), pa.array((100 + SIMILARITY) * apart <= (100 - SIMILARITY) * both)], ["a", "b", "least", "open"])

    def run(batches):
        release()
        for b in batches:
            out = []
            for x, y, p, q in zip(*(b.column(c).to_pylist() for c in ("a", "b", "shingles_a", "shingles_b")), strict=True):
                p, q = np.frombuffer(p, U64), np.frombuffer(q, U64)
                at = np.minimum(np.searchsorted(p, q), len(p) - 1)
                common = int((p[at] == q).sum())
                both = len(p) + len(q) - common
                out.append((x, y, 1 - common / both, 1 - common / both, 100 * common >= SIMILARITY * both))
            yield pa.RecordBatch.from_arrays([pa.array([z[k] for z in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))], ["a", "b", "least", "most", "linked"])

    bounded = written(beside(written(pairs), lambda _: sets, "bits", "m").mapInArrow(bound, "a long, b long, least double, open boolean"))
    exact = beside(bounded.where("open").select("a", "b"), whole or (lambda _: sets), "shingles").mapInArrow(run, "a long, b long, least double, most double, linked boolean")
    return exact.union(bounded.where("not open").select("a", "b", "least", F.lit(1.0).alias("most"), F.lit(False).alias("linked")))


def possible(n: str, m: str, most: str, most_m: str) -> str:
    """SQL for whether sizes and overlap bounds of two nodes in one entry admit a link."""
    return f"100 * least({n}, {m}) >= {SIMILARITY} * greatest({n}, {m}) and {100 + SIMILARITY} * least({most}, {most_m}) >= {SIMILARITY} * ({n} + {m})"


def parities(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words for each set: each bit tells whether an odd number of the shingles falls on it.

    Bitmaps of two sets differ in at most as many bits as there are shingles in one of them only.
    """
    bits, m = 64 * WORDS, len(at) - 1
    spot = np.repeat(np.arange(m), np.diff(at)) * bits + (mix(sets ^ U64(0x2545F4914F6CDD1D)) % U64(bits)).astype(np.int64)
    odd = (np.bincount(spot, minlength=m * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(m, WORDS)


def merged(rest: DataFrame) -> DataFrame:
    """One entry for all those that have the same nodes, with the largest ``most`` of each node."""
    names = rest.groupBy("sig").agg(F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("_y"), F.count("*").alias("_m"))
    stands = names.withColumn("_keep", F.min("sig").over(W.partitionBy("_x", "_y", "_m"))).where("sig = _keep").select("sig", "_x", "_y", "_m")
    to = names.join(stands.withColumnRenamed("sig", "_to"), ["_x", "_y", "_m"]).select("sig", "_to")
    return rest.join(to, "sig").groupBy(F.col("_to").alias("sig"), "node").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.max("most").alias("most"))


def folded(shared: DataFrame) -> DataFrame:
    """(sig, node, n, most): the entries of one centre as one, named by it, unless that makes more pairs.

    Copies meet in many entries with nearly the same nodes; folded, each of them is one row. Salted entries stay, as
    their nodes belong together under any centre.
    """
    near = written(shared.where("salts = 1").groupBy("centre", "node").agg(F.first("n").alias("n"), F.max("most").alias("most"), F.sum("size").alias("_pairs")))
    sizes = near.groupBy("centre").agg(F.count("*").alias("_nodes"), F.sum("_pairs").alias("_pairs"))
    apart = written(sizes.where(F.col("_nodes").cast("double") * F.col("_nodes") > F.col("_pairs")).select("centre"))
    one = near.join(apart, "centre", "left_anti").select(F.col("centre").alias("sig"), "node", "n", "most")
    rest = shared.where("salts = 1").join(apart, "centre", "left_semi").union(shared.where("salts > 1").select("centre", *(c for c in shared.columns if c != "centre")))
    return one.union(rest.select("sig", "node", "n", "most"))


def nearest(entries: DataFrame) -> DataFrame:
    """One pair (a, b) for each node: with the centre that it shares most entries with."""
    shared = entries.groupBy("node", "centre").agg(F.count("*").alias("_n"))
    best = shared.groupBy("node").agg(F.max(F.struct(F.col("_n"), F.col("centre"))).alias("_best"))
    return best.select(F.col("_best.centre").alias("a"), F.col("node").alias("b"))


def size_class(n: Column) -> Column:
    return F.floor(F.ln(n) / F.ln(F.lit(STEP))).cast("int")


def hopeful(classes: Column) -> Column:
    """Whether a node (n, most) can be similar to a set of one of the size classes, its own included."""
    low = size_class(F.col("n") * SIMILARITY / 100 * (1 - 1e-9))
    high = F.least(F.col("n") * 100 / SIMILARITY, F.col("most") * (100 + SIMILARITY) / SIMILARITY - F.col("n"))
    high = F.when(high > 0, size_class(high * (1 + 1e-9))).otherwise(F.lit(-1))
    return F.exists(classes, lambda c: (c >= low) & (c <= high))


def unsettled(active: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """The entries with nodes of more than one component: sig, node, n, most, component, and a centre drawn anew in each
    turn with its component (own)."""
    held = written(active.select("sig", "node", "n", "most").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    drawn = F.min_by(F.struct(F.col("node").alias("centre"), F.col("component").alias("own"), F.col("n").alias("n_centre"), F.col("most").alias("most_centre")), F.xxhash64(F.col("node"), F.lit(turn), F.col("sig")))
    mixed = held.groupBy("sig").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), drawn.alias("_c"), F.collect_set(size_class(F.col("n"))).alias("_classes")).where("_lo <> _hi").select(F.col("sig").alias("_sig"), "_c.*", "_classes")
    mixed = written(mixed)
    live = held.join(mixed, (F.col("sig") == F.col("_sig")) & hopeful(F.col("_classes"))).drop("_sig", "_classes")
    return written(live)


def split(rest: DataFrame) -> DataFrame:
    """``rest`` without the entries that have nodes of one component only."""
    mixed = rest.groupBy("sig").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select(F.col("sig").alias("_sig"))
    return written(rest.join(written(mixed), F.col("sig") == F.col("_sig"), "left_semi"))


@tidy
def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cells = min(max(CELLS[0], 1 << max(0, 16 * docs.count() - 1).bit_length()), CELLS[1])
    profiled = written(profile(docs, cells))
    codes, mean = sketch(profiled, cells)
    anew = clashes(profiled)
    docs_nodes = profiled.where("node is not null").select("doc_id", "n", "node", "twin")
    if anew:
        again = spark.createDataFrame([(a, b, to) for (a, b), to in anew.items()], "node long, twin long, _to long")
        docs_nodes = docs_nodes.join(F.broadcast(again), ["node", "twin"], "left").withColumn("node", F.coalesce("_to", "node"))
    docs_nodes = docs_nodes.select("doc_id", "n", "node")
    by_doc = docs_nodes.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo <> _hi").isEmpty()
    if by_doc:
        stands = written(docs_nodes.groupBy("node").agg(F.min("doc_id").alias("_stand")))
        docs_nodes = written(docs_nodes.join(stands, "node").select("doc_id", "n", F.col("_stand").alias("node")))

    def names(batch: pa.RecordBatch, row: int, sets: np.ndarray, at: np.ndarray) -> np.ndarray:
        return batch.column(0).slice(row, len(at) - 1).to_numpy() if by_doc else _nodes(sets, at, anew)

    docs = docs.where("doc_id is not null")
    entries = signatures(docs, codes, mean, cells, names)
    if by_doc:  # one document of each set has entries; its copies' go before they are shuffled, or those of shared ones after
        copies = written(docs_nodes.where("doc_id <> node").select(F.col("doc_id").alias("node")).distinct())
        few = size_in_bytes(copies) <= BROADCAST_BYTES
        entries = entries.join(F.broadcast(copies), "node", "left_anti") if few else entries
    entries = entries.select("head", "sig", "node", "large", F.pmod("node", F.expr(SALTS)).alias("salt")).repartition("sig", "salt").dropDuplicates(["sig", "salt", "node"])
    if by_doc and not few:
        met = unpacked(entries).withColumn("size", F.count("*").over(W.partitionBy("sig", "salt"))).where("size > 1 or salts > 1").drop("size")
        entries = written(met).join(copies, "node", "left_anti")
    else:
        entries = unpacked(entries)
    one = W.partitionBy("sig", "salt")
    shared = entries.withColumn("size", F.count("*").over(one)).where("size > 1 or salts > 1")
    # a salted entry's nodes may have their like under another salt
    shared = shared.withColumn("classes", F.collect_set(size_class(F.col("n"))).over(one)).where((F.col("salts") > 1) | hopeful(F.col("classes"))).drop("classes")
    shared = shared.withColumn("size", F.count("*").over(one)).where("size > 1 or salts > 1")
    # the node with the smallest share of rare shingles is an entry's centre: of copies, the text that they come from
    shared = written(shared.withColumn("_c", F.max(F.struct((F.col("most") / F.col("n")).alias("share"), "node", "n", "most")).over(one)).select("sig", "salts", "size", "node", "n", "most", F.col("_c.node").alias("centre"), F.col("_c.n").alias("n_centre"), F.col("_c.most").alias("most_centre")))
    first = written(nearest(shared.where(f"node <> centre and {possible('n', 'n_centre', 'most', 'most_centre')}")))
    salted = shared.where("salts > 1").select("sig", "centre").distinct()
    bridges = salted.withColumn("a", F.min("centre").over(W.partitionBy("sig"))).where("a <> centre").select("a", F.col("centre").alias("b"))
    active = written(folded(shared))

    # what tells the sets of nodes in shared entries apart, from one text each
    nodes = written(active.select("node").distinct())
    n_nodes = nodes.count()
    chosen = written(docs_nodes.join(maybe_broadcast(nodes), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    # several rows of one doc_id may bring a set twice
    repeated = docs_nodes.join(maybe_broadcast(chosen.select("doc_id")), "doc_id", "left_semi").count() > n_nodes

    def from_texts(doc_ids: DataFrame, columns: Callable[[np.ndarray, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
        """These columns of the sets of the chosen documents, and their nodes."""

        def make(batches):
            release()
            for b in batches:
                for row, sets, at in _sets(b):
                    if len(at) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(names(b, row, sets, at)), *columns(sets, at)], titles)

        titles = ["node", *(x.split()[0] for x in schema.split(", "))]
        made = docs.join(maybe_broadcast(doc_ids), "doc_id", "left_semi").mapInArrow(make, f"node long, {schema}")
        return made.dropDuplicates(["node"]) if repeated else made

    def marks(sets: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        words = parities(sets, at)
        return [pa.array([bitmap(sets[i:j]) for i, j in itertools.pairwise(at.tolist())], pa.binary()), pa.array(np.diff(at), pa.int32()), *(pa.array(words[:, k].copy()) for k in range(WORDS))]

    def shingles(sets: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        return [pa.array([sets[i:j].tobytes() for i, j in itertools.pairwise(at.tolist())], pa.binary())]

    def whole(asked: DataFrame) -> DataFrame:
        """The whole sets of these nodes: made anew each time, as few of all nodes need them and they take more than the texts."""
        return from_texts(written(chosen.join(maybe_broadcast(written(asked.distinct())), "node", "left_semi").select("doc_id")), shingles, "shingles binary")

    odd = [f"odd{k}" for k in range(WORDS)]
    sets = written(from_texts(chosen.select("doc_id"), marks, f"bits binary, m int, {', '.join(f'{o} long' for o in odd)}"))

    # each node against the centre that it shares most entries with; the centres of a salted entry against its first
    first = written(measured(first, sets, whole))
    links = written(first.union(measured(bridges.distinct(), sets, whole)).where("linked").select("a", "b"))
    labels = components(links)
    # bounds of each node's distance to one pivot, which tell many pairs apart by the triangle inequality
    pivots = first.select(F.col("b").alias("node"), F.col("a").alias("pivot"), F.col("least").alias("off"), F.col("most").alias("far"))
    turn, last = 0, False
    while not last:
        turn += 1
        rest = split(unsettled(active, labels, turn))
        if rest.isEmpty():
            break
        active = rest.select("sig", "node", "n", "most")
        n_nodes = rest.select("node").distinct().count()
        near = nearest(rest.where(f"own <> component and {possible('n', 'n_centre', 'most', 'most_centre')}"))
        more = written(measured(near, sets, whole).where("linked").select("a", "b"))
        # another round of centres only pays as long as it settles a fair share of the nodes
        last = turn > 1 and 20 * more.count() < n_nodes
        if last:  # all that is left between components
            rest = merged(rest).join(pivots, "node", "left").withColumns({"pivot": F.coalesce("pivot", "node"), "off": F.coalesce("off", F.lit(0.0)), "far": F.coalesce("far", F.lit(0.0))})
            rest = written(rest.join(sets.select("node", *odd), "node"))
            large = written(rest.groupBy("sig").agg(F.count("*").alias("_m")).where(F.col("_m") > MEETING).select("sig", F.ceil(F.col("_m") / MEETING).cast("int").alias("_shares")))
            rest = rest.join(maybe_broadcast(large), "sig", "left").withColumn("_shares", F.coalesce("_shares", F.lit(1)))
            x, y = (rest.select("sig", "_shares", F.col("node").alias(c), *(F.col(v).alias(f"{v}_{c}") for v in ("component", "n", "most", "pivot", "off", "far", *odd))) for c in "ab")
            x = x.withColumn("_share", F.pmod(F.xxhash64("a"), "_shares").cast("int")).drop("_shares")
            y = y.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
            near = f"component_a <> component_b and a < b and {possible('n_a', 'n_b', 'most_a', 'most_b')}"
            near += f" and (pivot_a <> pivot_b or greatest(off_a - far_b, off_b - far_a) <= {(100 - SIMILARITY) / 100} + 1e-9)"
            near += f" and {100 + SIMILARITY} * ({' + '.join(f'bit_count({o}_a ^ {o}_b)' for o in odd)}) <= {100 - SIMILARITY} * (n_a + n_b)"
            more = more.union(written(measured(x.join(y, ["sig", "_share"]).where(near).select("a", "b").distinct(), sets, whole).where("linked").select("a", "b")))
        if not more.isEmpty():
            links = written(links.union(more))
            labels = components(links)

    named = docs_nodes.join(labels, "node", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component"))
    named = written(named)
    # written, so that both sides of the join are plain shuffles and a large component can be split
    first = written(named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    joined = named.join(first, "component", "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
