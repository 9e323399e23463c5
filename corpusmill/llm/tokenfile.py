"""Token files with directly addressable codes.

Ids are cut into chunks of 8 bits. Level 0 has the lowest chunk of every id; a bitmap tells which ids go on,
level 1 has the next chunk of those, and so on. A directory counts the set bits before each 512 bits, so token i
is found with one rank a level, without decoding its block. Blocks of whole documents are rows of a Parquet
table, in ascending doc_id order: part (the range of doc_ids), block, start (tokens of the part before it), the
documents' ids and ends, and the levels, bitmaps and directories as binaries.

Null texts are empty; every document ends with the id 0. Null doc_ids come first; rows with the same doc_id stand
side by side, ordered by a hash of their texts. An empty table gives an empty file and no rows; further columns are
not read. A very long document is encoded in parts, but is one row of its block.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, shared_folder, small_batches
from .pretokens import PieceCache, classes, documents_ids

END_ID = 0
#: A block is closed when it has so many tokens; a longer document makes a longer block.
BLOCK_TOKENS = 1 << 17
#: Bits counted by one entry of a rank directory.
RANK_BITS = 512
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
SCHEMA = "part int, block int, start long, n_tokens long, doc_ids array<long>, doc_ends array<long>, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


def to_codes(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 255).astype(np.uint8).tobytes())
        rest = rest >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(_BITS[bits], np.arange(0, len(bits), RANK_BITS // 8), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        bitmaps.append(bits.tobytes())
        ranks.append((np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes())
        if not more.any():
            return levels, bitmaps, ranks
        rest = rest[more]


def from_codes(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a block."""
    below = None
    for level, bits in zip(reversed(levels), reversed(bitmaps), strict=True):
        ids = np.frombuffer(level, np.uint8).astype(np.uint32)
        if below is not None:
            more = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(ids), bitorder="little").astype(bool)
            ids[more] |= below << 8
        below = ids
    return below if below is not None else np.zeros(0, np.uint32)


def token_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """Token i of a block, by one rank a level."""
    value = 0
    for k, (level, bits, rank) in enumerate(zip(levels, bitmaps, ranks, strict=True)):
        value |= level[i] << 8 * k
        if not bits[i >> 3] >> (i & 7) & 1:
            break
        group = i // RANK_BITS
        before = int.from_bytes(rank[4 * group : 4 * group + 4], "little")
        before += int(_BITS[np.frombuffer(bits[group * RANK_BITS // 8 : i >> 3], np.uint8)].sum())
        i = before + bin(bits[i >> 3] & (1 << (i & 7)) - 1).count("1")
    return value


def _tokenizer(json: str):
    """The special tokens' strings in a text are ordinary text, as the tokenizers' description has it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(json)
    t.encode_special_tokens = True
    return t


@functools.cache
def _kinds(json: str) -> np.ndarray:
    """The classes of characters, as the tokenizer's own splitting has them."""
    split = _tokenizer(json).pre_tokenizer.pre_tokenize_str

    def joins(first: str, others: list[str]) -> list[bool]:
        ends = {end for _, (_, end) in split("".join(first + x + "\n" for x in others))}
        return [3 * i + 1 not in ends for i in range(len(others))]

    return classes(joins)


def _cache(shared: tuple) -> PieceCache:
    """A worker's tokenizer and the pieces it has seen; they stay for its later tasks."""
    json, kinds = shared

    def make() -> PieceCache:
        t = _tokenizer(json)
        return PieceCache(lambda words: [e.ids for e in t.encode_batch_fast(words, add_special_tokens=False)], kinds)

    return kept(("token file", hashlib.md5(json.encode()).hexdigest()), make)


def write(df: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> None:
    """Encodes the texts with a byte-level BPE tokenizer of the tokenizers library and writes a token file."""
    spark = df.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        json = f.read()
    shared = spark.sparkContext.broadcast((json, _kinds(json)))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_tie"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie").withColumn("part", F.spark_partition_id())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.binary())]

    def run(batches):
        cache = _cache(shared.value)
        part = block = start = n = 0
        docs: list = []
        ends: list[int] = []
        held: list[np.ndarray] = []

        def close():
            row = (part, block, start, n, docs, ends, *to_codes(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for b in batches:
            ids_of = b.column(0).to_pylist()
            part = b.column(2)[0].as_py() if b.num_rows else part
            for row, ids, done in documents_ids(b.column(1).to_pylist(), cache):
                held.append(ids)
                n += len(ids)
                if done:
                    held.append(np.array([END_ID], np.uint32))
                    n += 1
                    docs.append(ids_of[row])
                    ends.append(n)
                    if n >= BLOCK_TOKENS:
                        yield close()
                        block, start, n, docs, ends, held = block + 1, start + n, 0, [], [], []
        if docs:
            yield close()

    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with first_token, the number of the file's tokens before each."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    # one row for each part: as many as the writer had tasks
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    base = parts.select("part", (F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    return blocks.join(F.broadcast(base), "part").withColumn("first_token", F.col("_base") + F.col("start")).drop("_base")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of each document."""
    small_batches(spark, 16)

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for x in b.to_pylist():
                ids = from_codes(x["levels"], x["bitmaps"]).astype("<u4")
                a = 0
                for doc, e in zip(x["doc_ids"], x["doc_ends"], strict=True):
                    out.append((doc, x["first_token"] + a, e - a, zlib.crc32(ids[a:e].tobytes())))
                    a = e
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_blocks(spark, path).select("first_token", "doc_ids", "doc_ends", "levels", "bitmaps").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(positions: DataFrame, path: str, position: str = "position") -> DataFrame:
    """Adds ``token`` to rows with the number of a token in the file, without decoding whole blocks.

    Positions outside the file, and null ones, are left out.
    """
    spark = positions.sparkSession
    small_batches(spark, 64)
    step = F.lit(BLOCK_TOKENS)
    blocks = read_blocks(spark, path).select("first_token", F.col("n_tokens").alias("_n"), "levels", "bitmaps", "ranks")
    blocks = blocks.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("first_token") / step), F.floor((F.col("first_token") + F.col("_n") - 1) / step))))
    wanted = positions.withColumn("_cell", F.floor(F.col(position) / step)).groupBy("_cell").agg(F.collect_list(position).alias("_at"))
    both = wanted.join(blocks, "_cell").select("_at", "first_token", "_n", "levels", "bitmaps", "ranks")

    def run(batches):
        for b in batches:
            out = [(p, token_at(x["levels"], x["bitmaps"], x["ranks"], p - x["first_token"])) for x in b.to_pylist() for p in x["_at"] if 0 <= p - x["first_token"] < x["_n"]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], [position, "token"])

    return both.mapInArrow(run, f"{position} long, token long")


def write_and_read(df: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    path = path or shared_folder(df.sparkSession)
    write(df, path, tokenizer_path)
    return read_documents(df.sparkSession, path)
