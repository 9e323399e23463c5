"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n tokens is cut into n // most pieces of ``most`` tokens and, for what is left, one piece for each set bit
of its length, longest first. Every piece is a sequence of its own. Sequences of equal length are one bucket: a folder
``length=...`` of a Parquet table, from which batches of one shape are read. sequence_ids number the sequences of the
longest bucket first, then the next one's, without gaps.

Null texts are empty; a document always has its end id, so an empty one is a sequence of one token. Null doc_ids and
rows that repeat a doc_id are documents like others. An empty table gives an empty table; further columns, of whatever
name, are not read. A very long document is encoded in parts and held as ids until its length is known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import maybe_broadcast, shared_folder, small_batches, written
from .pretokens import documents_ids
from .tokenfile import _cache, _kinds

END_ID = 1
#: Tokens of the longest sequence, a power of two.
MOST = 2048
#: Ids that a task holds before it writes their pieces, unless one document has more.
HELD_IDS = 1 << 20
SCHEMA = "doc_id long, start long, doc_tokens long, part int, slot long, ids binary, length int"


def cut(n_tokens: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The document (its number) and length of each piece, document by document, longest piece first."""
    bits = most.bit_length() - 1
    whole, rest = np.divmod(n_tokens, most)
    # how many pieces each document has of each length, from the longest on
    many = np.column_stack([whole, *((rest >> b) & 1 for b in range(bits - 1, -1, -1))]).ravel()
    lengths = np.tile(1 << np.arange(bits, -1, -1), len(n_tokens))
    return np.repeat(np.repeat(np.arange(len(n_tokens)), bits + 1), many), np.repeat(lengths, many)


def write(df: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", most: int = MOST, end_id: int = END_ID) -> None:
    """Encodes the texts with a byte-level BPE tokenizer of the tokenizers library and writes their sequences."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest length must be a power of two")
    spark = df.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        json = f.read()
    shared = spark.sparkContext.broadcast((json, _kinds(json)))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))

    def run(batches):
        cache = _cache(shared.value)
        used = np.zeros(most.bit_length(), np.int64)  # sequences of each length so far
        docs: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        part = n = total = 0

        def pieces():
            n_tokens = np.array(sizes, np.int64)
            which, length = cut(n_tokens, most)
            end = np.cumsum(length)
            before = np.cumsum(n_tokens) - n_tokens
            level = np.log2(length).astype(np.int64)
            slot = np.zeros(len(level), np.int64)
            for k in range(len(used)):
                own = level == k
                slot[own] = used[k] + np.arange(own.sum())
                used[k] += own.sum()
            ids = np.concatenate(held).astype("<u4")
            offsets = np.concatenate([[0], end]).astype(np.int32) * np.int32(4)
            binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()).take(pa.array(which)), pa.array(end - length - before[which]), pa.array(n_tokens[which]), pa.array(np.full(len(which), part, np.int32)), pa.array(slot), binary, pa.array(length.astype(np.int32))], names
            )

        for b in batches:
            doc_ids = b.column(0).to_pylist()
            part = b.column(2)[0].as_py() if b.num_rows else part
            for row, ids, done in documents_ids(b.column(1).to_pylist(), cache):
                held.append(ids)
                n += len(ids)
                total += len(ids)
                if done:
                    held.append(np.array([end_id], np.uint32))
                    docs.append(doc_ids[row])
                    sizes.append(n + 1)
                    total += 1
                    n = 0
                    if total >= HELD_IDS:
                        yield pieces()
                        docs, sizes, held, total = [], [], [], 0
        if docs:
            yield pieces()

    rows.mapInArrow(run, SCHEMA).write.partitionBy("length").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each sequence: doc_id, start, length, doc_tokens, sequence_id, offset, place (its number in its bucket) and ids."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # a row for each length and task of the writer
    parts = written(rows.groupBy("length", "part").agg(F.count("*").alias("_n")))
    totals = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # one row for each length
    first, at = {}, 0
    for length in sorted(totals, reverse=True):
        first[length], at = at, at + totals[length]
    base = parts.select("length", "part", (F.sum("_n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    place = F.col("_base") + F.col("slot")
    begins = F.create_map(*(F.lit(x) for kv in first.items() for x in kv))[F.col("length")] if first else F.lit(0)
    joined = rows.join(maybe_broadcast(written(base)), ["length", "part"])
    return joined.select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", (begins + place).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), place.alias("place"), "ids")


def batch_of(batch_tokens: int) -> Column:
    """The number, within its bucket, of the batch of about ``batch_tokens`` tokens that a sequence of ``read`` is in."""
    return F.floor(F.col("place") / F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length"))))


def pack(df: DataFrame, tokenizer_path: str, path: str | None = None, most: int = MOST) -> DataFrame:
    """Writes the sequences and reads them back."""
    path = path or shared_folder(df.sparkSession)
    write(df, path, tokenizer_path, most=most)
    return read(df.sparkSession, path)
