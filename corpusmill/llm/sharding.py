"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: an offset and a skip drawn
from the hash of its name. The shards take turns and each claims its next free slot until the table is full, so
shares differ by one slot at most (or follow the weights), and a shard that goes gives its slots to the others
while few other slots change. A row's key is hashed to a slot; the table has a fixed number of rows, so its
broadcast is bounded, and placing a row takes one lookup without any shuffle.

Nulls: a null key is hashed as an empty text and placed like any other. Repeated keys get the same shard, however
many there are. An empty input gives no rows; further columns stay, but for ``slot`` and ``shard``, which are
replaced. Keys may be of any length; nothing but the key is looked at.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; slots of the table. More than a hundred slots for each of up to 650 shards.
SLOTS = 65537


def _draw(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: dict[str, int], slots: int = SLOTS) -> list[str]:
    """The shard of each slot. ``shards`` maps names to weights: turns that a shard takes in each round."""
    if not shards or any(w < 1 for w in shards.values()) or sum(shards.values()) > slots:
        raise ValueError("needs shards with weights of 1 or more, and no more turns than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    table: list[str | None] = [None] * slots
    at = {s: _draw(s, "offset") % slots for s in shards}
    skip = {s: _draw(s, "skip") % (slots - 1) + 1 for s in shards}
    free = slots
    while True:
        for s in sorted(shards):
            for _ in range(shards[s]):
                while table[at[s]] is not None:
                    at[s] = (at[s] + skip[s]) % slots
                table[at[s]] = s
                free -= 1
                if not free:
                    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its MD5, modulo the number of slots."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def lookup_table(spark: SparkSession, shards: dict[str, int], slots: int = SLOTS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(fill(shards, slots))), "slot int, shard string")


def place(df: DataFrame, shards: dict[str, int], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Adds ``slot`` and ``shard`` to each row."""
    table = lookup_table(df.sparkSession, shards, slots).withColumnRenamed("slot", "_slot")
    placed = df.withColumn("_slot", slot_of(F.col(key), slots)).drop("slot", "shard")
    return placed.join(F.broadcast(table), "_slot").withColumnRenamed("_slot", "slot").select(*(c for c in placed.columns if c != "_slot"), "slot", "shard")


def write_shards(df: DataFrame, path: str, shards: dict[str, int], key: str = "doc_id", slots: int = SLOTS, files: int = 8) -> None:
    """Writes the rows below one folder for each shard, up to ``files`` files in each."""
    placed = place(df, shards, key, slots).withColumn("_part", F.pmod(F.xxhash64(F.col(key)), F.lit(files)))
    placed.repartition("shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)


def moved(before: dict[str, int], after: dict[str, int], slots: int = SLOTS) -> float:
    """The share of slots that change their shard between two sets of shards."""
    return sum(a != b for a, b in zip(fill(before, slots), fill(after, slots), strict=True)) / slots
