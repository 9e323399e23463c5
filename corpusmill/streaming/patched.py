"""A table of buckets that a stream of patches keeps up to date, rewriting the buckets that a batch touches only.

Below ``target``, data/batch=N/bucket=B holds what batch N has written of bucket B, and manifest/batch=N tells for each
bucket which batch wrote it last. A batch reads its buckets through the manifest before it, writes them anew, and its
manifest last; run again, it overwrites its own folders and gives the same table. Readers see a whole batch or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators import updates

BUCKETS = 64


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _manifest(spark: SparkSession, target: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """The newest batch (or the newest before one) and which batch wrote each bucket: a row for each bucket."""
    rows = spark.read.schema("bucket int, written long, batch long").parquet(f"{target}/manifest")
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = rows.agg(F.max("batch")).first()[0]
    return newest, {r.bucket: r.written for r in rows.where(F.col("batch") == newest).select("bucket", "written").collect()}


def _publish(spark: SparkSession, target: str, batch: int, written: dict[int, int]) -> None:
    rows = spark.createDataFrame(sorted(written.items()) or [], "bucket int, written long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/batch={batch}")


def _read(spark: SparkSession, target: str, schema, written: dict[int, int]) -> DataFrame:
    paths = [f"{target}/data/batch={n}/bucket={b}" for b, n in sorted(written.items())]
    kind = spark.createDataFrame([], schema)
    return spark.read.schema(kind.schema).parquet(*paths).select(kind.columns) if paths else kind


def _write(rows: DataFrame, target: str, batch: int, key: str, buckets: int) -> list[int]:
    path = f"{target}/data/batch={batch}"
    _bucketed(rows, key, buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return [r.bucket for r in rows.sparkSession.read.schema("bucket int").parquet(path).distinct().collect()]


def create(rows: DataFrame, target: str, key: str, buckets: int = BUCKETS) -> None:
    """Starts the table as batch -1."""
    _publish(rows.sparkSession, target, -1, dict.fromkeys(_write(rows, target, -1, key, buckets), -1))


def read(spark: SparkSession, target: str, schema) -> DataFrame:
    """The newest version."""
    return _read(spark, target, schema, _manifest(spark, target)[1])


def apply_batch(batch: DataFrame, number: int, target: str, schema, key: str, order: str, create: bool = True, buckets: int = BUCKETS) -> None:
    """Folds the batch's patches (key, order, struct<assign> fields) into the buckets that they touch."""
    spark = batch.sparkSession
    _, written = _manifest(spark, target, number)
    folds = updates.fold(batch, key, order, F.lit(create))
    touched = [r.bucket for r in _bucketed(batch.select(key), key, buckets).select("bucket").distinct().collect()]  # at most all buckets
    before = _read(spark, target, schema, {b: written[b] for b in touched if b in written})
    made = _write(updates.apply_folds(before, folds, key), target, number, key, buckets)
    _publish(spark, target, number, written | dict.fromkeys(made, number))


def apply_stream(changes: DataFrame, target: str, schema, key: str, order: str, checkpoint: str, create: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Applies each micro-batch of patches."""
    each = lambda batch, number: apply_batch(batch, number, target, schema, key, order, create, buckets)
    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
