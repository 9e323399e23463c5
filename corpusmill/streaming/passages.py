"""Streams: passages derived from a watched folder of update lines, and a metric by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators import feeds, updates


def derived(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The lines of a watched folder with the flags of the passage detectors; stateless, so as in a batch."""
    return feeds.with_type_flags(spark.readStream.schema(schema).json(folder))


def apply_stream(changes: DataFrame, base: str, key: str, checkpoint: str, target: str) -> StreamingQuery:
    """Applies each batch of partial updates to the newest version of a table: version n+1 is written below ``target``
    before the batch is committed, and a batch that is run again overwrites it. Each batch writes the table anew, which
    suits small ones; ``patched`` rewrites the buckets that a batch touches only."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(base if number == 0 else f"{target}/version={number - 1}")
        updates.apply_updates(before, batch, key).write.mode("overwrite").parquet(f"{target}/version={number}")

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def searches_by_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, views, searches) of a stream of events, closed when the watermark has passed the day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("views"), F.count_if(F.col("url").like("/search%")).alias("searches")).select(F.col("window.start").alias("day"), "views", "searches")
