"""Sinks of bounded files, step tables and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 200 << 20


def write_shards(rows: DataFrame, path: str, size: int = SHARD_BYTES) -> int:
    """JSON lines in files of about ``size`` bytes each; shards of an earlier, longer run go. Returns their number. The sizes
    come from all rows, in one pass before the write."""
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*"))) + 1).alias("b")).first()
    parts = max(1, -(-(sums.b or 0) // size))
    # dealt in turns, so that no file is far from the mean; a file never holds more rows than twice its share
    rows.repartition(parts).write.mode("overwrite").option("maxRecordsPerFile", max(1, 2 * -(-sums.n // parts))).json(path)
    return parts


def step_table(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table that replaces the one of an earlier run, read again: later steps see the same rows."""
    rows.write.mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def write_results(results: DataFrame, path: str) -> None:
    """Test results as JSON lines; null members stay as null."""
    results.write.option("ignoreNullFields", False).json(path)
