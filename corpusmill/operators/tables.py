"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may leave that setting out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written and read again: cuts the lineage of iterations, and survives lost executors."""
    path = shared_folder(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of at most so many rows are broadcast after they were counted.
BROADCAST_ROWS = 200_000


def measured(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only if ``df``, a kept table of narrow rows, has at most ``most`` rows; else a join shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Rows of a stated table, such as queries or engines, that every other row may be held against.
STATED_ROWS = 10_000


def hint(df: DataFrame, most: int = BROADCAST_ROWS) -> Callable[[DataFrame], DataFrame]:
    """What to wrap ``df``, and tables with no more rows than it, in before a join: a broadcast if it has at most ``most`` rows,
    else nothing, so that the join shuffles."""
    return F.broadcast if df.limit(most + 1).count() <= most else lambda x: x


def stated(df: DataFrame, most: int = STATED_ROWS) -> DataFrame:
    """A stated table broadcast to all rows of another; more than ``most`` rows are refused and belong in blocks or an index."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} stated rows")
    return F.broadcast(df)
