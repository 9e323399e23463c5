"""Rates of counters and quantiles of the histograms that they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metrics, timeline


def increases(samples: DataFrame, by: list[str], ts: str = "ts", value: str = "count", most: int = timeline.PART_ROWS) -> DataFrame:
    """(by, ts, increase): what a cumulative counter has grown by at each sample since the one before; the first sample of
    a series has none. A counter that is lower than before was reset, and has grown from 0."""
    named = samples.select(*by, ts, F.col(value).cast("double").alias("_v"), F.to_json(F.struct(*by)).alias("_series"))
    steps = timeline.following(named, [ts, "_v"], 1, "_series", ts, ["_v"], most).where(F.size("next") > 0)
    after = F.get("next", 0)
    grown = F.when(after["_v"] >= F.col("_v"), after["_v"] - F.col("_v")).otherwise(after["_v"])
    return steps.select(*by, after[ts].alias(ts), grown.alias("increase"))


def rates(samples: DataFrame, by: list[str], window: str = "5 minutes", step: str | None = None, ts: str = "ts", value: str = "count") -> DataFrame:
    """(by, window, rate): the growth by second of each window, by its start. With ``step`` (such as '1 hour') only the last
    window before each step's end is looked at."""
    grown = increases(samples, by, ts, value).withColumn("_w", F.window(ts, window))
    if step is not None:
        grown = grown.where(F.window(ts, step)["end"] == F.col("_w.end"))
    seconds = F.unix_timestamp("_w.end") - F.unix_timestamp("_w.start")
    return grown.groupBy(*by, "_w").agg(F.sum("increase").alias("_sum")).select(*by, F.col("_w.start").alias("window"), (F.col("_sum") / seconds).alias("rate"))


def histogram_quantiles(samples: DataFrame, by: list[str], shares: list[float], bound: str = "le", window: str = "5 minutes", step: str | None = None, ts: str = "ts", value: str = "count") -> DataFrame:
    """(by, window, q<share>) of cumulative buckets that are counters themselves, from their rates. A bucket whose rate is below
    that of a smaller bound, as a reset may leave it where it went unseen, takes that one's."""
    rated = rates(samples, [*by, bound], window, step, ts, value)
    # the bounds of one window
    rated = rated.withColumn("rate", F.max("rate").over(W.partitionBy(*by, "window").orderBy(bound)))
    grouped = rated.select(F.struct(*by, "window").alias("window"), F.col(bound).alias("le"), F.col("rate").alias("count"))
    out = metrics.latency_quantiles(grouped, shares)
    return out.select("window.*", *(c for c in out.columns if c != "window"))
