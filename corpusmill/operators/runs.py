"""Runs over several predictors, engines or metrics: leaderboards, comparisons, suites and tables of figures."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce
from operator import add

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables


def _f1(hit, said, real):
    return F.coalesce(F.try_divide(2.0 * F.count_if(hit), F.count_if(said) + F.count_if(real)), F.lit(0.0))


def figures(rows: DataFrame, by: str = "predictor") -> DataFrame:
    """(by, metric, value) of rows (score, predicted): mean_f1 of the classes 1 and 2, and binary_f1 of any against none."""
    s, p = F.col("score"), F.col("predicted")
    mean = reduce(add, (_f1((s == c) & (p == c), p == c, s == c) for c in (1, 2))) / 2
    wide = rows.groupBy(by).agg(mean.alias("mean_f1"), _f1((s > 0) & (p > 0), p > 0, s > 0).alias("binary_f1"))
    return wide.unpivot(by, ["mean_f1", "binary_f1"], "metric", "value")


def leaderboard(long: DataFrame, metrics: list[str], order: str, by: str = "predictor") -> DataFrame:
    """(place, by, metrics): one row for each predictor, the best of metric ``order`` first, ties by name. The number of
    predictors is that of the stated grid, so that one window orders them."""
    wide = long.groupBy(by).pivot("metric", metrics).agg(F.first("value"))
    return wide.withColumn("place", F.row_number().over(W.orderBy(F.round(order, 9).desc_nulls_last(), by)))


def compared(rows: DataFrame, a: str, b: str, truth: str) -> DataFrame:
    """Adds whether two predictors disagree and which of them is right."""
    return rows.withColumns({"disagree": ~F.col(a).eqNullSafe(F.col(b)), "a_right": F.col(a).eqNullSafe(F.col(truth)), "b_right": F.col(b).eqNullSafe(F.col(truth))})


def disagreements(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, n_disagree, n_a_right, n_b_right) of compared rows, the group with the most disagreements first."""
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{c}") for c in ("disagree", "a_right", "b_right")))
    return sums.orderBy(F.desc("n_disagree"), by)


def suite(engines: DataFrame, cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(engine, case_id, category, terms, passed, n_results): every case for every engine. A case that an engine has no
    outcome for (engine, case_id, passed, n_results), such as an error, failed with no results. ``engines`` is a
    stated table of bounded size."""
    every = cases.select("case_id", "category", "terms").join(tables.stated(engines))
    joined = every.join(outcomes, ["engine", "case_id"], "left")
    return joined.select("engine", "case_id", "category", "terms", F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("n_results", F.lit(0)).alias("n_results"))


def run_ids(suites: DataFrame) -> DataFrame:
    """(engine, run_id): the same for the same engine, cases and outcomes, in whatever order they come."""
    row = F.xxhash64(*(c for c in suites.columns if c != "engine"))
    sums = suites.groupBy("engine").agg(F.count("*").alias("_n"), F.bit_xor(row).alias("_x"))
    return sums.select("engine", F.substring(F.sha2(F.concat_ws(":", "engine", "_n", "_x"), 256), 1, 8).alias("run_id"))


def metric_table(spark: SparkSession, metrics: dict[str, Callable[[], DataFrame]], first: date, last: date) -> DataFrame:
    """(metric, value, date_from, date_to, status) of metrics that are frames of one row with a value. One that fails, or
    whose dates are refused, is a row with its error's name and no value; the others are still there."""
    rows = []
    for name, figure in metrics.items():
        try:
            got = figure().select(F.col("value").cast("double")).first()
            rows.append((name, got and got.value, first, last, "ok" if got and got.value is not None else "no results"))
        except (PySparkException, ValueError) as e:
            rows.append((name, None, first, last, type(e).__name__))
    return spark.createDataFrame(rows, "metric string, value double, date_from date, date_to date, status string")
