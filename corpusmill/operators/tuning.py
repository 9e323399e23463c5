"""Choice of thresholds for topic features: candidate grids, grouped folds, reports by group and leaderboards."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relevance import threshold_class


def _f1(tp: Column, predicted: Column, support: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, predicted + support), F.lit(0.0))


def report_by(rows: DataFrame, by: list[str], classes: list[int]) -> DataFrame:
    """(by, class, f1, support) of columns score and predicted; a division by zero is 0."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), (F.col("score") == c).alias("is"), (F.col("predicted") == c).alias("said")) for c in classes))).alias("x")
    sums = rows.select(*by, each).groupBy(*by, F.col("x.class").alias("class")).agg(F.count_if(F.col("x.is") & F.col("x.said")).alias("tp"), F.count_if("x.said").alias("p"), F.count_if("x.is").alias("support"))
    return sums.select(*by, "class", _f1(F.col("tp"), F.col("p"), F.col("support")).alias("f1"), "support")


def macro(report: DataFrame) -> DataFrame:
    """(class, f1, support): the mean over the groups that have the class, and the sum of their support."""
    return report.where("support > 0").groupBy("class").agg(F.avg("f1").alias("f1"), F.sum("support").alias("support"))


def binary(rows: DataFrame) -> DataFrame:
    """precision, recall and f1 of any relevance (classes above 0) against none, one row."""
    is_, said = F.col("score") > 0, F.col("predicted") > 0
    sums = rows.agg(F.count_if(is_ & said).alias("tp"), F.count_if(said).alias("p"), F.count_if(is_).alias("s"))
    zero = F.lit(0.0)
    return sums.select(F.coalesce(F.try_divide("tp", "p"), zero).alias("precision"), F.coalesce(F.try_divide("tp", "s"), zero).alias("recall"), _f1(F.col("tp"), F.col("p"), F.col("s")).alias("f1"))


def sweep(features: DataFrame, feature: str, grid: list[tuple[float, float]]) -> DataFrame:
    """Each row with the class that every pair of thresholds gives it, in one job: key, low, high, predicted."""
    points = F.array(*(F.struct(F.lit(f"{feature}[low={a:g},high={b:g}]").alias("key"), F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in grid))
    out = features.withColumn("_p", F.explode(points)).select("*", "_p.*").drop("_p")
    return out.withColumn("predicted", threshold_class(F.col(feature), F.col("low"), F.col("high")))


def grid_scores(swept: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, key, low, high, f1): the mean F1 of classes 1 and 2 of each grid point."""
    sums = swept.groupBy(*by, "key", "low", "high").agg(*(e.alias(f"{n}{c}") for c in (1, 2) for n, e in (("tp", F.count_if((F.col("score") == c) & (F.col("predicted") == c))), ("p", F.count_if(F.col("predicted") == c)), ("s", F.count_if(F.col("score") == c)))))
    return sums.select(*by, "key", "low", "high", (reduce(add, (_f1(F.col(f"tp{c}"), F.col(f"p{c}"), F.col(f"s{c}")) for c in (1, 2))) / 2).alias("f1"))


def best(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """The grid point of the highest F1 of each group; of equal ones that with the lowest thresholds."""
    order = F.struct(F.round("f1", 9).alias("_f"), (-F.col("low")).alias("_l"), (-F.col("high")).alias("_h"))
    out = scores.groupBy(*by).agg(F.max_by(F.struct("key", "low", "high", "f1"), order).alias("_b"))
    return out.select(*by, "_b.*")


def cross_validated(swept: DataFrame, fold: Column, folds: int) -> DataFrame:
    """(fold, key, low, high, held_out): thresholds chosen on the other folds, and their F1 on the fold itself.

    The sums of each fold and grid point are taken once; a fold's training sums are the totals without its own."""
    counts = {f"{n}{c}": e for c in (1, 2) for n, e in (("tp", F.count_if((F.col("score") == c) & (F.col("predicted") == c))), ("p", F.count_if(F.col("predicted") == c)), ("s", F.count_if(F.col("score") == c)))}
    own = swept.groupBy(fold.alias("fold"), "key", "low", "high").agg(*(e.alias(k) for k, e in counts.items()))
    rest = {k: F.sum(k).over(W.partitionBy("key")) - F.col(k) for k in counts}
    mean = lambda p: reduce(add, (_f1(F.col(f"{p}tp{c}"), F.col(f"{p}p{c}"), F.col(f"{p}s{c}")) for c in (1, 2))) / 2
    both = own.withColumns({f"r_{k}": e for k, e in rest.items()}).withColumns({"train": mean("r_"), "held_out": mean("")})
    order = F.struct(F.round("train", 9).alias("_f"), (-F.col("low")).alias("_l"), (-F.col("high")).alias("_h"))
    return both.groupBy("fold").agg(F.max_by(F.struct("key", "low", "high", "held_out"), order).alias("_b")).select("fold", "_b.*")


def over_folds(validated: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, mean, deviation, folds) of the folds' held-out scores; the deviation is that of all folds, not of a sample."""
    return validated.groupBy(*by).agg(F.avg("held_out").alias("mean"), F.stddev_pop("held_out").alias("deviation"), F.count("*").alias("folds"))


def ranking_score(feature: Column, floor: Column, smaller_is_better: bool = False) -> Column:
    """A feature as a score, negated where less is better; rows without it come below the ``floor``, the least score."""
    return F.coalesce(-feature if smaller_is_better else feature, floor - 1)
