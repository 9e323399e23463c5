"""Judging rankings and test results: NDCG with ties, pass rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ndcg(rows: DataFrame, by: list[str], score: str, gain: str) -> DataFrame:
    """(by, ndcg) of each group; rows of equal score share their discounts. Groups of fewer than two rows or without
    any gain are left out.

    Scores are grouped before they are ranked, so a group's window holds its distinct scores and gains only.
    """

    def dcg(value: str, name: str) -> DataFrame:
        tied = rows.groupBy(*by, F.col(value).alias("_s")).agg(F.sum(gain).alias("_g"), F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        places = tied.withColumn("_before", before).withColumn("_discount", F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("_n")), F.lit(0.0), lambda a, i: a + 1 / F.log2(F.col("_before") + i + 1)))
        return places.groupBy(*by).agg(F.sum(F.col("_g") * F.col("_discount") / F.col("_n")).alias(name), F.sum("_n").alias(f"_n_{name}"))

    both = dcg(score, "_got").join(dcg(gain, "_best"), by).where("_n__got >= 2 and _best > 0")
    return both.select(*by, (F.col("_got") / F.col("_best")).alias("ndcg"))


def pass_rates(results: DataFrame) -> DataFrame:
    """(category, n, n_passed, rate) of each category, of all (overall) and the mean of the categories' rates (macro)."""
    named = results.withColumn("category", F.coalesce("category", F.lit("uncategorized")))

    def sums(df: DataFrame) -> DataFrame:
        return df.groupBy("category").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed")).withColumn("rate", F.col("n_passed") / F.col("n"))

    each = sums(named)
    macro = each.agg(F.sum("n").alias("n"), F.sum("n_passed").alias("n_passed"), F.avg("rate").alias("rate")).select(F.lit("macro").alias("category"), "n", "n_passed", "rate")
    return each.unionByName(sums(named.withColumn("category", F.lit("overall")))).unionByName(macro)
