"""Choice of a set of documents in tiers: topics, corpora, lengths, then the regions that are still rare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percent_ranks(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Adds the share of the group's other rows with a smaller value. The window runs over each group's distinct values,
    so a group that holds most rows is counted before it is ordered."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("_n"))
    own = W.partitionBy(by)
    before = F.coalesce(F.sum("_n").over(own.orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn(name, F.coalesce(F.try_divide(before, F.sum("_n").over(own) - 1), F.lit(0.0)))
    return rows.join(ranks.drop("_n"), [by, value])


def picked(rows: DataFrame, by: str, draw: Column, quota: Column | int = 1) -> DataFrame:
    """As many rows of each group as its quota, those with the least ``draw``; ties by document."""
    place = F.row_number().over(W.partitionBy(by).orderBy(draw, "document_id"))
    return rows.withColumn("_place", place).where(F.col("_place") <= quota).drop("_place")


def _without(rows: DataFrame, *earlier: DataFrame) -> DataFrame:
    for tier in earlier:
        rows = rows.join(tier.select("document_id"), "document_id", "left_anti")
    return rows


def _reason(rows: DataFrame, kind: str, column: str) -> DataFrame:
    return rows.select("document_id", F.concat(F.lit(f"{kind}:"), column).alias("reason"))


def stratified(topics: DataFrame, meta: DataFrame, regions: DataFrame, quotas: dict[str, int], band: Column, draw: Column, top: float = 0.9, per_band: int = 2, gaps: int = 5) -> DataFrame:
    """(document_id, reason), a row for each tier and group that chose the document.

    ``topics`` (document_id, topic, n, share): one document of the top of each topic by count and one by share. ``meta``
    (document_id, corpus, max_page): of those left, a quota of each corpus, then some of each length ``band``. ``regions``
    (document_id, region): one of each of the regions with the fewest documents so far. ``draw`` is a seeded order."""
    by_count = picked(percent_ranks(topics, "topic", "n", "_rank").where(F.col("_rank") >= top), "topic", draw)
    by_share = picked(percent_ranks(topics, "topic", "share", "_rank").where(F.col("_rank") >= top), "topic", draw)
    first = _reason(by_count, "tier1_absolute", "topic").unionByName(_reason(by_share, "tier1_relative", "topic"))
    limit = F.try_element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col("corpus"))
    second = _reason(picked(_without(meta, first).where(limit.isNotNull()), "corpus", draw, limit), "tier2_corpus", "corpus")
    banded = _without(meta, first, second).withColumn("_band", band).where("_band is not null")
    third = _reason(picked(banded, "_band", draw, per_band), "tier3_length", "_band")
    chosen = first.unionByName(second).unionByName(third)
    have = regions.join(chosen.select("document_id").distinct(), "document_id", "left_semi").groupBy("region").agg(F.count_distinct("document_id").alias("_have"))
    one = picked(_without(regions, chosen), "region", draw)
    rare = one.join(have, "region", "left").orderBy(F.coalesce("_have", F.lit(0)), "region").limit(gaps)
    return chosen.unionByName(_reason(rare, "tier4_geography", "region"))


def described(chosen: DataFrame, meta: DataFrame) -> DataFrame:
    """One row for each chosen document with its reasons in order and its metadata."""
    reasons = chosen.groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_list("reason")), " | ").alias("reasons"))
    return reasons.join(meta, "document_id")
