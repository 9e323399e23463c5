"""Search answers for many queries at once: filtered, scored, ranked and paged, with the number of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import facets, filters, search, tables


def paged(scored: DataFrame, keys: list[str], size: int, number: int = 1) -> DataFrame:
    """A page of each query's hits by score, ties by key, with rank and total_size. The totals are counted before they
    are ranked, and only ranks up to the page's end are sorted out."""
    totals = scored.groupBy("query_id").agg(F.count("*").alias("total_size"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), *keys)))
    page = ranked.where((F.col("rank") <= number * size) & (F.col("rank") > (number - 1) * size))
    return page.join(F.broadcast(totals), "query_id")  # one row for each stated query


def answered(rows: DataFrame, keys: list[str], text: str, queries: DataFrame, tree: dict | None = None, extra: Column | None = None, size: int = 10, number: int = 1) -> DataFrame:
    """The rows that match a query's words and the filter tree, scored by their words and ``extra`` (topics, penalties):
    query_id, keys, text_score, score, rank, total_size."""
    words = search.bm25(rows, keys, text, queries).withColumn("text_score", F.round("score", 6)).drop("score")
    hits = words.join(rows.where(filters.build(tree)), keys)
    scored = hits.withColumn("score", F.round(F.col("text_score") + (F.lit(0.0) if extra is None else extra), 6))
    return paged(scored.select("query_id", *keys, "text_score", "score"), keys, size, number)


def labels_named(labels: DataFrame, queries: DataFrame, size: int = 10) -> DataFrame:
    """(query_id, id, rank): labels whose value is the query, then those that begin with it, then those whose other names
    do, then those that hold it anywhere. ``queries`` (query_id, q), lower-case, is a stated table of bounded size."""
    low, q = F.lower("value"), F.col("q")
    place = F.when(low == q, 0).when(low.startswith(q), 1).when(F.exists("alternatives", lambda x: F.lower(x).startswith(q)), 2).when(low.contains(q), 3)
    hits = labels.join(tables.stated(queries), place.isNotNull()).select("query_id", "id", place.alias("place"), low.alias("name"))
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("place", "name", "id")))
    return ranked.where(F.col("rank") <= size).select("query_id", "id", "rank")


def bundle(docs: DataFrame, tree: dict | None, order: list, size: int, number: int = 1, by: tuple[str, ...] = ("type",)) -> dict[str, DataFrame]:
    """What one request shows: ``hits`` (a page with the total), ``aggregations`` of the hits and the facets asked for."""
    parts = {"hits": facets.page(docs, tree, order, size, number), "aggregations": facets.flat(docs, tree)}
    return parts | {f"facets_{b}": facets.disjunctive(docs, tree, by=b) for b in by}
