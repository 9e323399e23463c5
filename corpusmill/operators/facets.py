"""Facet counts over label arrays, in one pass over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters


def flat(docs: DataFrame, tree: dict | None = None, most: int | None = None, arrays: tuple[str, ...] = ("labels",)) -> DataFrame:
    """(key, count) of the keys type::value of the labels, or of the elements of other arrays such as concepts as well, the
    most frequent first; all of them, or the first ``most``."""
    keys = F.array_distinct(F.flatten(F.array(*(F.transform(F.coalesce(a, F.array().cast(docs.schema[a].dataType)), lambda x: F.concat_ws("::", x["type"], x["value"])) for a in arrays))))
    out = docs.where(filters.build(tree, same_element=False)).select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")
    return out if most is None else out.limit(most)


def page(docs: DataFrame, tree: dict | None, order: list, size: int, number: int = 1) -> DataFrame:
    """A page of the hits with ``total``, the number of all hits, beside each."""
    hits = docs.where(filters.build(tree, same_element=False))
    total = hits.agg(F.count("*").alias("total"))  # one row
    return hits.orderBy(*order).offset((number - 1) * size).limit(size).join(F.broadcast(total))


def disjunctive(docs: DataFrame, tree: dict | None, by: str = "type") -> DataFrame:
    """(type, id, value, count): a group that the tree narrows is counted without its own conditions, the others with
    all; only groups that the fully filtered documents have are shown, the most frequent first.

    One boolean column for each narrowed group, then conditional counts: no query for each facet.
    """
    own = filters.groups(tree)
    marked = docs.withColumns({"_full": filters.build(tree, same_element=False), **{f"_without_{i}": filters.build(filters.prune(tree, g), same_element=False) for i, g in enumerate(own)}})
    some = F.col("_full")
    for i in range(len(own)):
        some = some | F.col(f"_without_{i}")
    labels = marked.where(some).select("_full", *(f"_without_{i}" for i in range(len(own))), F.explode(F.array_distinct("labels")).alias("x"))
    group = F.col(f"x.{by}")
    counted = F.col("_full")
    for i, g in enumerate(own):
        counted = F.when(group == g, F.col(f"_without_{i}")).otherwise(counted)
    each = labels.groupBy(group.alias("type"), F.col("x.id").alias("id"), F.col("x.value").alias("value")).agg(F.count_if(counted).alias("count"), F.count_if("_full").alias("_seen"))
    shown = each.groupBy("type").agg(F.sum("_seen").alias("_any")).where("_any > 0").select("type")
    return each.where("count > 0").join(shown, "type", "left_semi").select("type", "id", "value", "count").orderBy(F.desc("count"), "type", "id", "value")


def label_types(docs: DataFrame) -> DataFrame:
    """(type, count), the most frequent first."""
    return docs.select(F.explode("labels").alias("x")).groupBy(F.col("x.type").alias("type")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")
