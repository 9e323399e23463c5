"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written


@tidy
def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the component is its smallest node.

    Each round every node takes the smallest of its neighbours and itself, pointers are followed twice, and the
    graph is contracted to what remains between different groups; a star is done after one round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges, mapping = written(both.distinct()), None
    while True:
        near = edges.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p"))
        for _ in range(2):
            near = written(near)
            to = near.select(F.col("node").alias("p"), F.col("p").alias("q"))
            near = near.join(to, "p", "left").select("node", F.coalesce("q", "p").alias("p"))
        near = written(near)
        if mapping is None:
            mapping = near.select("node", F.col("p").alias("component"))
        else:
            to = near.select(F.col("node").alias("component"), "p")
            mapping = mapping.join(to, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        mapping = written(mapping)
        a, b = near.select(F.col("node").alias("a"), F.col("p").alias("pa")), near.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        edges = written(edges.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        if edges.isEmpty():
            return mapping
