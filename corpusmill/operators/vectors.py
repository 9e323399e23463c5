"""A partitioned vector index: coarse centres, lists of vectors by their nearest centre, and searches that probe lists.

Centres are learnt from a bounded sample; every vector is in one list. A search probes all lists that can hold a vector
within the asked angle, as a list's radius and the distance to its centre tell (exact), or only the ``probes`` nearest
lists (approximate; ``recall`` measures it). Lists of very many vectors are shared out over tasks. Vectors without a
direction (null, or all zeros) are in no list and find nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import nearness, tables

#: Vectors that the centres are learnt from, and centres, at most.
SAMPLE, CENTRES = 50_000, 4_096
#: Vectors of a list that one task holds at once.
LIST_ROWS = 50_000
#: Angles within rounding of each other.
SLACK = 1e-6


@dataclass
class Index:
    """``rows``: list, share, key and vector (of length 1) of each vector; ``lists``: list, shares and radius of each list,
    at most one for each of the ``centres``."""

    rows: DataFrame
    lists: list
    centres: np.ndarray
    key: str


def _unit(column: pd.Series) -> np.ndarray:
    v = np.stack(column.to_numpy()).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _directed(rows: DataFrame, vector: str) -> DataFrame:
    return rows.where(F.exists(vector, lambda x: (x != 0) & ~F.isnan(x)) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)))


def build(rows: DataFrame, key: str, vector: str, centres: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Index:
    """The index of ``rows``, written to the shared folder. By default as many centres as the root of the rows."""
    have = _directed(rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector")
    n = have.count()
    k = max(1, min(centres or math.isqrt(n), CENTRES, n))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    some = have.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 20)) < (1 << 20) * min(1.0, 1.1 * sample / max(n, 1))).limit(sample)
    points = some.select(array_to_vector(F.transform("vector", lambda x: x.cast("double") / norm)).alias("features"))
    if n <= k or points.isEmpty():
        found = np.zeros((0, 1)) if not n else _unit(have.limit(k).toPandas()["vector"])
    else:
        found = np.array(KMeans(k=k, seed=seed, maxIter=10).fit(points).clusterCenters())
        found = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def assign(batches):
        for b in batches:
            if len(b):
                unit = _unit(b["vector"])
                angle = _angles(unit, shared.value)
                yield pd.DataFrame({"list": angle.argmin(1).astype(np.int32), "angle": angle.min(1), "key": b["key"], "vector": list(unit)})

    kind = dict(have.dtypes)["key"]
    listed = tables.kept(have.mapInPandas(assign, f"list int, angle double, key {kind}, vector array<double>"))
    sizes = listed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # one row for each centre
    lists = [(r["list"], -(-r.n // LIST_ROWS), r.radius) for r in sizes]
    shares = F.create_map(*(F.lit(x) for i, s, _ in lists for x in (i, s)))[F.col("list")] if lists else F.lit(1)
    return Index(listed.withColumn("share", F.pmod(F.xxhash64("key"), shares).cast("int")).select("list", "share", "key", "vector"), lists, found, key)


def nearest(index: Index, queries: DataFrame, most: int = nearness.NEIGHBOURS, farthest: float = nearness.DISTANCE, probes: int | None = None) -> DataFrame:
    """(query_id, key, distance): each query's nearest ``most`` vectors within the angle ``farthest``, ties by key.

    ``queries`` (query_id, query_vector) may be a large table: it is dealt to the lists it probes. With ``probes`` only so
    many nearest lists are read.
    """
    spark = queries.sparkSession
    asked = _directed(queries.select("query_id", "query_vector"), "query_vector")
    kinds = dict(index.rows.dtypes) | dict(queries.dtypes)
    radius, shares = np.full(len(index.centres), -np.inf), np.zeros(len(index.centres), np.int64)
    for i, s, r in index.lists:
        radius[i], shares[i] = r, s
    shared = spark.sparkContext.broadcast((index.centres, radius, shares))

    def route(batches):
        centres, radius, shares = shared.value
        for b in batches:
            if not len(b) or not len(centres):
                continue
            unit = _unit(b["query_vector"])
            angle = _angles(unit, centres)
            reach = angle - radius <= farthest + SLACK
            if probes is not None:
                order = np.argsort(np.where(shares > 0, angle, np.inf), 1)[:, :probes]
                near = np.zeros_like(reach)
                np.put_along_axis(near, order, True, 1)
                reach &= near
            which, lists = np.nonzero(reach)
            many = shares[lists]
            which, lists = np.repeat(which, many), np.repeat(lists, many)
            share = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            yield pd.DataFrame({"list": lists.astype(np.int32), "share": share.astype(np.int32), "query_id": b["query_id"].to_numpy()[which], "query_vector": list(unit[which])})

    routed = asked.mapInPandas(route, f"list int, share int, query_id {kinds['query_id']}, query_vector array<double>")

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values("key")
            v, keys = np.stack(rows["vector"].to_numpy()), rows["key"].to_numpy()
            step = max(1, (1 << 22) // len(rows))
            for i in range(0, len(queries), step):
                part = queries.iloc[i : i + step]
                angle = _angles(np.stack(part["query_vector"].to_numpy()), v)
                for q, a in zip(part["query_id"], angle, strict=True):
                    close = np.flatnonzero(a <= farthest)
                    close = close[np.argsort(a[close], kind="stable")[:most]]
                    out.append(pd.DataFrame({"query_id": q, "key": keys[close], "distance": a[close]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "key": [], "distance": []})

    found = index.rows.groupBy("list", "share").cogroup(routed.groupBy("list", "share")).applyInPandas(meet, f"query_id {kinds['query_id']}, key {kinds['key']}, distance double")
    # at most ``most`` rows of each list that a query probes
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "key"))
    return found.withColumn("_place", place).where(F.col("_place") <= most).select("query_id", F.col("key").alias(index.key), "distance")


def hybrid(index: Index, queries: DataFrame, matched: DataFrame, most: int = nearness.NEIGHBOURS, farthest: float = nearness.DISTANCE, probes: int | None = None) -> DataFrame:
    """(query_id, key, distance, near, matched): each query's nearest vectors, and the rows ``matched`` (query_id, key) that
    its words find, once each; rows found by words alone have no distance."""
    words = matched.select("query_id", index.key).distinct().withColumn("matched", F.lit(True))
    close = nearest(index, queries, most, farthest, probes).withColumn("near", F.lit(True))
    both = close.join(words, ["query_id", index.key], "full_outer")
    return both.select("query_id", index.key, "distance", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("near", "matched")))


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    """The share of the exact neighbours that were found."""
    both = exact.join(found.select("query_id", key).withColumn("_hit", F.lit(1)), ["query_id", key], "left")
    got = both.agg(F.count("_hit").alias("hit"), F.count("*").alias("n")).first()
    return got.hit / got.n if got.n else 1.0
