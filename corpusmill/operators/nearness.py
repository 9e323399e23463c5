"""How near a query's words stand to each other, and nearest vectors beside matches of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import search, tables

#: Words within which two neighbours of a query count as near, and the worth of the wrong order.
REACH, REVERSED = 10, 0.5
#: Neighbours asked for and their greatest distance. Fixed values.
NEIGHBOURS, DISTANCE = 1000, 0.24


def proximity(rows: DataFrame, keys: list[str], text: str, pairs: DataFrame, reach: int = REACH) -> DataFrame:
    """(query_id, keys, proximity): the mean over a query's neighbouring words of how near they come in the row, from 1 (next
    to each other, in order) down to 0 (``reach`` words apart or one missing).

    ``pairs`` (query_id, pair, first, second) is counted, and broadcast if it is small. Each word looks back to the last place of its
    neighbour in one window over the row's own places of both; places are not joined with each other.
    """
    small = tables.hint(pairs, tables.BROADCAST_ROWS // 2)  # two ends each
    ends = pairs.select("query_id", "pair", F.explode(F.array(F.struct(F.col("first").alias("term"), F.lit(0).alias("role")), F.struct(F.col("second").alias("term"), F.lit(1).alias("role")))).alias("x")).select("query_id", "pair", "x.*")
    places = rows.select(*keys, F.posexplode(search.tokens(F.col(text))).alias("pos", "term")).join(small(ends), "term")
    before = W.partitionBy("query_id", "pair", *keys).orderBy("pos", "role").rowsBetween(W.unboundedPreceding, -1)
    other = lambda role: F.col("pos") - F.last(F.when(F.col("role") == 1 - role, F.col("pos")), ignorenulls=True).over(before)
    gaps = places.withColumns({"_ahead": F.when(F.col("role") == 1, other(1)), "_back": F.when(F.col("role") == 0, other(0))})
    worth = lambda gap: F.greatest(F.coalesce(1 - (gap - 1) / F.lit(reach), F.lit(0.0)), F.lit(0.0))
    each = gaps.groupBy("query_id", "pair", *keys).agg(F.min("_ahead").alias("_ahead"), F.min("_back").alias("_back"))
    near = each.withColumn("_near", F.greatest(worth(F.col("_ahead")), REVERSED * worth(F.col("_back"))))
    counts = pairs.groupBy("query_id").agg(F.count("*").alias("_pairs"))  # one row for each stated query
    return near.groupBy("query_id", *keys).agg(F.sum("_near").alias("_sum")).join(small(counts), "query_id").select("query_id", *keys, (F.col("_sum") / F.col("_pairs")).alias("proximity"))


def of_places(words: Column, places, reach: int = REACH) -> Column:
    """The same for one row that has its words' places: ``places(word)`` is a sorted array. The mean is over neighbours
    among the different ``words``; 0 where there is but one word.

    The places of both neighbours are merged and read once, so that a word of many places costs no more than they are.
    """
    worth = lambda gap: F.greatest(F.coalesce(1 - (gap - 1) / F.lit(reach), F.lit(0.0)), F.lit(0.0))
    none = F.lit(None).cast("int")

    def near(a: Column, b: Column) -> Column:
        marked = lambda w, role: F.transform(places(w), lambda p: F.struct(p.alias("pos"), F.lit(role).alias("role")))
        placed = F.array_sort(F.concat(marked(a, 0), marked(b, 1)))
        start = F.struct(none.alias("a"), none.alias("b"), none.alias("ahead"), none.alias("back"))
        step = lambda s, x: F.struct(
            F.when(x["role"] == 0, x["pos"]).otherwise(s["a"]).alias("a"), F.when(x["role"] == 1, x["pos"]).otherwise(s["b"]).alias("b"),
            F.when(x["role"] == 1, F.least(s["ahead"], x["pos"] - s["a"])).otherwise(s["ahead"]).alias("ahead"), F.when(x["role"] == 0, F.least(s["back"], x["pos"] - s["b"])).otherwise(s["back"]).alias("back"),
        )
        return F.aggregate(placed, start, step, lambda s: F.greatest(worth(s["ahead"]), REVERSED * worth(s["back"])))

    unlike = F.array_distinct(words)
    n = F.greatest(F.size(unlike) - 1, F.lit(0))
    each = F.zip_with(F.slice(unlike, 1, n), F.slice(unlike, 2, n), near)
    return F.coalesce(F.try_divide(F.aggregate(each, F.lit(0.0), lambda s, v: s + v), n), F.lit(0.0))


def angle(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j), F.lit(0.0), lambda s, v: s + v)
    return F.acos(F.least(F.greatest(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(-1.0)), F.lit(1.0)))


def hybrid(rows: DataFrame, key: str, vector: str, matched: Column, queries: DataFrame, distance=angle, farthest: float = DISTANCE, most: int = NEIGHBOURS) -> DataFrame:
    """(query_id, key, distance, near, matched): rows whose words match, and each query's nearest ``most`` rows within
    ``farthest``. ``queries`` (query_id, query_vector) is a stated table of bounded size (``vectors`` is for more); ``matched`` may use its
    columns. Each row is compared with the stated queries only; ``distance`` is the metric."""
    away = F.round(distance(F.col(vector), F.col("query_vector")), 6)
    hits = rows.join(tables.stated(queries), F.coalesce(matched, F.lit(False)) | (away <= farthest)).select("query_id", key, away.alias("distance"), F.coalesce(matched, F.lit(False)).alias("matched"))
    close = F.col("distance") <= farthest
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", key))
    nearest = hits.where(close).withColumn("_place", place).where(F.col("_place") <= most).withColumn("near", F.lit(True)).drop("_place")
    # what matches by its words alone needs no place
    beyond = hits.where("matched").join(nearest.select("query_id", key), ["query_id", key], "left_anti").withColumn("near", F.lit(False))
    return nearest.unionByName(beyond)
