"""Registered queries of the vector index: every hundredth vector is a query against all."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import vectors

from . import fixtures as fx
from .registry import query

_NEAR = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v, label AS l FROM embeddings WHERE vec_id % 100 = 0),
    x AS MATERIALIZED (SELECT query_id, vec_id, acos(greatest(least(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 1), -1)) AS distance FROM embeddings, q),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM x WHERE distance <= 1.3 QUALIFY place <= 20)"""


def _asked(e):
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("_label"))


@query("t11_index", f"WITH {_NEAR} SELECT query_id, vec_id, round(distance, 4) AS distance FROM n WHERE query_id <> vec_id")
def t11_index(spark, d):
    """Each query's nearest twenty vectors within 1.3, by the lists that can hold one."""
    e = fx.table(spark, d, "embeddings")
    found = vectors.nearest(vectors.build(e, "vec_id", "embedding"), _asked(e), 20, 1.3)
    return found.where("query_id <> vec_id").withColumn("distance", F.round("distance", 4))


@query("t11_hybrid_index", f"WITH {_NEAR}, w AS (SELECT query_id, vec_id FROM embeddings JOIN q ON label = l AND (vec_id + query_id) % 3 = 0) SELECT coalesce(n.query_id, w.query_id) AS query_id, coalesce(n.vec_id, w.vec_id) AS vec_id, n.vec_id IS NOT NULL AS near, w.vec_id IS NOT NULL AS matched FROM n FULL JOIN w ON n.query_id = w.query_id AND n.vec_id = w.vec_id")
def t11_hybrid_index(spark, d):
    """The nearest beside the rows that share the query's label, as words would match, with target and distance in force."""
    e = fx.table(spark, d, "embeddings")
    asked = _asked(e)
    matched = e.join(asked, F.col("label") == F.col("_label")).where((F.col("vec_id") + F.col("query_id")) % 3 == 0).select("query_id", "vec_id")
    return vectors.hybrid(vectors.build(e, "vec_id", "embedding"), asked, matched, 20, 1.3).select("query_id", "vec_id", "near", "matched")
