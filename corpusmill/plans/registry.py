"""All registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import facets, filters, metrics, relevance, updates

from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "a08_facets"

TREE = {"op": "and", "filters": [{"field": "labels.value.id", "op": "contains", "value": "language::en"}, {"field": "labels.value.id", "op": "contains", "value": "quality::1"}]}
#: Each condition in a group of its own, so that different elements may match.
BOTH = {"op": "and", "filters": [{"op": "and", "filters": [c]} for c in TREE["filters"]]}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_HAS = "EXISTS (SELECT 1 FROM doc_labels x WHERE x.doc_id = d.doc_id AND x.id = '{}')"
_EN, _GOOD = _HAS.format("language::en"), _HAS.format("quality::1")


@query(
    "a08_facets",
    fx.with_sql("labels")
    + f""", f AS (SELECT doc_id, {_EN} AS en, {_GOOD} AS good FROM documents d),
    c AS (SELECT l.type, l.id, l.value, count(*) FILTER (WHERE CASE l.type WHEN 'language' THEN good WHEN 'quality' THEN en ELSE en AND good END) AS n, count(*) FILTER (WHERE en AND good) AS seen FROM doc_labels l JOIN f USING (doc_id) GROUP BY ALL)
    SELECT type, id, value, n AS count FROM c WHERE n > 0 AND type IN (SELECT type FROM c GROUP BY type HAVING sum(seen) > 0)""",
)
def a08_facets(spark, d):
    return facets.disjunctive(fx.documents(spark, d), BOTH)


@query(
    "a09_relationship_facets",
    fx.with_sql("labels") + f""", f AS (SELECT doc_id FROM documents d WHERE {_EN}) SELECT relationship AS type, id, value, count(*) AS count FROM doc_labels JOIN f USING (doc_id) GROUP BY ALL""",
)
def a09_relationship_facets(spark, d):
    return facets.disjunctive(fx.documents(spark, d), {"op": "and", "filters": TREE["filters"][:1]}, by="relationship")


@query("a07_flat_facets", fx.with_sql("labels") + "SELECT type || '::' || value AS key, count(DISTINCT doc_id) AS count FROM doc_labels GROUP BY 1")
def a07_flat_facets(spark, d):
    return facets.flat(fx.documents(spark, d))


@query("a10_label_types", fx.with_sql("labels") + "SELECT type, count(*) AS count FROM doc_labels GROUP BY 1")
def a10_label_types(spark, d):
    return facets.label_types(fx.documents(spark, d))


def _ids(tree):
    return lambda spark, d: fx.documents(spark, d).where(filters.build(tree)).select("doc_id")


_TREES = {
    "f01_nested": (
        {"op": "or", "filters": [BOTH, {"field": "labels.value.id", "op": "contains", "value": "toxic::1"}]},
        f"{_EN} AND {_GOOD} OR {_HAS.format('toxic::1')}",
    ),
    "f02_not_contains": ({"op": "and", "filters": [{"field": "labels.value.id", "op": "not_contains", "value": "language::en"}, {"op": "and", "filters": []}]}, f"NOT {_EN}"),
    "f03_same_element": (
        {"op": "and", "filters": [{"field": "labels.type", "op": "contains", "value": "tagged"}, {"field": "labels.value.value", "op": "contains", "value": "1"}]},
        "EXISTS (SELECT 1 FROM doc_labels x WHERE x.doc_id = d.doc_id AND x.relationship = 'tagged' AND x.value = '1')",
    ),
    "f04_attributes": (
        {"op": "and", "filters": [{"field": "attributes_double", "key": "n_chars", "op": "gte", "value": 500}, {"field": "attributes_boolean", "key": "long", "op": "not_eq", "value": True}, {"field": "attributes_string", "key": "missing", "op": "not_eq", "value": "x"}]},
        "d.n_chars >= 500 AND NOT d.n_chars > 1000",
    ),
    "f05_published": (
        {"op": "and", "filters": [{"field": "published", "op": "not_eq", "value": "2024-01-02T00:00:00Z"}, {"op": "or", "filters": [{"field": "published", "op": "gte", "value": "2024-01-10T00:00:00Z"}, {"field": "published", "op": "lt", "value": 1704153600}]}]},
        "d.doc_id % 7 <> 0 AND 1704067200 + d.doc_id * 3600 <> 1704153600 AND (1704067200 + d.doc_id * 3600 >= 1704844800 OR 1704067200 + d.doc_id * 3600 < 1704153600)",
    ),
    "f06_shorthand": ({"op": "and", "filters": [{"field": "attributes.lang", "op": "eq", "value": "fr"}, {"field": "attributes.n_chars", "op": "lt", "value": 2000}, {"field": "attributes.long", "op": "eq", "value": True}]}, "d.lang = 'fr' AND d.n_chars < 2000 AND d.n_chars > 1000"),
    "f11_principal_only": ({"op": "and", "filters": [{"op": "and", "filters": [{"field": "labels.value.id", "op": "contains", "value": "status::Principal"}]}, BOTH]}, f"d.doc_id % 5 = 0 AND {_EN} AND {_GOOD}"),
}
for _name, (_tree, _where) in _TREES.items():
    query(_name, fx.with_sql("labels") + f"SELECT d.doc_id FROM documents d WHERE {_where}")(_ids(_tree))


@query("p05_principal", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN doc_id ELSE doc_id - doc_id % 5 END AS principal_id FROM documents")
def p05_principal(spark, d):
    docs = fx.documents(spark, d).withColumn("edges", F.filter(F.array(F.struct(F.lit("member_of").alias("type"), (F.col("doc_id") - F.col("doc_id") % 5).alias("value"))), lambda x: F.col("doc_id") % 5 != 0))
    own = F.exists("labels", lambda x: x["id"] == "status::Principal")
    target = F.try_element_at(F.filter("edges", lambda x: x["type"].isin("member_of", "is_version_of")), F.lit(1))["value"]
    return docs.select("doc_id", F.when(own, F.col("doc_id")).otherwise(target).alias("principal_id"))


@query("p07_composite_keys", fx.with_sql("labels") + "SELECT doc_id, type AS key_type, id AS key_id, value AS key_value FROM doc_labels")
def p07_composite_keys(spark, d):
    keys = fx.documents(spark, d).select("doc_id", F.explode(F.transform("labels", lambda x: F.concat_ws("::", x["type"], x["id"], x["value"]))).alias("k"))
    kind, value = F.substring_index("k", "::", 1), F.substring_index("k", "::", -1)
    middle = F.substring(F.col("k"), F.length(kind) + 3, F.length("k") - F.length(kind) - F.length(value) - 4)
    return keys.select("doc_id", kind.alias("key_type"), middle.alias("key_id"), value.alias("key_value"))


@query("a01_concept_counts", fx.with_sql("passages", "passage_topics") + "SELECT document_id, topic, count(*) AS mentions, string_agg(CAST(idx AS VARCHAR), '::' ORDER BY idx) AS passage_ids FROM passage_topics GROUP BY ALL")
def a01_concept_counts(spark, d):
    return fx.passage_topics(spark, d).groupBy("document_id", "topic").agg(F.count("*").alias("mentions"), F.array_join(F.transform(F.sort_array(F.collect_list("idx")), lambda x: x.cast("string")), "::").alias("passage_ids"))


@query("a02_principal_counts", fx.with_sql("passages", "passage_topics") + "SELECT document_id - document_id % 5 AS principal_id, topic, count(*) AS mentions FROM passage_topics GROUP BY ALL")
def a02_principal_counts(spark, d):
    lookup = p05_principal(spark, d).where("principal_id is not null")
    mentions = fx.passage_topics(spark, d).groupBy("document_id", "topic").agg(F.count("*").alias("n"))
    return mentions.join(lookup, mentions.document_id == lookup.doc_id).groupBy("principal_id", "topic").agg(F.sum("n").alias("mentions"))


@query("a04_passage_counts", fx.with_sql("passages", "passage_topics") + "SELECT document_id, idx, topic, count(*) AS mentions FROM passage_topics GROUP BY ALL")
def a04_passage_counts(spark, d):
    return fx.passage_topics(spark, d).groupBy("document_id", "idx", "topic").agg(F.count("*").alias("mentions"))


@query("a12_document_stats", fx.with_sql("passages") + "SELECT document_id, count(*) AS passages, max(page_number) AS max_page FROM passages GROUP BY 1")
def a12_document_stats(spark, d):
    return fx.passages(spark, d).groupBy("document_id").agg(F.count("*").alias("passages"), F.max("page_number").alias("max_page"))


@query("n06_sections", fx.with_sql("passages") + "SELECT document_id, idx, CAST(sum(CASE WHEN type = 'sectionHeading' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_id FROM passages")
def n06_sections(spark, d):
    return relevance.sections(fx.passages(spark, d)).select("document_id", "idx", "section_id")


_FEATURES = fx.with_sql("passages", "passage_topics") + """, t AS (SELECT document_id, count(*) AS total FROM passages GROUP BY 1),
    p AS (SELECT document_id, topic, page_number, count(*) AS n, min(idx) AS first_idx FROM passage_topics GROUP BY ALL),
    e AS (SELECT document_id, topic, CAST(sum(n) AS BIGINT) AS mentions, max(n) AS max_per_page, min(first_idx) AS first_idx FROM p GROUP BY ALL),
    y AS (SELECT document_id, topic, sum(exp(-3.0 * idx / total)) AS decayed FROM passage_topics JOIN t USING (document_id) GROUP BY ALL),
    f AS (SELECT document_id, topic, mentions, max_per_page, first_idx, total, mentions / total AS density, 1 - first_idx / total AS earliness, decayed FROM e JOIN t USING (document_id) JOIN y USING (document_id, topic))"""


@query("e02_mention_features", _FEATURES + " SELECT document_id, topic, mentions, max_per_page, first_idx, total, round(density, 6) AS density, round(earliness, 6) AS earliness, round(decayed, 6) AS decayed FROM f")
def e02_mention_features(spark, d):
    f = relevance.mention_features(fx.passage_topics(spark, d), fx.passages(spark, d))
    return f.withColumns({c: F.round(c, 6) for c in ("density", "earliness", "decayed")})


_TFIDF = _FEATURES + ", g AS (SELECT f.*, (SELECT count(*) FROM t) AS n, count(*) OVER (PARTITION BY topic) AS df FROM f), h AS (SELECT *, density * greatest(ln(n / (1 + df)), 0) AS tfidf FROM g)"


@query("e04_tf_idf", _TFIDF + " SELECT document_id, topic, df, round(tfidf, 6) AS tfidf, CASE WHEN round(tfidf, 6) >= 0.09 THEN 2 WHEN round(tfidf, 6) >= 0.01 THEN 1 ELSE 0 END AS class FROM h")
def e04_tf_idf(spark, d):
    passages = fx.passages(spark, d)
    f = relevance.tf_idf(relevance.mention_features(fx.passage_topics(spark, d), passages), passages.agg(F.count_distinct("document_id").alias("n_documents")))
    f = f.withColumn("tfidf", F.round("tfidf", 6))
    return f.select("document_id", "topic", "df", "tfidf", relevance.threshold_class(F.col("tfidf"), 0.01, 0.09).alias("class"))


@query(
    "a18_report",
    """WITH x AS (SELECT quality AS score, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT c AS class, count(*) FILTER (WHERE score = c AND predicted = c) AS tp, count(*) FILTER (WHERE predicted = c) AS p, count(*) FILTER (WHERE score = c) AS support FROM x, (VALUES (0), (1)) v(c) GROUP BY c),
    r AS (SELECT class, coalesce(tp / nullif(p, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re, support FROM c)
    SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, support FROM r""",
)
def a18_report(spark, d):
    docs = fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id")
    out = relevance.classification_report(docs.select(F.col("quality").alias("score"), F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("predicted")), [0, 1])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("w04_updates", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source FROM documents")
def w04_updates(spark, d):
    base = fx.table(spark, d, "documents").select("doc_id", "lang", "source")
    lang = F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("changed").alias("assign"))).when(F.col("doc_id") % 3 == 1, F.struct(F.lit(None).cast("string").alias("assign")))
    source = F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit(None).cast("string").alias("assign")))
    return updates.apply_updates(base, base.select("doc_id", lang.alias("lang"), source.alias("source")), "doc_id")


@query("l02_sort_published", "SELECT doc_id, published FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN 1704067200 + doc_id * 3600 END AS published FROM documents) ORDER BY published DESC NULLS LAST, doc_id LIMIT 20 OFFSET 20")
def l02_sort_published(spark, d):
    return fx.documents(spark, d).select("doc_id", "published").orderBy(F.desc_nulls_last("published"), "doc_id").offset(20).limit(20)


_RATIO = "SELECT '{name}' AS metric, round(100.0 * CAST(count(DISTINCT CASE WHEN {part} THEN distinct_id END) AS DOUBLE) / nullif(count(DISTINCT distinct_id), 0), 6) AS value FROM {table}"


def _metric(name: str, sql: str, f) -> None:
    query(name, fx.with_sql("web_events") + sql)(lambda spark, d: f(fx.web_events(spark, d)))


_metric("m01_users_who_search", _RATIO.format(name="users_who_search", part="url LIKE '/search%'", table="web_events WHERE event = '$pageview' AND consent IS NOT NULL"), metrics.users_who_search)
_metric("m02_users_who_download", _RATIO.format(name="users_who_download", part="event = 'purchase'", table="web_events WHERE distinct_id IN (SELECT distinct_id FROM web_events WHERE consent)"), metrics.users_who_download)
_metric("m03_users_without_results", _RATIO.format(name="users_without_results", part="hits = 0", table="web_events WHERE event = '$pageview' AND url LIKE '/search%'"), metrics.users_without_results)


def _retention(days: int, returning: str = "TRUE") -> str:
    return f""", x AS (SELECT distinct_id, min(ts) AS first_ts, arg_min(session_id, (ts, event_id)) AS s FROM web_events WHERE url LIKE '/search%' AND CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM web_events) GROUP BY 1),
    y AS (SELECT x.distinct_id, e.ts > date_trunc('day', first_ts) + INTERVAL 1 DAY AND e.ts < first_ts + INTERVAL {days} DAY AND e.session_id <> x.s AS back FROM x LEFT JOIN (SELECT * FROM web_events WHERE {returning}) e USING (distinct_id)) """ + _RATIO.format(name=f"retention_{days}", part="back", table="y")


_metric("m04_retention_7", _retention(7), lambda e: metrics.retention(e, 7))
_metric("m04_retention_30", _retention(30), lambda e: metrics.retention(e, 30))
_metric("m06_return_to_search_29", _retention(29, "event = '$pageview' AND url LIKE '/search%'"), lambda e: metrics.retention(e, 29, (F.col("event") == "$pageview") & metrics.on_search()))
_metric("m06_return_to_search_6", _retention(6, "event = '$pageview' AND url LIKE '/search%'"), lambda e: metrics.retention(e, 6, (F.col("event") == "$pageview") & metrics.on_search()))
_STEPS = ", v AS (SELECT *, lead(url, 1) OVER w AS u1, lead(url, 2) OVER w AS u2, lead(ts, 1) OVER w AS t1, lead(ts, 2) OVER w AS t2, lead(ts, 3) OVER w AS t3 FROM web_events WHERE event = '$pageview' AND consent WINDOW w AS (PARTITION BY distinct_id ORDER BY ts, event_id)) "
_metric("m07_click_through", _STEPS + _RATIO.format(name="click_through", part="u1 LIKE '/document/%'", table="v WHERE url LIKE '/search%'"), metrics.click_through)
_metric(
    "m08_click_through_dwell",
    _STEPS + _RATIO.format(name="click_through_dwell_30", part="u1 LIKE '/document/%' AND floor(epoch(t2)) - floor(epoch(t1)) >= 30 OR u1 LIKE '/documents/%' AND u2 LIKE '/document/%' AND floor(epoch(t3)) - floor(epoch(t2)) >= 30", table="v WHERE url LIKE '/search%'"),
    lambda e: metrics.click_through(e, 30),
)
