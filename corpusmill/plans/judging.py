"""Registered queries for record derivation, passage tests, closures and the judging of result lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators import derive, evaluation, metrics

from . import fixtures as fx
from .registry import query

_PASSAGES = fx.with_sql("passages")
KEYS = ["document_id", "idx"]


@query("p11_parsed_values", r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, '') ELSE source END AS value FROM documents""")
def p11_parsed_values(spark, d):
    made = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('Keyword("'), F.coalesce("source", F.lit("")), F.lit('")'))).otherwise(F.col("source"))
    return fx.table(spark, d, "documents").select("doc_id", derive.parsed_value(made).alias("value"))


@query("t03_currency", "SELECT doc_id, length(replace(replace(replace(text, '$', 'dollar'), '£', 'pound'), '€', 'euro')) AS n FROM documents")
def t03_currency(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.length(derive.currency_words(F.col("text"))).cast("long").alias("n"))


@query("d01_short_headings", _PASSAGES + r""", w AS (SELECT *, len(regexp_extract_all(content, '[^ \t-\r]+')) AS n, len(regexp_extract_all(content, '[A-Z]')) AS u, len(regexp_extract_all(content, '[A-Za-z]')) AS l FROM passages)
    SELECT document_id, idx, n BETWEEN 1 AND 11 AND (type = 'sectionHeading' OR (l > 0 AND 10 * u >= 9 * l)) AS short_heading FROM w""")
def d01_short_headings(spark, d):
    return fx.passages(spark, d).select(*KEYS, derive.short_heading(F.col("content"), F.col("type")).alias("short_heading"))


@query("d06_questionnaires", _PASSAGES + ", a AS (SELECT document_id, idx, content || CASE idx % 5 WHEN 0 THEN ' ? Yes/No' WHEN 1 THEN '? n/a' WHEN 2 THEN ' not applicable' ELSE '?' END AS c FROM passages) SELECT document_id, idx FROM a WHERE contains(c, '?') AND (" + " OR ".join(f"contains(lower(c), '{x}')" for x in derive.ANSWERS) + ")")
def d06_questionnaires(spark, d):
    answer = F.when(F.col("idx") % 5 == 0, " ? Yes/No").when(F.col("idx") % 5 == 1, "? n/a").when(F.col("idx") % 5 == 2, " not applicable").otherwise("?")
    return fx.passages(spark, d).withColumn("content", F.concat("content", answer)).where(derive.questionnaire(F.col("content"))).select(*KEYS)


@query("a03_count_maps", fx.with_sql("passages", "passage_topics") + ", c AS (SELECT document_id, topic, count(*) AS n FROM passage_topics GROUP BY ALL) SELECT document_id, string_agg('concept::' || topic || '=' || n, ',' ORDER BY topic) AS counts FROM c GROUP BY 1")
def a03_count_maps(spark, d):
    counts = fx.passage_topics(spark, d).groupBy("document_id", "topic").agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct(F.concat(F.lit("concept::"), F.col("topic")).alias("key"), "n")))
    maps = counts.groupBy("document_id").agg(F.map_from_entries(entries).alias("m"))
    return maps.select("document_id", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("counts"))


@query("a06_last_writer", "SELECT source, max(doc_id) AS doc_id FROM documents WHERE doc_id IS NOT NULL GROUP BY 1")
def a06_last_writer(spark, d):
    docs = fx.table(spark, d, "documents").where("doc_id is not null").select("source", "doc_id")
    return derive.last_writer(docs, "source", ["doc_id"])


def _edges(spark, d):
    """A document's number belongs to its quarter's, down to 1."""
    docs = fx.table(spark, d, "documents").where("doc_id > 3").select(F.col("doc_id").alias("child"))
    return docs.select(F.expr("child div 4").alias("parent"), "child")


_TREE = "WITH RECURSIVE e AS (SELECT DISTINCT doc_id // 4 AS parent, doc_id AS child FROM documents WHERE doc_id > 3), p AS (SELECT parent AS ancestor, child AS descendant FROM e UNION SELECT e.parent, p.descendant FROM p JOIN e ON e.child = p.ancestor) "


@query("j19_closure", _TREE + "SELECT ancestor, descendant FROM p")
def j19_closure(spark, d):
    return derive.closure(_edges(spark, d))


@query("j18_direct_parents", _TREE + "SELECT DISTINCT child AS descendant, parent AS ancestor FROM e")
def j18_direct_parents(spark, d):
    return derive.direct_parents(derive.closure(_edges(spark, d)))


def _judged(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", F.expr("n_chars div 100").alias("score"))
    return docs.join(fx.table(spark, d, "labels").select("doc_id", F.col("quality").alias("gain")), "doc_id")


@query(
    "a20_ndcg",
    """WITH j AS (SELECT lang, n_chars // 100 AS score, quality AS gain FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC) AS i, row_number() OVER (PARTITION BY lang ORDER BY gain DESC) AS k FROM j),
    m AS (SELECT *, avg(1 / log2(i + 1)) OVER (PARTITION BY lang, score) AS w FROM r)
    SELECT lang, round(sum(gain * w) / sum(gain / log2(k + 1)), 6) AS ndcg FROM m GROUP BY lang HAVING count(*) >= 2 AND sum(gain) > 0""",
)
def a20_ndcg(spark, d):
    return evaluation.ndcg(_judged(spark, d).where("lang is not null"), ["lang"], "score", "gain").withColumn("ndcg", F.round("ndcg", 6))


@query(
    "a23_pass_rates",
    """WITH r AS (SELECT coalesce(lang, 'uncategorized') AS category, quality = 1 AS passed FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE passed) AS n_passed FROM r GROUP BY 1),
    u AS (SELECT category, n, n_passed, n_passed / n AS rate FROM c UNION ALL SELECT 'overall', sum(n), sum(n_passed), sum(n_passed) / sum(n) FROM c UNION ALL SELECT 'macro', sum(n), sum(n_passed), avg(n_passed / n) FROM c)
    SELECT category, CAST(n AS BIGINT) AS n, CAST(n_passed AS BIGINT) AS n_passed, round(rate, 6) AS rate FROM u""",
)
def a23_pass_rates(spark, d):
    return evaluation.pass_rates(_judged(spark, d).select(F.col("lang").alias("category"), (F.col("gain") == 1).alias("passed"))).withColumn("rate", F.round("rate", 6))


@query("u02_positions", "WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS x, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS y FROM documents) SELECT lang, doc_id FROM a WHERE x = y")
def u02_positions(spark, d):
    by = W.partitionBy("lang")
    docs = fx.table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return docs.withColumns({"x": F.row_number().over(by.orderBy(F.desc_nulls_last("n_chars"), F.asc_nulls_last("doc_id"))), "y": F.row_number().over(by.orderBy(F.asc_nulls_last("n_chars"), F.asc_nulls_last("doc_id")))}).where("x = y").select("lang", "doc_id")


@query("a30_outcomes", fx.with_sql("web_events") + "SELECT event, CASE WHEN k < 60 THEN 'ok' WHEN k < 80 THEN 'client' ELSE 'server' END AS outcome, count(*) AS n, round(avg(value), 4) AS mean_value FROM web_events GROUP BY ALL")
def a30_outcomes(spark, d):
    outcome = F.when(F.col("k") < 60, "ok").when(F.col("k") < 80, "client").otherwise("server")
    return fx.web_events(spark, d).groupBy("event", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"))


@query(
    "m05_non_searcher_retention",
    fx.with_sql("web_events")
    + """, f AS (SELECT distinct_id, min(ts) AS first_ts, arg_min(session_id, (ts, event_id)) AS s, count(*) FILTER (WHERE url LIKE '/search%') AS n FROM web_events WHERE CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM web_events) GROUP BY 1),
    y AS (SELECT f.distinct_id, e.ts > date_trunc('day', first_ts) + INTERVAL 1 DAY AND e.ts < first_ts + INTERVAL 29 DAY AND e.session_id <> f.s AS back FROM f LEFT JOIN web_events e USING (distinct_id) WHERE n = 0)
    SELECT 'non_searcher_retention_29' AS metric, round(100.0 * CAST(count(DISTINCT CASE WHEN back THEN distinct_id END) AS DOUBLE) / nullif(count(DISTINCT distinct_id), 0), 6) AS value FROM y""",
)
def m05_non_searcher_retention(spark, d):
    return metrics.non_searcher_retention(fx.web_events(spark, d))
