"""Registered queries for search answers, detectors, imports from parents and feeds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from corpusmill.operators import analysis, answers, detectors, feeds, filters, scores, search
from corpusmill.sources import readers

from . import fixtures as fx
from .corpus import _FLAGGED, _counts, _flags
from .more import _WORDS, KEYS, TERMS, _queries
from .registry import query

_Q = "q(query_id, term) AS (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in TERMS) + ")"
_DOCS = f"""tok AS (SELECT doc_id, {_WORDS.format('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tok), {_Q},
    po AS (SELECT doc_id, term, l, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    fr AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
    s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.4 + 0.4 * l / a))), 6) AS text_score FROM po JOIN fr USING (term) JOIN q USING (term), st GROUP BY ALL)"""


def _page(score: str, source: str, keys: str, where: str) -> str:
    return f", z AS (SELECT query_id, {keys}, text_score, round({score}, 6) AS score FROM {source} WHERE {where}), pg AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {keys}) AS INTEGER) AS rank, count(*) OVER (PARTITION BY query_id) AS total_size FROM z) SELECT * FROM pg WHERE rank BETWEEN 11 AND 20"


@query("x01_search_documents", f"WITH {_DOCS}" + _page("text_score", "s JOIN documents USING (doc_id)", "doc_id", "lang = 'en'"))
def x01(spark, d):
    return answers.answered(fx.documents(spark, d).where("text IS NOT NULL"), ["doc_id"], "text", _queries(spark), filters.any_of(["language::en"]), size=10, number=2)


@query("x02_search_principals", f"WITH {_DOCS}" + _page("text_score", "s JOIN documents USING (doc_id)", "doc_id", "lang = 'en' AND doc_id % 5 = 0"))
def x02(spark, d):
    tree = filters.both(filters.any_of(["status::Principal"]), filters.any_of(["language::en"]))
    return answers.answered(fx.documents(spark, d).where("text IS NOT NULL"), ["doc_id"], "text", _queries(spark), tree, size=10, number=2)


@query("x03_search_passages", _FLAGGED + _page("text_score - (0.15 * h + 0.35 * t + 0.5 * r) + topics", "(SELECT *, score AS text_score FROM fl)", "document_id, idx", "true").replace("SELECT *, score AS text_score FROM fl", "SELECT * EXCLUDE (score), score AS text_score FROM fl"))
def x03(spark, d):
    flags = {"heading": F.col("type") == "sectionHeading", "contents": F.col("page_number") > 3, "references": F.col("page_number") == 1}
    rows = fx.passages(spark, d).join(_counts(spark, d, KEYS), KEYS, "left").withColumns(flags)
    topic = scores.passage_topics(F.coalesce("counts", F.create_map().cast("map<string,double>")), ["Q1", "Q4"])
    return answers.answered(rows, KEYS, "content", _queries(spark), extra=topic - scores.penalty(_flags()), size=10, number=2)


@query("x04_search_labels", "WITH q(query_id, q) AS (VALUES (1, 'united states'), (2, 'i'), (3, 'land of c'), (4, 'an')), p AS (SELECT query_id, n_nationkey AS id, lower(n_name) AS name, CASE WHEN lower(n_name) = q THEN 0 WHEN starts_with(lower(n_name), q) THEN 1 WHEN starts_with('land of ' || lower(n_name), q) THEN 2 WHEN contains(lower(n_name), q) THEN 3 END AS place FROM nation, q), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, name, id) AS INTEGER) AS rank FROM p WHERE place IS NOT NULL) SELECT query_id, id, rank FROM k WHERE rank <= 10")
def x04(spark, d):
    labels = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("value"), F.array(F.concat(F.lit("Land of "), "n_name")).alias("alternatives"))
    asked = spark.createDataFrame([(1, "united states"), (2, "i"), (3, "land of c"), (4, "an")], "query_id int, q string")
    return answers.labels_named(labels, asked)


@query("j05_parent_fields", fx.with_sql("passages") + "SELECT p.document_id, p.idx, d.lang, o.source AS principal_source FROM passages p JOIN documents d ON d.doc_id = p.document_id LEFT JOIN documents o ON o.doc_id = d.doc_id - d.doc_id % 5 WHERE d.lang = 'de'")
def j05(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang", (F.col("doc_id") - F.col("doc_id") % 5).alias("principal_id"))
    tops = fx.table(spark, d, "documents").select(F.col("doc_id").alias("principal_id"), F.col("source").alias("principal_source"))
    return fx.passages(spark, d).join(docs, "document_id").where("lang = 'de'").join(tops, "principal_id", "left").select(*KEYS, "lang", "principal_source")


@query("j07_topics_in_sections", fx.with_sql("passages", "passage_topics") + ", s AS (SELECT document_id, idx, CAST(sum(CASE WHEN type = 'sectionHeading' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_id FROM passages) SELECT document_id, topic, string_agg(idx || ':' || page_number || ':' || section_id, ',' ORDER BY idx, page_number, section_id) AS mentions FROM passage_topics JOIN s USING (document_id, idx) GROUP BY ALL")
def j07(spark, d):
    """The mention table: for each document and topic its places in order."""
    from corpusmill.operators import relevance

    placed = relevance.sections(fx.passages(spark, d)).select(*KEYS, "section_id")
    entry = F.struct("idx", "page_number", "section_id")
    lists = fx.passage_topics(spark, d).join(placed, KEYS).groupBy("document_id", "topic").agg(F.sort_array(F.collect_list(entry)).alias("m"))
    return lists.select("document_id", "topic", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["idx"], x["page_number"], x["section_id"])), ",").alias("mentions"))


@query("j12_outer_flatten", "SELECT d.doc_id, x.tag, n.n_name FROM documents d LEFT JOIN (SELECT doc_id, unnest([doc_id % 7, doc_id % 11]) AS tag FROM documents WHERE doc_id % 3 <> 0) x USING (doc_id) LEFT JOIN nation n ON n.n_nationkey = x.tag")
def j12(spark, d):
    tags = F.when(F.col("doc_id") % 3 != 0, F.array(F.col("doc_id") % 7, F.col("doc_id") % 11))
    names = fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("tag"), "n_name")
    return fx.table(spark, d, "documents").select("doc_id", F.explode_outer(tags).alias("tag")).join(names, "tag", "left").select("doc_id", "tag", "n_name")


@query("j09_pairs_with_defaults", fx.with_sql("passages", "passage_topics") + ", c AS (SELECT document_id, topic, count(*) AS n FROM passage_topics GROUP BY ALL) SELECT l.doc_id, t.topic, coalesce(c.n, 0) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id, (VALUES ('Q1'), ('Q2')) t(topic) LEFT JOIN c ON c.document_id = l.doc_id AND c.topic = t.topic")
def j09(spark, d):
    pairs = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id"), "doc_id").select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.lit("Q1"), F.lit("Q2"))).alias("topic"))
    counts = fx.passage_topics(spark, d).groupBy("document_id", "topic").agg(F.count("*").alias("n"))
    return pairs.join(counts, ["document_id", "topic"], "left").select(F.col("document_id").alias("doc_id"), "topic", F.coalesce("n", F.lit(0)).alias("n"))


@query("d07_detector_evaluation", fx.with_sql("passages") + ", x AS (SELECT type = 'sectionHeading' AS label, len(regexp_extract_all(content, '[^ \\t-\\r]+')) BETWEEN 1 AND 5 AS predicted, idx FROM passages), y AS (SELECT 'all' AS slice, * FROM x UNION ALL SELECT 'first', * FROM x WHERE idx = 0), c AS (SELECT slice, count(*) FILTER (WHERE label AND predicted) AS tp, count(*) FILTER (WHERE NOT label AND predicted) AS false_positives, count(*) FILTER (WHERE label AND NOT predicted) AS false_negatives FROM y GROUP BY 1) SELECT slice, round(coalesce(tp / nullif(tp + false_positives, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + false_negatives, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + false_positives + false_negatives, 0), 0), 6) AS f1, false_positives, false_negatives FROM c")
def d07(spark, d):
    words = F.regexp_count("content", F.lit(r"[^ \t-\r]+"))
    rows = fx.passages(spark, d).select("idx", (F.col("type") == "sectionHeading").alias("label"), words.between(1, 5).alias("predicted"))
    out = detectors.evaluation(rows, {"all": F.lit(True), "first": F.col("idx") == 0})
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("a24_feed_summary", "SELECT CAST(sum(n_chars) AS BIGINT) AS input, CAST(sum(n_chars) AS BIGINT) AS operation, CAST(sum(n_chars - CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(doc_id % 2) AS BIGINT) AS missing, CAST(sum(doc_id % 3) AS BIGINT) AS throttled, count(*) FILTER (WHERE doc_id % 10 = 0) AS failed_files, round(sum(doc_id % 3) / sum(n_chars), 6) AS throttle_rate FROM documents")
def a24(spark, d):
    codes = F.create_map(F.lit("404"), F.col("doc_id") % 2, F.lit("429"), F.col("doc_id") % 3)
    runs = fx.table(spark, d, "documents").select(F.col("n_chars").alias("input_count"), F.col("n_chars").alias("operation_count"), (F.col("n_chars") - F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).alias("ok_count"), codes.alias("code_counts"))
    return feeds.run_summary(runs).withColumn("throttle_rate", F.round("throttle_rate", 6))


@query("a25_failed_documents", "SELECT CAST(doc_id AS VARCHAR) AS feed_path, 'id:' || doc_id AS document_id, 'timeout of ' || lang AS error FROM documents WHERE doc_id % 4 = 0")
def a25(spark, d):
    line = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("feed: ok\nfeed: timeout of "), "lang", F.lit(" for put id:"), "doc_id", F.lit(": giving up\n"))).otherwise("feed: retry for put x\n")
    return feeds.failed_documents(fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("feed_path"), line.alias("log_text")))


@query("s11_event_range", "SELECT event_id FROM events WHERE ts >= (SELECT CAST(min(ts) AS DATE) FROM events) AND ts < DATE '2024-01-04'")
def s11(spark, d):
    return readers.events_between(fx.table(spark, d, "events"), date(2000, 1, 1), date(2024, 1, 3)).select("event_id")


@query("t09_identifier", "SELECT doc_id FROM documents WHERE lower('SRC-' || source) = lower('Src-SRC7')")
def t09(spark, d):
    ids = F.create_map(F.lit("case_number"), F.concat(F.lit("SRC-"), "source"))
    return fx.table(spark, d, "documents").where(F.lower(F.try_element_at(ids, F.lit("case_number"))) == "Src-SRC7".lower()).select("doc_id")


@query("t08_fieldset", "SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> ''), ' ') || ' ', ' erble ') OR source = 'src7'")
def t08(spark, d):
    return fx.table(spark, d, "documents").where(search.has_any(F.col("text"), ["erble"]) | (F.lower("source") == "src7")).select("doc_id")


@query("p20_highlighted", None)
def p20(spark, d):
    return analysis.matched_passages(fx.passages(spark, d), "content", ["thing", "erble"]).select(*KEYS, "content")


@query("f15_hash_sample", None)
def f15(spark, d):
    return fx.table(spark, d, "documents").where(filters.hash_sample(F.col("doc_id"), 20)).select("doc_id")


@query("p14_type_flags", None)
def p14(spark, d):
    return feeds.with_type_flags(fx.passages(spark, d)).drop("content")


