"""Registered queries for text search, ranking, corpus figures, as-of lookups and sinks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators import relevance, search, selection, tables, timeline
from corpusmill.sources import jsonl

from . import fixtures as fx
from .registry import query

#: Stated queries over the passages.
TERMS = [(1, "thble"), (1, "thing"), (2, "erble"), (2, "attion"), (3, "nicht")]
_Q = "q(query_id, term) AS (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in TERMS) + ")"
_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z]+'), lambda x: x <> '')"
KEYS = ["document_id", "idx"]


def _queries(spark):
    return spark.createDataFrame(TERMS, "query_id int, term string")


def _scored(spark, d):
    return search.bm25(fx.passages(spark, d), KEYS, "content", _queries(spark)).withColumn("score", F.round("score", 6))


_BM25 = fx.with_sql("passages") + f""", tok AS (SELECT document_id, idx, {_WORDS.format('content')} AS t FROM passages), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM tok), {_Q},
    po AS (SELECT document_id, idx, term, l, count(*) AS tf FROM (SELECT document_id, idx, len(t) AS l, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    fr AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
    s AS (SELECT query_id, document_id, idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.4 + 0.4 * l / a))), 6) AS score FROM po JOIN fr USING (term) JOIN q USING (term), st GROUP BY ALL),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, idx) AS INTEGER) AS rank FROM s),
    b0 AS (SELECT query_id, document_id, idx, sum(tf) AS n FROM po JOIN q USING (term) GROUP BY ALL),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, document_id, idx) AS rank FROM b0)"""


@query("r01_bm25", _BM25 + " SELECT query_id, document_id, idx, score FROM s")
def r01_bm25(spark, d):
    return _scored(spark, d)


@query("n08_top_passages", _BM25 + " SELECT query_id, document_id, idx, score, rank FROM k WHERE rank <= 10")
def n08_top_passages(spark, d):
    return search.top(_scored(spark, d), KEYS, 10)


@query("r04_penalised", _BM25 + " SELECT query_id, document_id, idx, round(score - CASE WHEN type = 'sectionHeading' THEN 0.15 ELSE 0 END, 6) AS score FROM s JOIN passages USING (document_id, idx)")
def r04_penalised(spark, d):
    flags = fx.passages(spark, d).select(*KEYS, (F.col("type") == "sectionHeading").alias("heading"))
    return _scored(spark, d).join(flags, KEYS).select("query_id", *KEYS, F.round(F.col("score") - 0.15 * F.col("heading").cast("double"), 6).alias("score"))


@query("r11_completeness", f"""WITH t AS (SELECT doc_id, list_distinct({_WORDS.format('text')}) AS t FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, len(t) AS n, len(list_intersect(t, ['thble', 'thing'])) AS m FROM t)
    SELECT doc_id, round(m / nullif(n, 0), 6) AS field_share, round(m / 2, 6) AS query_share FROM u""")
def r11_completeness(spark, d):
    field, asked = search.completeness(F.col("text"), F.array(F.lit("thble"), F.lit("thing")))
    return fx.table(spark, d, "documents").where("text is not null").select("doc_id", F.round(field, 6).alias("field_share"), F.round(asked, 6).alias("query_share"))


@query("t12_word_tests", f"""WITH t AS (SELECT doc_id, {_WORDS.format('text')} AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, list_has_all(t, ['thble', 'thing']) AS all_words, list_has_any(t, ['thble', 'thing']) AS any_word, contains(' ' || array_to_string(t, ' ') || ' ', ' thing thble ') AS phrase FROM t""")
def t12_word_tests(spark, d):
    words, c = ["thble", "thing"], F.col("text")
    return fx.table(spark, d, "documents").where("text is not null").select("doc_id", search.has_all(c, words).alias("all_words"), search.has_any(c, words).alias("any_word"), search.has_phrase(c, "thing thble").alias("phrase"))


@query("p02_strip_controls", r"SELECT doc_id, length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS n FROM documents")
def p02_strip_controls(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.length(search.strip_controls(F.col("text"))).cast("long").alias("n"))


@query("q05_overlap", _BM25 + ", b AS (SELECT k.query_id, count(*) AS both_n FROM k JOIN c USING (query_id, document_id, idx) WHERE k.rank <= 10 AND c.rank <= 10 GROUP BY 1), m AS (SELECT query_id, least(count(*), 10) AS n FROM k GROUP BY 1) SELECT query_id, round(coalesce(both_n, 0) / n, 6) AS overlap FROM m LEFT JOIN b USING (query_id)")
def q05_overlap(spark, d):
    words = fx.passages(spark, d).select(*KEYS, F.explode(search.tokens(F.col("content"))).alias("term"))
    counted = words.join(F.broadcast(_queries(spark)), "term").groupBy("query_id", *KEYS).agg(F.count("*").alias("score"))
    return search.overlap(search.top(_scored(spark, d), KEYS, 10), search.top(counted, KEYS, 10), KEYS).withColumn("overlap", F.round("overlap", 6))


@query("q07_short_ids", "SELECT doc_id, substr(sha256(coalesce(source, '') || coalesce(lang, '')), 1, 8) AS short_id FROM documents")
def q07_short_ids(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))), 256), 1, 8).alias("short_id"))


_COUNTS = fx.with_sql("passages", "passage_topics")


@query("a13_shape", "SELECT min(n_chars) AS least, max(n_chars) AS most, CAST(median(n_chars) AS DOUBLE) AS middle, count(*) FILTER (WHERE n_chars > 1000) AS n_long FROM documents")
def a13_shape(spark, d):
    return fx.table(spark, d, "documents").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.median("n_chars").alias("middle"), F.count_if(F.col("n_chars") > 1000).alias("n_long"))


@query("a14_topic_shares", _COUNTS + ", n AS (SELECT document_id, count(*) AS total FROM passages GROUP BY 1) SELECT document_id, topic, count(DISTINCT idx) AS n_passages, round(count(DISTINCT idx) / any_value(total), 6) AS share FROM passage_topics JOIN n USING (document_id) GROUP BY ALL")
def a14_topic_shares(spark, d):
    total = fx.passages(spark, d).groupBy("document_id").agg(F.count("*").alias("total"))
    found = fx.passage_topics(spark, d).groupBy("document_id", "topic").agg(F.count_distinct("idx").alias("n_passages"))
    return found.join(total, "document_id").select("document_id", "topic", "n_passages", F.round(F.try_divide("n_passages", "total"), 6).alias("share"))


@query("a15_page_sizes", fx.with_sql("passages") + "SELECT document_id, page_number, count(*) AS n FROM passages GROUP BY ALL")
def a15_page_sizes(spark, d):
    return fx.passages(spark, d).groupBy("document_id", "page_number").agg(F.count("*").alias("n"))


@query("a16_corpus_frequencies", _COUNTS + "SELECT topic, count(*) AS collection_frequency, count(DISTINCT document_id) AS document_frequency, (SELECT count(*) FROM passages) AS n_passages, (SELECT count(DISTINCT document_id) FROM passages) AS n_documents FROM passage_topics GROUP BY 1")
def a16_corpus_frequencies(spark, d):
    totals = fx.passages(spark, d).agg(F.count("*").alias("n_passages"), F.count_distinct("document_id").alias("n_documents"))  # one row
    found = fx.passage_topics(spark, d).groupBy("topic").agg(F.count("*").alias("collection_frequency"), F.count_distinct("document_id").alias("document_frequency"))
    return found.join(F.broadcast(totals))


@query("n03_percent_ranks", _COUNTS + ", m AS (SELECT document_id, topic, count(*) AS mentions FROM passage_topics GROUP BY ALL) SELECT document_id, topic, round(percent_rank() OVER (PARTITION BY topic ORDER BY mentions), 6) AS share FROM m")
def n03_percent_ranks(spark, d):
    counts = fx.passage_topics(spark, d).groupBy("document_id", "topic").agg(F.count("*").alias("mentions"))
    return selection.percent_ranks(counts, "topic", "mentions", "share").select("document_id", "topic", F.round("share", 6).alias("share"))


@query("e03_positions", _COUNTS + ", n AS (SELECT document_id, count(*) AS total FROM passages GROUP BY 1) SELECT document_id, topic, count(*) FILTER (WHERE page_number < 3) AS first_pages, count(*) FILTER (WHERE 5 * idx < total) AS first_fifth, min(page_number) AS earliest_page FROM passage_topics JOIN n USING (document_id) GROUP BY ALL")
def e03_positions(spark, d):
    total = fx.passages(spark, d).groupBy("document_id").agg(F.count("*").alias("total"))
    return fx.passage_topics(spark, d).join(total, "document_id").groupBy("document_id", "topic").agg(F.count_if(F.col("page_number") < 3).alias("first_pages"), F.count_if(5 * F.col("idx") < F.col("total")).alias("first_fifth"), F.min("page_number").alias("earliest_page"))


@query("e06_combined_classes", _COUNTS + ", m AS (SELECT document_id, topic, count(*) AS n, min(page_number) AS p FROM passage_topics GROUP BY ALL), c AS (SELECT *, CASE WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END AS a, CASE WHEN p <= 0 THEN 2 WHEN p <= 2 THEN 1 ELSE 0 END AS b FROM m) SELECT document_id, topic, least(a, b) AS both_class, greatest(a, b) AS either_class FROM c")
def e06_combined_classes(spark, d):
    m = fx.passage_topics(spark, d).groupBy("document_id", "topic").agg(F.count("*").alias("n"), F.min("page_number").alias("p"))
    a, b = relevance.threshold_class(F.col("n"), 2, 4), F.when(F.col("p") <= 0, 2).when(F.col("p") <= 2, 1).otherwise(0)
    return m.select("document_id", "topic", F.least(a, b).alias("both_class"), F.greatest(a, b).alias("either_class"))


@query("e08_candidates", _COUNTS + ", m AS (SELECT count(*) AS n FROM passage_topics GROUP BY document_id, topic) SELECT DISTINCT round(unnest(quantile_cont(CAST(n AS DOUBLE), [0.1, 0.25, 0.5, 0.75, 0.9])), 6) AS threshold FROM m")
def e08_candidates(spark, d):
    counts = fx.passage_topics(spark, d).groupBy("document_id", "topic").agg(F.count("*").alias("n"))
    found = counts.agg(F.percentile("n", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("q"))
    return found.select(F.explode("q").alias("q")).select(F.round("q", 6).alias("threshold")).distinct()


@query("j03_heading_text", fx.with_sql("passages") + ", s AS (SELECT *, sum(CASE WHEN type = 'sectionHeading' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS sid FROM passages) SELECT a.document_id, a.idx, b.content AS heading FROM s a LEFT JOIN s b ON a.document_id = b.document_id AND a.sid = b.sid AND b.type = 'sectionHeading'")
def j03_heading_text(spark, d):
    up_to = W.partitionBy("document_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    heading = F.last(F.when(F.col("type") == "sectionHeading", F.col("content")), ignorenulls=True).over(up_to)
    return fx.passages(spark, d).select(*KEYS, heading.alias("heading"))


@query("j14_next_document_page", fx.with_sql("web_events") + "SELECT event_id, (SELECT min(ts) FROM web_events e WHERE e.distinct_id = c.distinct_id AND e.url LIKE '/document/%' AND e.event = '$pageview' AND e.ts > c.ts) AS next_ts FROM web_events c WHERE url LIKE '/search%'")
def j14_next_document_page(spark, d):
    found = timeline.next_after(fx.web_events(spark, d), F.col("url").like("/document/%") & (F.col("event") == "$pageview"))
    return found.where(F.col("url").like("/search%")).select("event_id", "next_ts")


@query("j15_last_search", fx.with_sql("web_events") + "SELECT event_id, (SELECT max(ts) FROM web_events e WHERE e.distinct_id = c.distinct_id AND e.url LIKE '/search%' AND e.ts <= c.ts) AS last_ts FROM web_events c")
def j15_last_search(spark, d):
    return timeline.last_until(fx.web_events(spark, d), F.col("url").like("/search%")).select("event_id", "last_ts")


@query("j10_consenting_events", fx.with_sql("web_events") + "SELECT event, count(*) AS n FROM web_events WHERE distinct_id IN (SELECT distinct_id FROM web_events WHERE consent AND host IN (1, 2)) GROUP BY 1")
def j10_consenting_events(spark, d):
    e = fx.web_events(spark, d)
    users = e.where(F.col("consent") & F.col("host").isin(1, 2)).select("distinct_id").distinct()
    return e.join(users, "distinct_id", "left_semi").groupBy("event").agg(F.count("*").alias("n"))


@query("j11_unlabelled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND n_chars BETWEEN 200 AND 2000")
def j11_unlabelled(spark, d):
    docs = fx.table(spark, d, "documents").where(F.col("n_chars").between(200, 2000)).select("doc_id")
    return docs.join(fx.table(spark, d, "labels"), "doc_id", "left_anti")


@query("n01_event_rows", fx.with_sql("web_events") + "SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(floor(epoch(lead(ts) OVER w)) - floor(epoch(ts)) AS BIGINT) AS dwell FROM web_events WINDOW w AS (PARTITION BY distinct_id ORDER BY ts, event_id)")
def n01_event_rows(spark, d):
    w = W.partitionBy("distinct_id").orderBy("ts", "event_id")
    return fx.web_events(spark, d).select("event_id", F.row_number().over(w).alias("rn"), (F.unix_seconds(F.lead("ts").over(w).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))).alias("dwell"))


@query("x05_lookup", "SELECT doc_id, source, lang FROM documents WHERE doc_id = 42")
def x05_lookup(spark, d):
    return fx.table(spark, d, "documents").where("doc_id = 42").select("doc_id", "source", "lang")


@query("w01_update_lines", "SELECT doc_id AS id, source AS assigned FROM documents WHERE doc_id IS NOT NULL")
def w01_update_lines(spark, d):
    path = tables.shared_folder(spark, "updates")
    jsonl.write_updates(fx.table(spark, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), F.col("source").alias("assigned")), path, compressed=True)
    return jsonl.read_lines(spark, path, "id long, assigned string")
