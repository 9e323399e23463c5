"""Registered queries of folded patches, counters with resets, nested files and update records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators import counters, detectors, documents, feeds, labels, relevance, tables, updates
from corpusmill.sources import jsonl, nested

from . import fixtures as fx
from .registry import query


@query(
    "w04_folded_patches",
    fx.with_sql("web_events")
    + """, p AS (SELECT k * 7 + distinct_id % 50 AS doc_id, event_id AS seq, k, event = 'purchase' AS make FROM web_events),
    c AS (SELECT doc_id, min(CASE WHEN make THEN seq END) AS created, max(CASE WHEN k % 3 = 0 THEN seq END) AS la, max(CASE WHEN k % 5 IN (0, 1) THEN seq END) AS sa FROM p GROUP BY 1)
    SELECT coalesce(d.doc_id, c.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL AND la IS NULL THEN d.lang WHEN d.doc_id IS NOT NULL OR la >= created THEN 'L' || l.k END AS lang,
      CASE WHEN d.doc_id IS NOT NULL AND sa IS NULL THEN d.source WHEN (d.doc_id IS NOT NULL OR sa >= created) AND s.k % 5 = 1 THEN 'S' || s.k END AS source
    FROM documents d FULL JOIN c ON c.doc_id = d.doc_id LEFT JOIN p l ON l.seq = la LEFT JOIN p s ON s.seq = sa WHERE d.doc_id IS NOT NULL OR created IS NOT NULL""",
)
def w04_folded(spark, d):
    """A log of patches, many to a key, folded in their order; some may make rows."""
    base = fx.table(spark, d, "documents").select("doc_id", "lang", "source")
    k = F.col("k")
    lang = F.when(k % 3 == 0, F.struct(F.concat(F.lit("L"), k).alias("assign")))
    source = F.when(k % 5 == 0, F.struct(F.lit(None).cast("string").alias("assign"))).when(k % 5 == 1, F.struct(F.concat(F.lit("S"), k).alias("assign")))
    log = fx.web_events(spark, d).select((k * 7 + F.col("distinct_id") % 50).cast("long").alias("doc_id"), F.col("event_id").alias("at"), (F.col("event") == "purchase").alias("make"), lang.alias("lang"), source.alias("source"))
    return updates.apply_folds(base, updates.fold(log, "doc_id", "at", F.col("make")), "doc_id")


_LE = (20.0, 60.0, 150.0, 400.0, 1000.0)
_SAMPLES = fx.with_sql("web_events") + f""", m AS (SELECT host, le, date_trunc('minute', ts) AS ts, ts >= TIMESTAMP '2024-01-03' AS later, count(*) FILTER (WHERE value <= le) AS n FROM web_events, (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in _LE)}) v(le) GROUP BY ALL),
    s AS (SELECT host, le, ts, sum(n) OVER (PARTITION BY host, le, later ORDER BY ts) AS c FROM m),
    i AS (SELECT host, le, ts, lag(c) OVER (PARTITION BY host, le ORDER BY ts) AS p, c FROM s),
    g AS (SELECT host, le, ts, CASE WHEN c >= p THEN c - p ELSE c END AS up FROM i WHERE p IS NOT NULL)"""
_QUANTILES = """, r2 AS (SELECT * REPLACE (max(c) OVER (PARTITION BY host, w ORDER BY le) AS c) FROM r), b AS (SELECT *, coalesce(lag(le) OVER o, 0) AS below, coalesce(lag(c) OVER o, 0) AS before, max(c) OVER (PARTITION BY host, w) AS a FROM r2 WINDOW o AS (PARTITION BY host, w ORDER BY le))
    SELECT host, w AS "window", """ + ", ".join(f"CAST(round(min(CASE WHEN c >= {q} * a AND before < {q} * a THEN below + (le - below) * ({q} * a - before) / nullif(c - before, 0) END), 6) AS DOUBLE) AS q{round(100 * q)}" for q in (0.5, 0.95, 0.99)) + " FROM b GROUP BY ALL"


def _histograms(spark, d):
    """Samples by minute of cumulative buckets, whose counters start anew in the middle of the log."""
    bound = F.explode(F.array(*map(F.lit, _LE))).alias("le")
    e = fx.web_events(spark, d).select("host", "value", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), (F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz")).alias("later"), bound)
    minutes = e.groupBy("host", "le", "ts", "later").agg(F.count_if(F.col("value") <= F.col("le")).alias("n"))
    return minutes.withColumn("count", F.sum("n").over(W.partitionBy("host", "le", "later").orderBy("ts"))).select("host", "le", "ts", "count")


@query("a29_rates_with_resets", _SAMPLES + ", r AS (SELECT host, le, time_bucket(INTERVAL 3 HOUR, ts) AS w, sum(up) / 10800.0 AS c FROM g GROUP BY ALL)" + _QUANTILES)
def a29_rates(spark, d):
    out = counters.histogram_quantiles(_histograms(spark, d), ["host"], [0.5, 0.95, 0.99], window="3 hours")
    return out.select("host", F.col("window").cast("timestamp_ntz").alias("window"), *(F.round(c, 6).alias(c) for c in ("q50", "q95", "q99")))


@query("a29_five_minutes_each_hour", _SAMPLES + ", r AS (SELECT host, le, time_bucket(INTERVAL 5 MINUTE, ts) AS w, sum(up) / 300.0 AS c FROM g WHERE date_part('minute', ts) >= 55 GROUP BY ALL)" + _QUANTILES)
def a29_each_hour(spark, d):
    """The five minutes before each full hour."""
    out = counters.histogram_quantiles(_histograms(spark, d), ["host"], [0.5, 0.95, 0.99], step="1 hour")
    return out.select("host", F.col("window").cast("timestamp_ntz").alias("window"), *(F.round(c, 6).alias(c) for c in ("q50", "q95", "q99")))


@query("s04_ordered_groups", fx.with_sql("passages") + "SELECT document_id, count(*) AS n, md5(string_agg(idx || ':' || page_number || ':' || content, '|' ORDER BY idx)) AS blocks FROM passages WHERE length(content) > 20 GROUP BY 1")
def s04_groups(spark, d):
    """Passages written as a nested file, read by the asked members only, and grouped into ordered arrays."""
    path = tables.shared_folder(spark, "blocks")
    block = F.struct("idx", F.when(F.length("content") > 20, F.col("content")).alias("text"), "type", "page_number", F.lit("en").alias("language")).alias("text_block")
    fx.passages(spark, d).select("document_id", block).write.parquet(path)
    groups = nested.ordered_groups(nested.members(spark.read.parquet(path), "text_block", ["idx", "page_number", "text"], ["document_id"], required=["text"]), "document_id", "idx")
    line = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["idx"], r["page_number"], r["text"])), "|")
    return groups.select("document_id", F.size("rows").cast("long").alias("n"), F.md5(line.cast("binary")).alias("blocks"))


@query("s12_dotted_rows", "SELECT doc_id AS original_document_id, coalesce(string_split(text, chr(10))[1], '') AS title, 'http://' || source AS source_url, CASE WHEN doc_id % 2 = 0 THEN lang END AS description FROM documents")
def s12_rows(spark, d):
    """Rows flattened to dotted names, made into documents again."""
    flat = fx.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce(F.get(F.split("text", "\n"), 0), F.lit("")).alias("document_metadata.document_title"), F.concat(F.lit("http://"), "source").alias("document_metadata.source_url"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("document_metadata.description"))
    whole = nested.from_dotted(flat)
    assert [f.name for f in whole.schema["document_metadata"].dataType] == ["document_title", "source_url", "description"]
    return nested.document_rows(flat).select("original_document_id", "title", "source_url", "description")


@query("w01_envelopes", "SELECT 'id:documents::' || doc_id AS key, source, lang, lang IS NULL AS cleared, 2 AS copies FROM documents WHERE doc_id IS NOT NULL")
def w01_envelopes(spark, d):
    """Update records written as lines and as gzip lines, read again."""
    rows = fx.table(spark, d, "documents").where("doc_id is not null").select("doc_id", "source", "lang")
    path, zipped = (tables.shared_folder(spark, n) for n in ("records", "records-gz"))
    records = jsonl.update_records(rows, F.concat(F.lit("id:documents::"), "doc_id"), ["source", "lang"], create=True)
    jsonl.write_both(records, path, zipped)
    back = jsonl.read_records(spark, path, "source string, lang string").withColumn("n", F.lit(1)).unionByName(jsonl.read_records(spark, zipped, "source string, lang string").withColumn("n", F.lit(1)))
    flat = back.select(F.col("update").alias("key"), F.col("fields.source.assign").alias("source"), F.col("fields.lang.assign").alias("lang"), (F.col("fields.lang").isNotNull() & F.col("fields.lang.assign").isNull()).alias("cleared"), "n")
    return flat.groupBy("key", "source", "lang").agg(F.bool_and("cleared").alias("cleared"), F.sum("n").cast("int").alias("copies"))


@query("p14_record_flags", None)
def p14_records(spark, d):
    """The detectors' flags on update records, contents listings from content and pages among them."""
    page = F.array(F.struct(F.col("page_number").alias("number")))
    fields = F.struct(F.struct(F.col("content").alias("assign")).alias("content"), F.struct(page.alias("assign")).alias("pages"))
    records = fx.passages(spark, d).select(F.concat_ws("-", "document_id", "idx").alias("update"), fields.alias("fields"))
    flags = feeds.with_record_flags(records)
    return flags.select("update", *(F.col(f"fields.{c}.assign").alias(c) for c in feeds.RECORD_FLAGS))


@query(
    "d07_detectors_by_stratum",
    fx.with_sql("passages")
    + r""", x AS (SELECT CASE WHEN page_number = 0 THEN 'front' WHEN page_number < 3 THEN 'early' ELSE 'late' END AS stratum, type = 'sectionHeading' AS label,
      len(regexp_extract_all(content, '[^ \t-\r]+')) BETWEEN 1 AND 11 AND len(regexp_extract_all(content, '[A-Za-z]')) > 0 AND 10 * len(regexp_extract_all(content, '[A-Z]')) >= 9 * len(regexp_extract_all(content, '[A-Za-z]')) AS heading,
      contains(content, '?') AND (contains(lower(content), ' tak no') OR contains(lower(content), ' yes no') OR contains(lower(content), ' no yes') OR contains(lower(content), 'yes/no') OR contains(lower(content), 'not applicable') OR contains(lower(content), ' n/a') OR contains(lower(content), ' nie tak') OR contains(lower(content), ' oui non')) AS questionnaire FROM passages),
    y AS (SELECT stratum, label, 'short_heading' AS detector, heading AS said FROM x UNION ALL SELECT stratum, label, 'questionnaire', questionnaire FROM x),
    z AS (SELECT 'all rows' AS slice, * FROM y UNION ALL SELECT 'stratum ' || stratum, * FROM y),
    c AS (SELECT detector, slice, count(*) AS n, count(*) FILTER (WHERE label AND said) AS tp, count(*) FILTER (WHERE said AND NOT label) AS fp, count(*) FILTER (WHERE label AND NOT said) AS fn FROM z GROUP BY ALL)
    SELECT detector, slice, n, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, CAST(round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS DOUBLE) AS f1, fp AS false_positives, fn AS false_negatives FROM c""",
)
def d07_by_stratum(spark, d):
    """The detectors themselves, over all rows and each stratum."""
    page = F.col("page_number")
    rows = fx.passages(spark, d).select("content", (F.col("type") == "sectionHeading").alias("label"), F.when(page == 0, "front").when(page < 3, "early").otherwise("late").alias("stratum"))
    out = detectors.evaluated(rows, {"short_heading": feeds.heading_by_content(F.col("content")), "questionnaire": feeds.derive.questionnaire(F.col("content"))})
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("a01_counts_with_names", fx.with_sql("passages", "passage_topics") + "SELECT document_id, topic AS concept_id, count(*) AS mentions, arg_max('name of ' || topic || ' in ' || idx, idx) AS name, string_agg(CAST(idx AS VARCHAR), '::' ORDER BY idx) AS passage_ids FROM passage_topics GROUP BY ALL")
def a01_names(spark, d):
    named = fx.passage_topics(spark, d).select("document_id", F.col("topic").alias("concept_id"), F.concat(F.lit("name of "), "topic", F.lit(" in "), "idx").alias("name"), "idx", F.col("idx").alias("passage_id"))
    return documents.concept_counts(named, ["document_id"], ["idx"])


@query("a06_concepts_override", "SELECT id, value, 'concept' AS kind FROM (SELECT source AS id, max(doc_id) AS value FROM documents WHERE lang = 'en' AND source IS NOT NULL GROUP BY 1) UNION ALL SELECT source, max(doc_id), 'label' FROM documents WHERE source IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE lang = 'en') = 0")
def a06_precedence(spark, d):
    docs = fx.table(spark, d, "documents").where("source is not null")
    of = lambda kind: (F.col("source").alias("id"), F.col("doc_id").alias("value"), F.lit(kind).alias("kind"))
    return labels.deduplicated(docs.select(*of("label")), docs.where("lang = 'en'").select(*of("concept")), "id", ["value"])


@query("p05_several_principals", "SELECT doc_id, doc_id - doc_id % 2 <> doc_id - doc_id % 3 AS several FROM documents")
def p05_several(spark, d):
    """Edges to the numbers' multiples of 2 and 3 below, as candidates."""
    n = F.col("doc_id")
    edge = lambda k, t: F.struct(F.lit(k).alias("type"), t.cast("string").alias("value"))
    edges = F.array(edge("member_of", n - n % 2), edge("is_version_of", n - n % 3), edge("other", n))
    return fx.table(spark, d, "documents").select("doc_id", documents.several_principals(edges).alias("several"))


@query("a14_shares_of_named_topics", fx.with_sql("passages", "passage_topics") + ", n AS (SELECT document_id, count(*) AS total FROM passages GROUP BY 1) SELECT document_id, lower(topic) AS topic, count(DISTINCT idx) AS n_passages, round(count(DISTINCT idx) / any_value(total), 6) AS share FROM passage_topics JOIN n USING (document_id) GROUP BY ALL")
def a14_named(spark, d):
    name = F.when(F.col("idx") % 2 == 0, F.concat(F.lit(" "), "topic")).otherwise(F.concat(F.lower("topic"), F.lit("  ")))
    out = relevance.topic_shares(fx.passage_topics(spark, d).withColumn("topic", name), fx.passages(spark, d))
    return out.withColumn("share", F.round("share", 6))


@query("a15_page_and_section_sizes", fx.with_sql("passages") + ", s AS (SELECT *, CAST(sum(CASE WHEN type = 'sectionHeading' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_id FROM passages) SELECT document_id, 'page' AS kind, CAST(page_number AS BIGINT) AS part, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT document_id, 'section', section_id, count(*) FROM s GROUP BY ALL")
def a15_sizes(spark, d):
    return relevance.sizes(fx.passages(spark, d))


@query(
    "s07_derived_records",
    fx.with_sql("passages", "passage_topics")
    + r""", t AS (SELECT document_id, idx, count(*) AS n, string_agg(DISTINCT 'concept::' || topic, ',' ORDER BY 'concept::' || topic) AS ids FROM passage_topics GROUP BY ALL)
    SELECT document_id || '-' || idx AS key, 'id:documents:documents::' || document_id AS document_ref, CASE WHEN idx % 2 = 1 AND content <> '' THEN 'Part ' || idx END AS heading_text, coalesce(n, 0) AS labels, coalesce(ids, '') AS concepts,
      len(regexp_extract_all(content, '[^ 	-
]+')) BETWEEN 1 AND 11 AND len(regexp_extract_all(content, '[A-Za-z]')) > 0 AND 10 * len(regexp_extract_all(content, '[A-Z]')) >= 9 * len(regexp_extract_all(content, '[A-Za-z]')) AS heading
    FROM passages LEFT JOIN t USING (document_id, idx)""",
)
def s07_derived(spark, d):
    """Exported update records of passages, written as lines, read and completed."""
    topic = F.struct(F.col("topic").alias("concept_id"), F.array(F.concat(F.lit('Classifier("'), "topic", F.lit('")'))).alias("labellers"))
    topics = fx.passage_topics(spark, d).groupBy("document_id", "idx").agg(F.collect_list(topic).alias("topics"))
    serialised = F.when(F.col("idx") % 2 == 1, F.concat(F.lit(feeds.SECTION), F.lit("Part "), "idx", F.lit("'. "), "content")).otherwise(F.col("content"))
    rows = fx.passages(spark, d).join(topics, ["document_id", "idx"], "left").withColumns({"key": F.concat_ws("-", "document_id", "idx"), "document_id": F.col("document_id").cast("string"), "serialised_text": serialised, "pages": F.array(F.struct(F.col("page_number").alias("number"))), "topics": F.coalesce("topics", F.array())})
    path = tables.shared_folder(spark, "exported")
    jsonl.write_updates(jsonl.update_records(rows, F.col("key"), ["document_id", "content", "serialised_text", "pages", "topics"]), path)
    done = feeds.derived(jsonl.read_records(spark, path, jsonl.PASSAGE_FIELDS)).select("update", "fields.*")
    return done.select(F.col("update").alias("key"), F.col("document_ref.assign").alias("document_ref"), F.col("heading_text.assign").alias("heading_text"), F.size("labels.assign").cast("long").alias("labels"), F.array_join(F.array_sort(F.map_keys("concept_counts.assign")), ",").alias("concepts"), F.col("looks_like_short_heading.assign").alias("heading"))
