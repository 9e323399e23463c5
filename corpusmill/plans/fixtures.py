"""Logical tables of the search and analytics workloads, projected from the given tables.

The same projections are written for DuckDB in ``SQL``, so that queries and their equivalents start alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lexicon words and the topics that they mention. Fixed values of the projection.
LEXICON = {"thble": "Q1", "thing": "Q2", "thtion": "Q3", "erble": "Q4", "attion": "Q5", "nicht": "Q6", "thanea": "Q7", "oning": "Q8"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels array<struct<id, type, value, relationship>>, typed attribute maps and published."""
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality", "toxic")

    def label(kind: str, value, relationship: str):
        v = value.cast("string")
        return F.when(v.isNotNull(), F.struct(F.concat(F.lit(f"{kind}::"), v).alias("id"), F.lit(kind).alias("type"), v.alias("value"), F.lit(relationship).alias("relationship")))

    labels = F.array(label("agent", F.col("source"), "provider"), label("language", F.col("lang"), "tagged"), label("quality", F.col("quality"), "tagged"), label("toxic", F.col("toxic"), "tagged"), F.when(F.col("doc_id") % 5 == 0, F.struct(F.lit("status::Principal").alias("id"), F.lit("status").alias("type"), F.lit("Principal").alias("value"), F.lit("tagged").alias("relationship"))))
    return d.join(q, d.doc_id == q._id, "left").select(
        "doc_id", "text", "lang", "source", "n_chars",
        F.filter(labels, lambda x: x.isNotNull()).alias("labels"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("attributes_string"),
        F.create_map(F.lit("n_chars"), F.col("n_chars").cast("double")).alias("attributes_double"),
        F.create_map(F.lit("long"), (F.col("n_chars") > 1000).cast("int")).alias("attributes_boolean"),
        F.when(F.col("doc_id") % 7 != 0, F.lit(1704067200) + F.col("doc_id") * 3600).alias("published"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("idx", "content"))
    heading = (F.length("content") < 40) & ~F.substring(F.col("content"), 1, 1000).rlike("[.].")
    return p.select("document_id", "idx", (F.col("idx") / 5).cast("int").alias("page_number"), F.when(heading, "sectionHeading").otherwise("Text").alias("type"), "content")


def passage_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each occurrence of a lexicon word."""
    lexicon = F.create_map(*(F.lit(x) for kv in LEXICON.items() for x in kv))
    words = passages(spark, sf_dir).select("document_id", "idx", "page_number", F.explode(F.split(F.lower("content"), "[^a-z]+")).alias("word"))
    return words.withColumn("topic", F.try_element_at(lexicon, F.col("word"))).where("topic is not null").drop("word")


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    url = F.when(F.col("k") < 30, F.lit("/search")).when(F.col("k") < 60, F.concat(F.lit("/document/"), F.col("k"))).otherwise(F.concat(F.lit("/documents/"), F.col("k")))
    return e.select(
        "event_id", "ts", F.col("user_id").alias("distinct_id"), "k", "value", url.alias("url"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "$pageview").when(F.col("event_type") == "error", "$autocapture").otherwise(F.col("event_type")).alias("event"),
        F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("session_id"),
        F.when(F.col("user_id") % 10 != 9, F.col("user_id") % 4 != 0).alias("consent"), (F.col("user_id") % 4).alias("host"), (F.col("k") % 5).alias("hits"),
    )


SQL = {
    "labels": """doc_labels AS (SELECT d.doc_id, u.* FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id, LATERAL (SELECT * FROM (VALUES
        ('agent::' || d.source, 'agent', d.source, 'provider'), ('language::' || d.lang, 'language', d.lang, 'tagged'),
        ('quality::' || CAST(l.quality AS VARCHAR), 'quality', CAST(l.quality AS VARCHAR), 'tagged'), ('toxic::' || CAST(l.toxic AS VARCHAR), 'toxic', CAST(l.toxic AS VARCHAR), 'tagged'),
        (CASE WHEN d.doc_id % 5 = 0 THEN 'status::Principal' END, 'status', 'Principal', 'tagged')) v(id, type, value, relationship) WHERE v.id IS NOT NULL) u)""",
    "passages": r"""passages AS (SELECT document_id, CAST(i - 1 AS INTEGER) AS idx, CAST((i - 1) // 5 AS INTEGER) AS page_number, parts[i] AS content,
        CASE WHEN length(parts[i]) < 40 AND NOT regexp_matches(parts[i], '[.].') THEN 'sectionHeading' ELSE 'Text' END AS type
        FROM (SELECT doc_id AS document_id, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))""",
    "passage_topics": "passage_topics AS (SELECT document_id, idx, page_number, topic FROM (SELECT document_id, idx, page_number, unnest(regexp_split_to_array(lower(content), '[^a-z]+')) AS word FROM passages) JOIN (VALUES "
    + ", ".join(f"('{w}', '{t}')" for w, t in LEXICON.items())
    + ") x(w, topic) ON w = word)",
    "web_events": """web_events AS (SELECT event_id, ts, user_id AS distinct_id, k, value, CASE WHEN k < 30 THEN '/search' WHEN k < 60 THEN '/document/' || k ELSE '/documents/' || k END AS url,
        CASE WHEN event_type IN ('view', 'click', 'signup') THEN '$pageview' WHEN event_type = 'error' THEN '$autocapture' ELSE event_type END AS event,
        user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, CASE WHEN user_id % 10 <> 9 THEN user_id % 4 <> 0 END AS consent, user_id % 4 AS host, k % 5 AS hits
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
