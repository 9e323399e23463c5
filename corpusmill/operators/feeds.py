"""Partial-update records of passages: derived fields, and reports of feed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import derive, detectors, documents


def labels_from_topics(records: DataFrame) -> DataFrame:
    """Update records (fields.topics.assign) with labels and concept_counts in place of topics."""
    parsed = lambda t: derive.parsed_value(t["labellers"][0])
    names = ("classifier_id", "end_index", "labelled_text", "labellers", "prediction_probability", "start_index", "timestamps")
    topics = F.coalesce(F.col("fields.topics.assign"), F.from_json(F.lit("[]"), records.schema["fields"].dataType["topics"].dataType["assign"].dataType))
    labels = F.transform(topics, lambda t: F.struct(F.concat(F.lit("concept::"), t["concept_id"]).alias("id"), F.lit("concept").alias("type"), parsed(t).alias("value"), *(t[n].alias(n) for n in names)))
    ids = F.transform(labels, lambda x: x["id"])
    counts = F.map_from_entries(F.transform(F.array_distinct(ids), lambda i: F.struct(i.alias("key"), F.size(F.filter(ids, lambda x: x == i)).alias("value"))))
    fields = F.col("fields").dropFields("topics").withField("labels", F.struct(labels.alias("assign"))).withField("concept_counts", F.struct(counts.alias("assign")))
    return records.withColumn("fields", fields)


def with_type_flags(passages: DataFrame, content: str = "content", kind: str = "type") -> DataFrame:
    """Adds the detectors' flags."""
    return passages.withColumns({"looks_like_short_heading": derive.short_heading(F.col(content), F.col(kind)), "looks_like_reference_list": detectors.reference_list(F.col(content)), "looks_like_questionnaire": derive.questionnaire(F.col(content))})


#: The flags of an update record.
RECORD_FLAGS = ["looks_like_short_heading", "looks_like_table_of_contents", "looks_like_reference_list"]


def heading_by_content(content: Column) -> Column:
    """A short heading as its content alone tells; records do not carry a type."""
    return derive.short_heading(content, F.lit(""))


def with_record_flags(records: DataFrame) -> DataFrame:
    """Update records (fields.content.assign, fields.pages.assign with numbers) with the detectors' flags among their
    fields. Contents listings are told from the content and its first page; without pages the page has no say."""
    rows = records.withColumns({"_content": F.coalesce("fields.content.assign", F.lit("")), "_page": F.array_min(F.transform("fields.pages.assign", lambda p: p["number"]))})
    rows = detectors.contents_listings(rows, "_content", "_page")
    flags = {"looks_like_short_heading": heading_by_content(F.col("_content")), "looks_like_table_of_contents": F.col("looks_like_table_of_contents"), "looks_like_reference_list": detectors.reference_list(F.col("_content"))}
    fields = F.col("fields")
    for name, flag in flags.items():
        fields = fields.withField(name, F.struct(F.coalesce(flag, F.lit(False)).alias("assign")))
    return rows.withColumn("fields", fields).select(*records.columns)


#: What a document reference and the serialised text of a passage under a heading begin with. Fixed values.
DOCUMENT, SECTION = "id:documents:documents::", "Section context: this excerpt is from the section titled '"


def derived(records: DataFrame) -> DataFrame:
    """Update records of passages with all that is derived from their own fields: labels and concept_counts from topics, the
    document_ref, heading_text where the serialised text has one (else what the record says), and the detectors' flags.

    The fields are document_id, content, serialised_text, pages and topics, each with its value to assign.
    """
    rows = labels_from_topics(records)
    ref = documents.reference(DOCUMENT, F.col("fields.document_id.assign"))
    heading = documents.heading_from_serialised(F.col("fields.serialised_text.assign"), F.nullif(F.col("fields.content.assign"), F.lit("")), SECTION)
    given = F.col("fields.heading_text") if "heading_text" in rows.schema["fields"].dataType.names else F.lit(None).cast("struct<assign: string>")
    fields = F.col("fields").withField("document_ref", F.when(ref.isNotNull(), F.struct(ref.alias("assign")))).withField("heading_text", F.when(heading.isNotNull(), F.struct(heading.alias("assign"))).otherwise(given))
    return with_record_flags(rows.withColumn("fields", fields))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row of sums over feed results: input, operation, ok, missing, throttled, their rate and the failed files. A file
    fails only if fewer operations were ok than there were."""
    missing, throttled = (F.coalesce(F.try_element_at("code_counts", F.lit(c)), F.lit(0)) for c in ("404", "429"))
    sums = runs.agg(*(F.sum(f"{c}_count").alias(c) for c in ("input", "operation", "ok")), F.sum(missing).alias("missing"), F.sum(throttled).alias("throttled"), F.count_if(F.col("ok_count") < F.col("operation_count")).alias("failed_files"))
    return sums.withColumn("throttle_rate", F.coalesce(F.try_divide("throttled", "operation"), F.lit(0.0)))


def failed_documents(runs: DataFrame, text: str = "log_text") -> DataFrame:
    """(feed_path, document_id, error) of the log lines that gave a document up."""
    pattern = r"^feed: (.+) for put (\S+): giving up"
    lines = runs.select("feed_path", F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(pattern))
    return lines.select("feed_path", F.regexp_extract("line", pattern, 2).alias("document_id"), F.regexp_extract("line", pattern, 1).alias("error"))
