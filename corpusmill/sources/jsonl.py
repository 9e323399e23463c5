"""JSON-lines sources and sinks of partial updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Members of a topic, and fields of a passage's update record as they are exported.
TOPIC = "struct<concept_id: string, classifier_id: string, end_index: double, labelled_text: string, labellers: array<string>, prediction_probability: double, start_index: double, timestamps: array<string>>"
PASSAGE_FIELDS = f"document_id string, content string, serialised_text string, pages array<struct<number: int>>, topics array<{TOPIC}>"


def write_updates(updates: DataFrame, path: str, per_file: int = 200_000, compressed: bool = False) -> None:
    """At most ``per_file`` records in a file; a failed job leaves nothing published."""
    out = updates.write.option("maxRecordsPerFile", per_file)
    (out.option("compression", "gzip") if compressed else out).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One file or a folder of parts; blank lines are skipped, a missing path is an error."""
    return spark.read.schema(schema).json(path)


def update_records(rows: DataFrame, key: Column, fields: list[str], create: bool = False) -> DataFrame:
    """(update, create, fields): each field as a struct with its value to assign; null clears it."""
    return rows.select(key.alias("update"), F.lit(create).alias("create"), F.struct(*(F.struct(F.col(c).alias("assign")).alias(c) for c in fields)).alias("fields"))


def write_both(records: DataFrame, path: str, compressed: str, per_file: int = 200_000) -> None:
    """The records as lines below one prefix and as gzip lines below another; nulls to assign stay in the lines."""
    for to, how in ((path, "none"), (compressed, "gzip")):
        records.write.option("maxRecordsPerFile", per_file).option("ignoreNullFields", False).option("compression", how).json(to)


def read_records(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Update records; a field that a line does not have is null, one that it clears is a struct with a null."""
    kinds = spark.createDataFrame([], fields).dtypes
    members = ", ".join(f"{n}: struct<assign: {t}>" for n, t in kinds)
    return spark.read.schema(f"update string, create boolean, fields struct<{members}>").json(path)
