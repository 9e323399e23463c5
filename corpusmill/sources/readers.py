"""Sources of documents, text blocks, inferences, labelled sets and event logs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = "struct<type:string,value:struct<id:string,type:string,value:string>,timestamp:string>"
DOCUMENT = f"id string, title string, description string, labels array<{LABEL}>, documents array<struct<type:string,value:struct<id:string>,timestamp:string>>, attributes variant"
BLOCKS = "pdf_data struct<text_blocks:array<struct<id:string,idx:int,text:string,language:string,type:string,type_confidence:double,heading_id:string,pages:array<struct<number:int>>>>>"
CONCEPT = "struct<id:string,name:string,model:string,start:int,end:int,timestamp:string>"


#: Bytes of small files that one task reads.
PACK_BYTES = 64 << 20


def packed(files: DataFrame, path: str, size: int = PACK_BYTES) -> DataFrame:
    """``files``, a frame that reads one row from each file of ``path``, in tasks of about ``size`` bytes, whatever the
    number of files; nothing is shuffled."""
    spark = files.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.globStatus(folder) or []
    total = sum(fs.getContentSummary(x.getPath()).getLength() for x in found)
    return files.coalesce(max(1, -(-total // size)))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Document lines; attributes stay of mixed types."""
    return spark.read.schema(DOCUMENT).json(path)


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each block of files that hold a document each; the document's id is the file's stem without
    ``_translated_en``. Documents without blocks have no rows, nor have files that are no JSON; an empty folder has none."""
    files = packed(spark.read.schema(BLOCKS).option("multiLine", True).json(path).withColumn("_name", F.col("_metadata.file_name")), path)
    name = F.regexp_replace(F.url_decode("_name"), r"\.json$", "")
    return files.select(F.replace(name, F.lit("_translated_en"), F.lit("")).alias("document_id"), F.explode("pdf_data.text_blocks").alias("b")).select("document_id", "b.*")


def inferences(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, passage_id, concept) of files that map passage ids to lists of concepts; bad files have no rows."""
    files = packed(spark.read.text(path, wholetext=True).withColumn("_name", F.col("_metadata.file_name")), path)
    maps = files.select(F.regexp_replace(F.url_decode("_name"), r"\.json$", "").alias("document_id"), F.from_json("value", f"map<string,array<{CONCEPT}>>").alias("m"))
    return maps.select("document_id", F.explode("m").alias("passage_id", "c")).select("document_id", "passage_id", F.explode("c").alias("concept"))


def labelled_wide(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """(ids, topic, score) of a CSV with a column for each topic (its name holds ``|Q``); scores that are no numbers go."""
    wide = spark.read.option("header", True).csv(path)
    topics = [c for c in wide.columns if "|Q" in c]
    long = wide.unpivot([f"`{c}`" for c in ids], [F.col(f"`{c}`") for c in topics], "column", "said")
    score = F.expr("try_cast(said AS double)").cast("int")
    return long.select(*ids, F.element_at(F.split("column", r"\|"), -1).alias("topic"), score.alias("score")).where("score IS NOT NULL")


def parts(spark: SparkSession, path: str, schema: str, first: int | None = None, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Lines of one file or of a folder's parts, or of its first parts by name; an empty folder is an error. ``derive`` is
    applied to the lines, so that what later steps read has its fields already."""
    lines = spark.read.schema(schema).json(path)
    names = sorted(lines.inputFiles())
    if not names:
        raise FileNotFoundError(path)
    lines = lines if first is None else spark.read.schema(schema).json(names[:first])
    return lines if derive is None else derive(lines)


def events_between(events: DataFrame, first: date, last: date, stamp: str = "ts") -> DataFrame:
    """The events from the first day's start to the last day's end."""
    return events.where((F.col(stamp) >= F.lit(first).cast("timestamp_ntz")) & (F.col(stamp) < F.lit(last + timedelta(days=1)).cast("timestamp_ntz")))
