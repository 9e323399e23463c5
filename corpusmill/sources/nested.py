"""Nested files and flattened rows: members read alone, ordered groups, and structs from dotted names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of a flattened document row and of the document made of it. Fixed values.
DOTTED = {"title": "document_metadata.document_title", "source_url": "document_metadata.source_url", "original_document_id": "document_id"}
DESCRIPTION = "document_metadata.description"
MENTION = "struct<passage_index:int,page_number:int,section_id:int>"
#: Lines of an enriched evaluation set and of a hand-labelled one.
EXAMPLE = f"""input struct<document:struct<original_document_id:string,title:string,description:string,source_url:string,labels:array<string>>,topic:struct<id:string,preferred_label:string>,
    mentions:struct<total_passages:int,max_page:int,mentions:array<{MENTION}>,section_sizes:map<string,int>,passages_per_page:map<string,int>>,
    topic_corpus:struct<collection_frequency:long,document_frequency:long,corpus_total_documents:long,corpus_total_passages:long>>, score int"""
VALIDATION = "content string, label int, min_page int, stratum string"


def members(rows: DataFrame, struct: str, names: list[str], keys: list[str], required: list[str] = ()) -> DataFrame:
    """``keys`` and members of a struct as columns; only these reach the scan. Rows without a required one go."""
    out = rows.select(*keys, *(F.col(f"{struct}.{n}").alias(n) for n in names))
    for n in required:
        out = out.where(F.col(n).isNotNull())
    return out


def ordered_groups(rows: DataFrame, by: str, order: str, name: str = "rows") -> DataFrame:
    """(by, rows): each group's rows as an array of structs in ascending order. A group is one value, such as a document
    with its blocks, and must fit a row."""
    rest = [c for c in rows.columns if c not in (by, order)]
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))


def from_dotted(rows: DataFrame) -> DataFrame:
    """Nested structs in place of columns with dotted names, in their order; other columns stay."""

    def build(names: list[tuple[str, str]]) -> list[Column]:
        groups: dict[str, list[tuple[str, str]]] = {}
        for path, column in names:
            head, _, rest = path.partition(".")
            groups.setdefault(head, []).append((rest, column))
        out = []
        for head, inner in groups.items():
            leaves = [c for rest, c in inner if not rest]
            if leaves and len(inner) > 1:
                raise ValueError(f"{head} is both a value and a struct")
            out.append((F.col(f"`{leaves[0]}`") if leaves else F.struct(*build(inner))).alias(head))
        return out

    return rows.select(*build([(c, c) for c in rows.columns]))


def document_rows(rows: DataFrame) -> DataFrame:
    """title, source_url, original_document_id, description (empty where the rows have none) and no labels of flattened
    document rows; a missing column of the others is an error."""
    missing = [c for c in DOTTED.values() if c not in rows.columns]
    if missing:
        raise KeyError(", ".join(missing))
    description = F.col(f"`{DESCRIPTION}`") if DESCRIPTION in rows.columns else F.lit("")
    return rows.select(*(F.col(f"`{c}`").alias(n) for n, c in DOTTED.items()), description.alias("description"), F.array().cast("array<string>").alias("labels"))


def examples(spark: SparkSession, path: str) -> DataFrame:
    """document_id, topic, score, mentions (array) and the counts beside them of an enriched evaluation set's lines."""
    rows = spark.read.schema(EXAMPLE).json(path).where("input is not null")
    m, t = "input.mentions", "input.topic_corpus"
    return rows.select(
        F.col("input.document.original_document_id").alias("document_id"), F.col("input.topic.id").alias("topic"), "score", F.coalesce(f"{m}.mentions", F.array().cast(f"array<{MENTION}>")).alias("mentions"), *(F.col(f"{m}.{c}").alias(c) for c in ("total_passages", "max_page")), *(F.transform_keys(f"{m}.{c}", lambda k, _: k.cast("int")).alias(c) for c in ("section_sizes", "passages_per_page")),
        *(F.col(f"{t}.{c}").alias(n) for c, n in (("collection_frequency", "collection_frequency"), ("document_frequency", "document_frequency"), ("corpus_total_documents", "n_documents"), ("corpus_total_passages", "n_passages"))),
    )


def validation(spark: SparkSession, path: str) -> DataFrame:
    """content, label (boolean), min_page (null without pages) and stratum of a hand-labelled set's lines."""
    return spark.read.schema(VALIDATION).json(path).where("content is not null").withColumn("label", F.col("label") != 0)
