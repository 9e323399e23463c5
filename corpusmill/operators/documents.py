"""Derivation of index rows from documents, passages and labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search

PRINCIPAL = "status::Principal"
MEMBERSHIP = ("member_of", "is_version_of")


def values_of(labels: Column, relationship: str) -> Column:
    """The values of the labels with a relationship, such as a document's geographies."""
    return F.transform(F.filter(labels, lambda x: x["relationship"] == relationship), lambda x: x["value"])


def principal_id(own: Column, labels: Column, edges: Column) -> Column:
    """The document's own id if it is a principal, else the target of its first membership edge, else null."""
    target = F.try_element_at(F.filter(edges, lambda x: x["type"].isin(*MEMBERSHIP)), F.lit(1))["value"]
    return F.when(F.exists(labels, lambda x: x["id"] == PRINCIPAL), own).otherwise(target)


def several_principals(edges: Column) -> Column:
    """Whether a document's edges name more than one candidate for its principal; the first one counts."""
    targets = F.array_distinct(F.transform(F.filter(edges, lambda x: x["type"].isin(*MEMBERSHIP)), lambda x: x["value"]))
    return F.coalesce(F.size(targets) > 1, F.lit(False))


def concept_counts(mentions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, concept_id, mentions (repeats count), the name that was seen last by ``order``, and the ids of the passages in
    order of ``mentions`` (keys, concept_id, name, passage_id)."""
    place = F.struct(*order, "passage_id")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["passage_id"].cast("string")), "::")
    return mentions.groupBy(*keys, "concept_id").agg(F.count("*").alias("mentions"), F.max_by("name", F.struct(*order)).alias("name"), ids.alias("passage_ids"))


def facet_keys(labels: Column) -> Column:
    """The composite keys of each label: type::value, type::id::value and relationship::id::value."""
    return F.transform(labels, lambda x: F.struct(F.concat_ws("::", x["type"], x["value"]).alias("flat"), F.concat_ws("::", x["type"], x["id"], x["value"]).alias("by_type"), F.concat_ws("::", x["relationship"], x["id"], x["value"]).alias("by_relationship")))


def parsed_key(key: Column) -> tuple[Column, Column, Column]:
    """Type (before the first ``::``), id (the middle, which may hold ``::``) and value (after the last)."""
    kind, value = F.substring_index(key, "::", 1), F.substring_index(key, "::", -1)
    return kind, F.substring(key, F.length(kind) + 3, F.length(key) - F.length(kind) - F.length(value) - 4), value


def typed_attributes(attributes: Column) -> dict[str, Column]:
    """A VARIANT object's members by their type: strings, numbers (not booleans), booleans as 0 and 1, and the
    identifiers among the strings without their prefix. Members of other types are left out."""
    entries = F.from_json(F.to_json(attributes), "map<string,string>")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(attributes, F.concat(F.lit("$['"), k, F.lit("']")), "variant"))
    of = lambda test: F.map_filter(entries, lambda k, v: test(kind(k)))
    strings = of(lambda t: t == "STRING")
    numbers = F.transform_values(of(lambda t: t.rlike("BIGINT|DECIMAL|DOUBLE|FLOAT")), lambda k, v: v.cast("double"))
    booleans = F.transform_values(of(lambda t: t == "BOOLEAN"), lambda k, v: (v == "true").cast("int"))
    named = F.map_filter(strings, lambda k, v: k.startswith("identifier::"))
    return {"attributes_string": strings, "attributes_double": numbers, "attributes_boolean": booleans, "identifiers": F.transform_keys(named, lambda k, v: F.substring(k, len("identifier::") + 1, 1 << 30))}


def blocks_of(passages: DataFrame) -> DataFrame:
    """document_id and its passages in order: idx, content, page_number (the first page or 0)."""
    entry = F.struct("idx", F.coalesce("page_number", F.lit(0)).alias("page_number"), "content")
    return passages.groupBy("document_id").agg(F.sort_array(F.collect_list(entry)).alias("passages"))


def passage_rows(passages: DataFrame, lookup: DataFrame, concepts: DataFrame) -> DataFrame:
    """Passages with their document's principal_id and their own concepts; a missing one stays null. ``heading`` is null
    where it is empty, ``page_number`` where it is 0."""
    rows = passages.join(lookup, "document_id", "left").join(concepts, ["document_id", "idx"], "left")
    return rows.withColumns({"page_number": F.nullif(F.col("page_number"), F.lit(0)), "content": F.nullif(F.col("content"), F.lit(""))})


def heading_from_serialised(serialised: Column, content: Column, prefix: str) -> Column:
    """The heading of a serialised text: what stands between the fixed prefix and ``'. `` before the exact content at its
    end, trimmed; null unless all of that is there."""
    tail = F.concat(F.lit("'. "), content)
    middle = F.substring(serialised, F.lit(len(prefix) + 1), F.length(serialised) - len(prefix) - F.length(tail))
    fits = serialised.startswith(prefix) & serialised.endswith(tail) & (F.length(serialised) >= len(prefix) + F.length(tail))
    return F.when(fits, F.nullif(F.trim(middle), F.lit("")))


def reference(prefix: str, document_id: Column) -> Column:
    """A document reference, null without an id."""
    return F.concat(F.lit(prefix), document_id.cast("string"))


def heading_texts(passages: DataFrame) -> DataFrame:
    """Adds heading_text, the content of the passage whose idx is the passage's heading_id."""
    headings = passages.select("document_id", F.col("idx").alias("heading_id"), F.col("content").alias("heading_text"))
    return passages.join(headings, ["document_id", "heading_id"], "left")


def merged_labels(labels: Column, concepts: Column, missing: str = "MISSING") -> Column:
    """Labels and concepts as one list; missing members get a placeholder."""
    whole = lambda x: F.struct(*(F.coalesce(x[c], F.lit(missing)).alias(c) for c in ("id", "type", "value")))
    return F.concat(F.transform(F.coalesce(labels, F.array()), whole), F.transform(F.coalesce(concepts, F.array()), whole))


def all_names(value: Column, alternatives: Column, subconcepts: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.concat(F.array(value), F.coalesce(alternatives, empty), F.coalesce(subconcepts, empty))


def latest(rows: DataFrame, key: str, stamp: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(stamp).alias(stamp))


def index_rows(docs: DataFrame, geography: str = "geography", carried: tuple[str, ...] = ("published",)) -> DataFrame:
    """Index rows of documents (id, title, description, labels, edges, attributes_*): texts without control characters, an
    empty description null, the labels flat as they are, the values of the ``geography`` relationship, the typed
    attributes, the ``carried`` columns and the principal's id."""
    attributes = [c for c in docs.columns if c.startswith("attributes_")]
    about = F.nullif(search.strip_controls(F.col("description")), F.lit(""))
    return docs.select("id", search.strip_controls(F.col("title")).alias("title"), about.alias("description"), "labels", values_of(F.col("labels"), geography).alias("geographies"), *attributes, *carried, principal_id(F.col("id"), F.col("labels"), F.col("edges")).alias("principal_id"))


def client_passages(rows: DataFrame) -> DataFrame:
    """Index passages as clients see them: text_block_id, text and type, the page numbers beside the pages, and each label
    as an edge around its value."""
    value = lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["value"].alias("value"))
    inner = rows.schema["labels"].dataType.elementType.names
    edge = lambda x: F.struct(value(x).alias("value"), *(x[c].alias(c) for c in inner if c not in ("id", "type", "value")))
    renamed = {"id": "text_block_id", "content": "text", "content_type": "type", "pages": "pages_with_bounding_boxes"}
    out = rows.withColumns({"_numbers": F.transform("pages", lambda p: p["number"]), "labels": F.transform("labels", edge)})
    return out.withColumnsRenamed(renamed).withColumnRenamed("_numbers", "pages")


def whole_updates(docs: DataFrame, blocks: DataFrame, prefix: str = "id:documents:documents::") -> DataFrame:
    """(put, fields) of whole documents (id, title, description, labels): with their blocks (document_id, idx, ...) in order,
    none where there are none, and the document and its blocks as JSON in ``source``."""
    entry = F.struct("idx", *(c for c in blocks.columns if c not in ("document_id", "idx")))
    lists = blocks.groupBy(F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("passages"))
    joined = docs.join(lists, "id", "left").withColumn("passages", F.coalesce("passages", F.array().cast(lists.schema["passages"].dataType)))
    whole = F.struct("id", *(F.coalesce(c, F.lit("MISSING")).alias(c) for c in ("title", "description")), "labels", "passages")
    source = F.to_json(whole, {"ignoreNullFields": "false"})
    return joined.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("put"), F.struct("title", "description", "labels", "passages", source.alias("source")).alias("fields"))
