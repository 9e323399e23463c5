"""Concepts from entity records, their subconcepts' names, and label rows of documents and concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import derive

#: The property whose values are negative labels. Fixed value.
NEGATIVE = "P9"
_NO_NAMES = "array<string>"


def concepts(entities: DataFrame, negative: str = NEGATIVE) -> DataFrame:
    """(id, preferred_label, alternative_labels, description, negative_labels) of entity records (id, json). Records
    without an English label, or that are no JSON, go; members of another shape count as absent."""
    v = F.try_parse_json("json")
    none = F.array().cast(_NO_NAMES)
    aliases = F.try_variant_get(v, "$.aliases.en", "array<struct<language:string,value:string>>")
    claims = F.flatten(F.map_values(F.try_variant_get(v, "$.claims", "map<string,array<variant>>")))
    member = lambda s, path: F.try_variant_get(s, path, "string")
    said = F.filter(claims, lambda s: (member(s, "$.mainsnak.property") == negative) & (member(s, "$.mainsnak.snaktype") == "value"))
    return entities.select(
        "id",
        F.try_variant_get(v, "$.labels.en.value", "string").alias("preferred_label"),
        F.coalesce(F.transform(F.filter(aliases, lambda a: a["language"] == "en"), lambda a: a["value"]), none).alias("alternative_labels"),
        F.try_variant_get(v, "$.descriptions.en.value", "string").alias("description"),
        F.coalesce(F.transform(said, lambda s: member(s, "$.mainsnak.datavalue.value")), none).alias("negative_labels"),
    ).where("preferred_label <> ''")


def with_subconcepts(rows: DataFrame, descends: DataFrame) -> DataFrame:
    """Adds subconcept_labels: the names of all concepts that descend (id, sub_id) from each, sorted, without its own.
    Where there are some, negative labels that are also a positive one go."""
    names = F.concat(F.array("preferred_label"), "alternative_labels")
    each = rows.select(F.col("id").alias("sub_id"), F.explode(names).alias("_name"))
    below = descends.join(each, "sub_id").groupBy("id").agg(F.collect_set("_name").alias("_below"))
    out = rows.join(below, "id", "left").withColumn("_below", F.coalesce("_below", F.array().cast(_NO_NAMES)))
    out = out.withColumn("subconcept_labels", F.array_sort(F.array_except("_below", names)))
    positive = F.array_union(names, "_below")
    kept = F.filter("negative_labels", lambda x: ~F.array_contains(positive, x))
    return out.withColumn("negative_labels", F.when(F.size("subconcept_labels") > 0, kept).otherwise(F.col("negative_labels"))).drop("_below")


def label_rows(rows: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Label rows of (id, type, value) and, where the rows have them, their other names: with label_source, the flat label
    as JSON, and labels, the parents (id, relationship, parent_id, parent_type, parent_value) of each in order of id."""
    none = F.array().cast(_NO_NAMES)
    lists = [F.coalesce(c, none).alias(c) if c in rows.columns else none.alias(c) for c in ("alternative_labels", "subconcept_labels", "negative_labels")]
    about = F.coalesce("description", F.lit("")) if "description" in rows.columns else F.lit("")
    flat = F.to_json(F.struct("id", "type", "value")).alias("label_source")
    out = rows.select("id", "type", "value", *lists, about.alias("description"), flat)
    edge = "struct<id:string,type:string,value:string,relationship:string>"
    if parents is None:
        return out.withColumn("labels", F.array().cast(f"array<{edge}>"))
    entry = F.struct(F.col("parent_id").alias("id"), F.col("parent_type").alias("type"), F.col("parent_value").alias("value"), "relationship")
    lists = parents.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("labels"))
    return out.join(lists, "id", "left").withColumn("labels", F.coalesce("labels", F.array().cast(f"array<{edge}>")))


def of_documents(docs: DataFrame) -> DataFrame:
    """The label rows of all labels that documents carry, once each."""
    return label_rows(docs.select(F.explode("labels").alias("x")).select("x.id", "x.type", "x.value").distinct())


def of_concepts(rows: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Concepts as label rows, named ``concept::`` and their id."""
    named = rows.withColumns({"id": F.concat(F.lit("concept::"), "id"), "type": F.lit("concept"), "value": F.col("preferred_label")})
    return label_rows(named, parents)


def deduplicated(labels: DataFrame, concepts: DataFrame, key: str = "id", order: list[str] = ()) -> DataFrame:
    """One row for each id: concepts override document labels, and of one kind the last by ``order`` counts."""
    both = labels.withColumn("_concept", F.lit(0)).unionByName(concepts.withColumn("_concept", F.lit(1)))
    return derive.last_writer(both, key, ["_concept", *order]).drop("_concept")
