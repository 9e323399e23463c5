"""Partial updates: one nullable struct<assign> for each field; no struct leaves the field alone, a null assign sets
it to null.

Patches of one key are folded before they meet the table: of each field the last patch counts, by the order given. A
fold is a patch of the same kind, so that folds of parts add up to the fold of all, in tasks and over batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fields(updates: DataFrame, *others: str | None) -> list[str]:
    return [c for c in updates.columns if c not in others]


def fold(updates: DataFrame, key: str, order: str, create: Column | None = None) -> DataFrame:
    """key, created (the order of the first patch that may make a row; null if none may) and of each field the struct
    (assign, at) of its last patch, null if no patch has it. Of patches of equal order the one with the larger value
    counts. ``create`` tells whether a patch may make a row; all columns that are structs with ``assign`` are fields. Folds
    may be folded again with ``refold``."""
    kinds = dict(updates.dtypes)
    fields = [c for c in _fields(updates, key, order) if kinds[c].startswith("struct<assign:")]
    at = F.col(order)
    named = updates.select(key, F.when(F.lit(False) if create is None else create, at).alias("created"), *(F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.assign").alias("assign"), at.alias("at"))).alias(c) for c in fields))
    return refold(named, key)


def refold(folds: DataFrame, key: str) -> DataFrame:
    """The fold of several folds of a key; partial sums meet before the shuffle, so that one key may have most patches."""
    fields = _fields(folds, key, "created")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.at"), F.to_json(F.struct(F.col(f"{c}.assign"))))))
    return folds.groupBy(key).agg(F.min("created").alias("created"), *(last(c).alias(c) for c in fields))


def apply_folds(base: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """``base`` after the patches. A row that is not there is made by the first patch that may, and gets what that and later
    patches assign; patches before it find nothing."""
    fields = _fields(folds, key, "created")
    renamed = folds.select(F.col(key), F.col("created").alias("_created"), *(F.col(c).alias(f"_u_{c}") for c in fields))
    joined = base.withColumn("_there", F.lit(True)).join(renamed, key, "full_outer").where("_there or _created is not null")

    def value(c: str) -> Column:
        patch = F.col(f"_u_{c}")
        return F.when(F.col("_there") & patch.isNull(), F.col(c)).when(F.col("_there") | (patch["at"] >= F.col("_created")), patch["assign"])

    return joined.select(key, *(value(c).alias(c) if c in fields else F.col(c) for c in base.columns if c != key))


def apply_updates(base: DataFrame, updates: DataFrame, key: str, create: bool = False, order: str | None = None) -> DataFrame:
    """``create`` adds rows with new keys, else only existing rows are touched. Several updates of a key are folded in the
    order of column ``order``; without one, a second update of a key is an error."""
    if order is not None:
        return apply_folds(base, fold(updates, key, order, F.lit(create)), key)
    fields = _fields(updates, key)
    one = updates.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*fields)).alias("_u"))
    once = F.when(F.col("_n") == 1, F.col("_u")).otherwise(F.raise_error(F.concat(F.lit("several updates of "), F.col(key).cast("string"), F.lit(" need an order"))))
    renamed = one.withColumn("_u", once).select(F.col(key), F.lit(True).alias("_patched"), *(F.col(f"_u.{c}").alias(f"_u_{c}") for c in fields))
    joined = base.join(renamed, key, "full_outer" if create else "left")
    return joined.select(key, *(F.when(F.col(f"_u_{c}").isNotNull(), F.col(f"_u_{c}.assign")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns if c != key))
