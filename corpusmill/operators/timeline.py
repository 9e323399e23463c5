"""As-of joins, following rows and row numbers along each key's events, with keys of any size.

A key with more than ``PART_ROWS`` rows is cut along its time into parts of about that many, from a count by slots of
time; windows run over (key, part), and what they need from beyond an edge (the last state, the first rows, the number
of rows) is carried over in a second pass over one row for each part of such keys. Keys below the limit have one part
and nothing is carried, so that no window ever holds a large key as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables

#: Rows of a key in one part, and seconds of the slots that parts are made of.
PART_ROWS, SLOT = 1_000_000, 600


def micros(at: str | Column) -> Column:
    """Microseconds of a time, whether it has a zone or not."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def cut(rows: DataFrame, by: str, at: str, most: int = PART_ROWS, slot: int = SLOT) -> tuple[DataFrame, bool]:
    """``rows`` with _part, ascending along ``at`` (microseconds), and whether any key has several parts."""
    hot = tables.kept(rows.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col(by).alias("_hot")))
    if hot.isEmpty():
        return rows.withColumn("_part", F.lit(0).cast("long")), False
    slots = F.floor(F.col(at) / (slot * 1_000_000))
    # a row for each hot key and slot of time
    counts = rows.join(tables.measured(hot), F.col(by) == F.col("_hot"), "left_semi").groupBy(F.col(by).alias("_hot"), slots.alias("_slot")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_hot").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = tables.measured(tables.kept(counts.select("_hot", "_slot", F.floor(before / most).alias("_part"))))
    joined = rows.withColumn("_at_slot", slots).join(parts, (F.col(by) == F.col("_hot")) & (F.col("_at_slot") == F.col("_slot")), "left")
    return joined.withColumn("_part", F.coalesce("_part", F.lit(0))).drop("_hot", "_slot", "_at_slot"), True


def _edges(parted: DataFrame, by: str, made: Column, seen: Column) -> DataFrame:
    """``seen`` over one row (by, _part, made) for each part of the keys that have several."""
    each = parted.groupBy(by, "_part").agg(made.alias("_made"))
    several = each.withColumn("_several", F.max("_part").over(W.partitionBy(by)) > 0).where("_several")
    return tables.measured(tables.kept(several.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), seen.alias("_carried"))))


def _carried(parted: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    return parted.join(edges, (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_of")), "left").drop("_by", "_of")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str = "ts", right_at: str = "ts", forward: bool = False, strict: bool = False, ties: list[str] = (), name: str = "found", most: int = PART_ROWS) -> DataFrame:
    """``left`` with ``name``: the row of ``right`` (a struct; null if there is none) of the same key that is the latest up to
    each left row's time, or with ``forward`` the earliest from it on; ``strict`` leaves out rows of the same time.

    Of right rows of one time the last by ``ties`` counts, and going forward the first. Rows without a key or a time find
    nothing and are not found.
    """
    kind = F.struct(*(F.col(c) for c in right.columns))
    sign = -1 if forward else 1
    here = left.select(F.col(by).alias("_key"), (sign * micros(at)).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_left"))
    there = right.where(F.col(by).isNotNull() & F.col(right_at).isNotNull()).select(F.col(by).alias("_key"), (sign * micros(right_at)).alias("_t"), F.lit(1 if strict else 0).alias("_side"), kind.alias("_right"))
    aside = here.where("_key is null or _t is null").select("_left.*", F.lit(None).cast(there.schema["_right"].dataType).alias(name))
    both = here.where("_key is not null and _t is not null").unionByName(there, allowMissingColumns=True)
    parted, several = cut(both, "_key", "_t", most)
    order = ["_t", "_side", *(F.desc(f"_right.{c}") if forward else F.asc(f"_right.{c}") for c in ties)]
    state = F.last("_right", ignorenulls=True)
    parted = parted.withColumn("_seen", state.over(W.partitionBy("_key", "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    if several:
        rights = F.when(F.col("_right").isNotNull(), F.struct("_t", *((-F.col(f"_right.{c}") if forward else F.col(f"_right.{c}")).alias(f"_tie{i}") for i, c in enumerate(ties))))
        edges = _edges(parted, "_key", F.max_by("_right", rights), F.last("_made", ignorenulls=True).over(W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
        parted = _carried(parted, edges, "_key").withColumn("_seen", F.coalesce("_seen", "_carried"))
    return parted.where("_left is not null").select("_left.*", F.col("_seen").alias(name)).unionByName(aside)


def next_after(events: DataFrame, found: Column, by: str = "distinct_id", ts: str = "ts", most: int = PART_ROWS) -> DataFrame:
    """The events with next_ts: the earliest strictly later time of the same key at which ``found`` holds."""
    out = as_of(events, events.where(found).select(by, ts), by, ts, ts, forward=True, strict=True, name="_found", most=most)
    return out.withColumn("next_ts", F.col(f"_found.{ts}")).drop("_found")


def last_until(events: DataFrame, found: Column, by: str = "distinct_id", ts: str = "ts", most: int = PART_ROWS) -> DataFrame:
    """The events with last_ts: the latest time up to the event's own at which ``found`` holds."""
    out = as_of(events, events.where(found).select(by, ts), by, ts, ts, name="_found", most=most)
    return out.withColumn("last_ts", F.col(f"_found.{ts}")).drop("_found")


def following(events: DataFrame, columns: list[str], n: int, by: str = "distinct_id", ts: str = "ts", ties: list[str] = ("event_id",), most: int = PART_ROWS) -> DataFrame:
    """The events with ``next``: an array of the ``columns`` of up to ``n`` events of the same key that come next."""
    parted, several = cut(events.withColumn("_t", micros(ts)), by, "_t", most)
    own = W.partitionBy(by, "_part").orderBy(ts, *ties)
    parted = parted.withColumn("next", F.collect_list(F.struct(*columns)).over(own.rowsBetween(1, n)))
    if several:
        firsts = parted.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= n)
        heads = F.transform(F.sort_array(F.collect_list(F.struct("_k", F.struct(*columns).alias("x")))), lambda h: h["x"])
        later = F.flatten(F.collect_list("_made").over(W.partitionBy(by).orderBy("_part").rowsBetween(1, n)))
        parted = _carried(parted, _edges(firsts, by, heads, later), by).withColumn("next", F.slice(F.concat("next", F.coalesce("_carried", F.array().cast(parted.schema["next"].dataType))), 1, n)).drop("_carried")
    return parted.drop("_t", "_part")


def numbered(events: DataFrame, by: str = "distinct_id", ts: str = "ts", ties: list[str] = ("event_id",), most: int = PART_ROWS) -> DataFrame:
    """The events with ``rn``, their number among those of their key, from 1."""
    parted, several = cut(events.withColumn("_t", micros(ts)), by, "_t", most)
    parted = parted.withColumn("rn", F.row_number().over(W.partitionBy(by, "_part").orderBy(ts, *ties)).cast("long"))
    if several:
        before = F.sum("_made").over(W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
        parted = _carried(parted, _edges(parted, by, F.count("*"), before), by).withColumn("rn", F.col("rn") + F.coalesce("_carried", F.lit(0))).drop("_carried")
    return parted.drop("_t", "_part")
