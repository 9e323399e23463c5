"""Tests of ranked result lists: (case_id, id, rank) against a case's expectations, all cases in one plan.

A case without results keeps its row and fails unless it expects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Each case with its result ids in order of rank; repeated ids stay."""
    lists = results.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))
    return cases.join(lists, "case_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))


def precision(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Whether the first results, as many as are expected, are the expected ids: in order (strict) or as a set."""
    top = F.slice("ids", F.lit(1), F.greatest(F.size("expected"), F.lit(1)))
    good = F.when(F.col("strict"), top == F.col("expected")).otherwise((F.sort_array(top) == F.sort_array("expected")) & (F.size(F.array_distinct(top)) == F.size(top)))
    return ranked(cases, results).withColumn("passed", good)


def recall(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Whether all expected and no forbidden ids are in the first k; with missing and present for the diagnosis."""
    top = F.slice("ids", F.lit(1), F.col("k"))
    got = ranked(cases, results).withColumns({"missing": F.array_except("expected", top), "present": F.array_intersect("forbidden", top)})
    return got.withColumn("passed", (F.size("missing") == 0) & (F.size("present") == 0))


def relative_order(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Whether ``higher`` is in the first k and above ``lower``, which counts as below if it is absent."""
    first = F.array_position("ids", F.col("higher"))
    second = F.array_position("ids", F.col("lower"))
    return ranked(cases, results).withColumns({"rank_higher": F.nullif(first, F.lit(0)), "rank_lower": F.nullif(second, F.lit(0)), "passed": first.between(1, F.col("k")) & ((second == 0) | (first < second))})


def characteristics(cases: DataFrame, results: DataFrame, holds: Column, every: bool = True) -> DataFrame:
    """Whether all (or any) of the first k results have a property; a case without results fails."""
    top = results.join(cases.select("case_id", "k"), "case_id").where("rank <= k")
    seen = top.groupBy("case_id").agg((F.bool_and if every else F.bool_or)(F.coalesce(holds, F.lit(False))).alias("_held"))
    return cases.join(seen, "case_id", "left").withColumn("passed", F.coalesce("_held", F.lit(False))).drop("_held")


def diagnosis(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, id, expected_rank, actual_rank) of every expected id; the actual rank is null if it is absent."""
    want = cases.select("case_id", F.posexplode("expected").alias("expected_rank", "id")).withColumn("expected_rank", F.col("expected_rank") + 1)
    have = results.groupBy("case_id", "id").agg(F.min("rank").alias("actual_rank"))
    return want.join(have, ["case_id", "id"], "left")
