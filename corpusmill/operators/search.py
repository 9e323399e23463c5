"""Text matching and ranking over passages, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables

#: Length normalisation and term saturation of the ranking.
B, K1 = 0.4, 1.2


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the phrase's tokens stand next to each other and in order, whatever lies between."""
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")).contains(f" {phrase} ")


def has_all(text: Column, words: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, words)), tokens(text))) == 0


def has_any(text: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.array(*map(F.lit, words)), tokens(text))


def strip_controls(text: Column) -> Column:
    """Without control characters other than tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def bm25(rows: DataFrame, keys: list[str], text: str, queries: DataFrame) -> DataFrame:
    """query_id, keys and score of all rows that share a term with a query.

    ``queries`` (query_id, term) is counted, and broadcast if it is small; only postings of its terms are shuffled.
    """
    small = tables.hint(queries)
    sized = rows.select(*keys, tokens(F.col(text)).alias("_t")).withColumn("_len", F.size("_t"))
    stats = sized.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))  # one row
    wanted = small(queries.select("term").distinct())
    postings = sized.select(*keys, "_len", F.explode("_t").alias("term")).join(wanted, "term").groupBy(*keys, "_len", "term").agg(F.count("*").alias("_tf"))
    frequency = postings.groupBy("term").agg(F.count("*").alias("_df"))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    weighed = frequency.join(small(queries), "term").join(F.broadcast(stats))
    return postings.join(small(weighed), "term").groupBy("query_id", *keys).agg(F.sum(part).alias("score"))


def top(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each query with their rank; ties by key."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), *keys)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def completeness(text: Column, words: Column) -> tuple[Column, Column]:
    """Matched share of the field's distinct tokens and of the query's."""
    have = F.array_distinct(tokens(text))
    both = F.size(F.array_intersect(have, words))
    return F.try_divide(both, F.size(have)), F.try_divide(both, F.size(words))


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that both result lists have of each query, divided by the shorter list's length."""
    n_a, n_b = (x.groupBy("query_id").agg(F.count("*").alias(c)) for x, c in ((a, "_a"), (b, "_b")))
    both = a.join(b, ["query_id", *keys], "left_semi").groupBy("query_id").agg(F.count("*").alias("_both"))
    joined = n_a.join(n_b, "query_id").join(both, "query_id", "left")
    return joined.select("query_id", (F.coalesce("_both", F.lit(0)) / F.least("_a", "_b")).alias("overlap"))
