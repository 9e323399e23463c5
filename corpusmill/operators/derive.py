"""Record derivation, passage tests and closures over label tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import kept

#: What marks the answers of a questionnaire. Fixed values.
ANSWERS = [" tak no", " yes no", " no yes", "yes/no", "not applicable", " n/a", " nie tak", " oui non"]


def parsed_value(repr_text: Column) -> Column:
    """The text of ``Name("text")``, or the value as it is."""
    pattern = r'^\w+\("([\s\S]*)"\)$'
    return F.when(repr_text.rlike(pattern), F.regexp_extract(repr_text, pattern, 1)).otherwise(repr_text)


def currency_words(text: Column) -> Column:
    """Currency signs as words, joined to what follows."""
    for sign, word in (("$", "dollar"), ("£", "pound"), ("€", "euro")):
        text = F.replace(text, F.lit(sign), F.lit(word))
    return text


def short_heading(content: Column, kind: Column) -> Column:
    """1 to 11 words, and typed as a heading or at least 90 % of the letters upper case."""
    words = F.regexp_count(content, F.lit(r"[^ \t-\r]+"))
    upper, letters = F.regexp_count(content, F.lit("[A-Z]")), F.regexp_count(content, F.lit("[A-Za-z]"))
    return words.between(1, 11) & ((kind == "sectionHeading") | (letters > 0) & (10 * upper >= 9 * letters))


def questionnaire(content: Column, answers: list[str] = ANSWERS) -> Column:
    """A question mark and one of the answer marks, whatever its case."""
    low = F.lower(content)
    return content.contains("?") & reduce(or_, (low.contains(a) for a in answers))


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant) over any number of steps of edges (parent, child); cycles end by themselves.

    Each round joins the paths with themselves, so a path of n steps takes log2(n) rounds; the paths are checkpointed
    after each, and no new path ends it.
    """
    paths = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).where("ancestor is not null and descendant is not null").distinct()
    n, before = paths.count(), -1
    while n != before:
        upper, lower = paths.select("ancestor", F.col("descendant").alias("_via")), paths.select(F.col("ancestor").alias("_via"), "descendant")
        paths = kept(paths.union(upper.join(lower, "_via").select("ancestor", "descendant")).distinct())
        n, before = paths.count(), n
    return paths


def direct_parents(paths: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(descendant, ancestor) without any other ancestor of the descendant in between; only ancestors among ``known``, the
    ids of the concepts that exist, if they are given."""
    upper, lower = paths.select("ancestor", F.col("descendant").alias("_via")), paths.select(F.col("ancestor").alias("_via"), "descendant")
    longer = upper.join(lower, "_via").where("_via <> ancestor and _via <> descendant").select("ancestor", "descendant").distinct()
    direct = paths.join(longer, ["ancestor", "descendant"], "left_anti").select("descendant", "ancestor")
    return direct if known is None else direct.join(known.select(F.col(known.columns[0]).alias("ancestor")), "ancestor", "left_semi").select("descendant", "ancestor")


def last_writer(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last by the columns ``order``. Aggregates before it shuffles, so hot keys are cheap."""
    value = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(value, F.struct(*order)).alias("_v")).select("_v.*")
