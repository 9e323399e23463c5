"""Benchmark decontamination by a distributed positional inverted index.

The benchmark's items are cut into windows of words. The index stores a posting (term, document, position) for every
place in the training texts where a term of the benchmark stands, and one for the end of every text, whose position
is the text's number of words. Terms are ranked by the lengths of their lists. For each window the list of its rarest
term is intersected with the offset-adjusted list of the second rarest; windows with the same two terms at the same
distance are asked for once. Places where both terms stand at most ``SLOP`` words off their distance are proximity
matches. Those at the very distance are then intersected with the lists of all further terms of the window, of which
only documents that are left are read; what is in all lists is an exact phrase match.

Null texts and texts without words have no hits; items without words have no windows; items of fewer words than a
window are one window. Null item ids match but are not listed. Equal terms at two places of a window are two terms.
Rows that repeat a doc_id are judged by their own text, equal rows alike; null doc_ids are judged as well. An empty
table gives no rows, an empty benchmark no hits. Only doc_id and text are read, so further columns may have any
name. A very long text is as many postings as it has words of the benchmark; nothing holds them together but the
document's own spans of hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, maybe_broadcast, tidy, written

WINDOW = 13
#: Words that the two rarest terms of a window may be off their distance in a proximity match.
SLOP = 3
#: All of ASCII but letters and digits; they part words.
BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: The term of a text's end; no word is empty.
END = ""
DOC = ["doc_id", "row"]


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text, BREAKS), " "), lambda w: w != "")


def same(columns: list[str], left: str = "", right: str = "_") -> Column:
    """Null-safe equality of columns of two sides, whose names are told apart by prefixes."""
    on = F.lit(True)
    for c in columns:
        on = on & F.col(left + c).eqNullSafe(F.col(right + c))
    return on


def windows(benchmark: DataFrame) -> DataFrame:
    """(wid, window, n, items) of the distinct windows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("window"))
    return written(cut.groupBy("window").agg(F.collect_set("item").alias("items")).select(F.monotonically_increasing_id().alias("wid"), "window", F.size("window").alias("n"), "items"))


def vocabulary(wins: DataFrame) -> DataFrame:
    """(term, tid) of all terms of the windows and of the end of a text."""
    end = wins.sparkSession.range(1).select(F.lit(END).alias("term"))
    terms = wins.select(F.explode("window").alias("term")).union(end).distinct()
    return written(terms.select("term", F.when(F.col("term") == END, F.lit(-1)).otherwise(F.monotonically_increasing_id()).alias("tid")))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stores the postings (tid, doc_id, row, pos) of the terms (term, tid); row tells texts of one doc_id apart."""
    # the hash and the words are made before the text is opened up: beside the explode they would be made, or the text
    # carried, for each of its words. No list is empty, and the outer form keeps the words from being made for a filter.
    text = F.coalesce("text", F.lit(""))
    parted = docs.select("doc_id", F.xxhash64("text").alias("row"), F.concat(words(text), F.array(F.lit(END))).alias("w"))
    found = parted.select("doc_id", "row", F.posexplode_outer("w").alias("pos", "term"))
    return written(found.join(maybe_broadcast(terms), "term").select("tid", "doc_id", "row", "pos"))


def rank(wins: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """The windows with their terms by rarity: wid, n, items, complete (every term occurs), first and second (the two
    rarest terms that occur, with their places ``at``), further (the other terms)."""
    lists = index.groupBy("tid").agg(F.count("*").alias("n_term"))
    sizes = terms.join(lists, "tid", "left").select("term", "tid", F.coalesce("n_term", F.lit(0)).alias("n_term"))
    each = wins.select("wid", "items", "n", F.posexplode("window").alias("at", "term")).join(sizes, "term")
    by = each.groupBy("wid").agg(F.first("items").alias("items"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("n_term", "at", "tid"))).alias("t"))
    by = by.withColumn("have", F.filter("t", lambda x: x["n_term"] > 0)).where(F.size("have") > 0)
    of = lambda x: F.struct(x["tid"].alias("tid"), x["at"].alias("at"))
    second = F.coalesce(F.get("have", F.lit(1)), F.get("have", F.lit(0)))
    further = F.transform(F.slice("have", F.lit(3), F.greatest(F.size("have") - 2, F.lit(0))), of)
    return written(by.select("wid", "n", "items", (F.size("have") == F.col("n")).alias("complete"), of(F.col("have")[0]).alias("first"), of(second).alias("second"), further.alias("further")))


def proximity(ranked: DataFrame, index: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc_id, row, tid1, tid2, apart, pos, off) of the places where two rarest terms of a window stand ``off`` words,
    at most ``slop``, off their distance ``apart``; ``pos`` is that of the rarest."""
    asked = written(ranked.select(F.col("first.tid").alias("tid1"), F.col("second.tid").alias("tid2"), (F.col("second.at") - F.col("first.at")).alias("apart")).distinct())
    rarest = index.join(maybe_broadcast(asked), F.col("tid") == F.col("tid1")).select(*DOC, "tid1", "tid2", "apart", "pos", (F.col("pos") + F.col("apart")).alias("want"))
    width = 2 * slop + 1
    cells = F.array_distinct(F.array(F.floor((F.col("want") - slop) / width), F.floor((F.col("want") + slop) / width)))
    rarest = rarest.withColumn("cell", F.explode(cells))
    seconds = written(asked.select("tid2").distinct())
    # equal rows have equal postings, of which one answers all
    lists = index.join(maybe_broadcast(seconds), F.col("tid") == F.col("tid2")).select(*(F.col(c).alias(f"_{c}") for c in DOC), F.col("tid").alias("_tid2"), F.floor(F.col("pos") / width).alias("_cell"), F.col("pos").alias("_pos")).distinct()
    off = F.col("_pos") - F.col("want")
    return rarest.join(lists, same([*DOC, "tid2", "cell"]) & (F.abs(off) <= slop)).select(*DOC, "tid1", "tid2", "apart", "pos", off.alias("off"))


def phrases(ranked: DataFrame, index: DataFrame, near: DataFrame) -> DataFrame:
    """(doc_id, row, start, n, items) of every exact occurrence of a window."""
    whole = ranked.where("complete").select("wid", "n", F.col("first.tid").alias("_tid1"), F.col("second.tid").alias("_tid2"), (F.col("second.at") - F.col("first.at")).alias("_apart"), F.col("first.at").alias("at1"), "further")
    both = near.where("off = 0").distinct().join(maybe_broadcast(written(whole)), same(["tid1", "tid2", "apart"]))
    both = written(both.select(*DOC, "wid", "n", (F.col("pos") - F.col("at1")).alias("start"), "further").where("start >= 0"))
    left = written(both.select(*(F.col(c).alias(f"_{c}") for c in DOC)).distinct())
    lists = index.join(maybe_broadcast(left), same(DOC), "left_semi").select(*(F.col(c).alias(f"_{c}") for c in [*DOC, "tid", "pos"]))
    asked = both.where(F.size("further") > 0).select(*DOC, "wid", "start", F.size("further").alias("asked"), F.explode("further").alias("x")).select(*DOC, "wid", "start", "asked", "x.tid", (F.col("start") + F.col("x.at")).alias("pos"))
    in_all = asked.join(lists, same([*DOC, "tid", "pos"]), "left_semi").groupBy(*DOC, "wid", "start").agg(F.count("*").alias("have"), F.first("asked").alias("asked")).where("have = asked").select(*DOC, "wid", "start")
    short = both.where(F.size("further") == 0).select(*DOC, "wid", "start")
    return in_all.union(short).join(maybe_broadcast(written(ranked.select("wid", "n", "items"))), "wid").select(*DOC, "start", "n", "items")


@tidy
def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (places of proximity matches) of every
    document; row tells texts of one doc_id apart."""
    wins = windows(benchmark)
    terms = vocabulary(wins)
    index = build_index(docs, terms)
    ranked = rank(wins, terms, index)
    near = written(proximity(ranked, index))
    places = near.groupBy(*DOC).agg(F.count_distinct("tid1", "tid2", "apart", "pos").alias("near"))
    found = phrases(ranked, index, near).groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    hit = F.aggregate("spans", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["start"] + s["n"]).alias("end")))["n"]
    found = found.select(*(F.col(c).alias(f"_{c}") for c in DOC), hit.alias("hit"), F.sort_array("items").alias("items"))
    places = places.select(*(F.col(c).alias(f"__{c}") for c in DOC), "near")
    ends = written(index.where("tid = -1").select(*DOC, F.col("pos").cast("long").alias("n_words")))
    both = ends.join(maybe_broadcast(written(found)), same(DOC), "left").join(maybe_broadcast(written(places)), same(DOC, right="__"), "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return both.select(*DOC, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"))
