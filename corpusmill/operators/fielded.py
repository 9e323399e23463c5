"""Answers over documents of several fields, for a batch of stated queries in one pass over the texts.

The pass leaves one row for each document without its texts: the lengths of its fields, the places of the asked words
and phrases by field and term, and a bitmap of the queries whose filter it passes. Statistics, matches, scores and pages
come from that table; the places of a document are never shuffled, and what is ranked is limited to a page before the
shuffle.

A document answers a query if it passes the filter and has one of the query's words or phrases in a field, a
geography by any of its names, or the whole query as an identifier; without text it only needs to pass. A field's rank
is BM25 divided by the most that it can reach, so between 0 and 1. Ties go by key. Null fields are empty.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import analysis, filters, nearness, rewriting, scores, tables

#: Length normalisation and term saturation.
B, K1 = 0.4, 1.2
#: Fields that the words of a query are looked for in, with the profile of their analysis.
DEFAULT = {"title": "title", "description": "title", "passages": "passage"}
#: Queries in one word of a bitmap.
BITS = 62


@dataclass(frozen=True)
class Query:
    """``order`` is None (by relevance), ``title`` or a numeric column such as ``published`` or, of passages, ``idx``; sorted
    lists have missing values last either way."""

    query_id: int
    text: str | None = None
    tree: dict | None = None
    order: str | None = None
    descending: bool = True
    size: int = 10
    number: int = 1

    def topics(self) -> list[str]:
        """The topics that count for the score: those of the filter, unless the list is sorted."""
        return [] if self.order else [t.removeprefix("concept::") for t in scores.topic_ids(self.tree)]


def bitmaps(queries: list[Query], arrays: tuple[str, ...] = ("labels",), same_element: bool = False) -> Column:
    """An array of words; bit i tells whether a row passes the filter of query i.

    The conditions of all trees are looked at once each, whatever number of queries has them.
    """
    known: dict[str, Column] = {}

    def passes(tree: dict | None) -> Column:
        name = json.dumps(tree, sort_keys=True)
        if name not in known:
            if not tree or "filters" not in tree or same_element:
                known[name] = filters.build(tree, same_element, arrays)
            else:
                parts = [passes(c) for c in tree["filters"] if c.get("filters") or "field" in c]
                known[name] = reduce(and_ if tree["op"] == "and" else or_, parts) if parts else F.lit(True)
        return known[name]

    bits = [F.when(passes(q.tree), F.lit(1 << i % BITS)).otherwise(F.lit(0)).cast("long") for i, q in enumerate(queries)]
    return F.array(*(reduce(add, bits[k : k + BITS]) for k in range(0, len(bits), BITS)))


def asked(spark, queries: list[Query], base: dict[str, list[str]], names: dict[str, list[str]]) -> list[dict]:
    """What each stated query looks for in which field."""
    rows = spark.createDataFrame([(i, q.text) for i, q in enumerate(queries)], "i int, q string")
    q = F.col("q")
    read = rows.select("i", rewriting.items(q, base).alias("items"), rewriting.items(q, {}).alias("words"), rewriting.items(q, names).alias("places"), F.lower(F.trim("q")).alias("whole")).collect()
    return [r.asDict() for r in sorted(read, key=lambda r: r.i)]


def found(tokens: Column, field: str, terms: set[str]) -> Column:
    """The places (field, term, pos) of words and phrases among the tokens."""
    single, phrases = sorted(t for t in terms if " " not in t), sorted(t for t in terms if " " in t)
    placed = F.transform(tokens, lambda t, i: F.struct(F.lit(field).alias("field"), t.alias("term"), i.alias("pos")))

    def phrase(p: str) -> Column:
        ws = p.split()
        stands = lambda x: reduce(and_, (F.coalesce(F.get(tokens, x["pos"] + j) == w, F.lit(False)) for j, w in enumerate(ws)))
        return F.transform(F.filter(placed, stands), lambda x: F.struct(F.lit(field).alias("field"), F.lit(p).alias("term"), x["pos"].alias("pos")))

    parts = [F.filter(placed, lambda x: x["term"].isin(single))] if single else []
    parts += map(phrase, phrases)
    return F.concat(*parts) if parts else F.array().cast("array<struct<field: string, term: string, pos: int>>")


def index(docs: DataFrame, keys: list[str], fields: dict[str, str], wanted: dict[str, set[str]], mask: Column, topics: list[str], also: dict[str, Column]) -> DataFrame:
    """One row for each document: keys, mask, sizes and unlike (tokens and different tokens by field), places by field:term
    and the counts of the asked topics.

    ``docs`` has the fields as strings, geographies and identifiers as arrays of strings, and ``counts`` (map, or null).
    """
    names = F.transform(F.coalesce("geographies", F.array().cast("array<string>")), lambda g: F.concat(analysis.words(g), F.array(F.lit(""))))  # a gap between names
    ids = F.transform(F.coalesce("identifiers", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    tokens = {f: analysis.analyzed(F.coalesce(f, F.lit("")), profile) for f, profile in fields.items()} | {"geographies": F.flatten(names)}
    rows = docs.select(*keys, *also, mask.alias("mask"), F.map_filter(F.coalesce("counts", F.create_map().cast("map<string,double>")), lambda k, _: k.isin(topics or [""])).alias("counts"), *(c.alias(f"_{f}") for f, c in tokens.items()), ids.alias("_ids"))
    whole = sorted(wanted.get("identifiers", set()))
    places = [found(F.col(f"_{f}"), f, wanted.get(f, set())) for f in tokens]
    places.append(F.transform(F.filter("_ids", lambda x: x.isin(whole or [""])), lambda x: F.struct(F.lit("identifiers").alias("field"), x.alias("term"), F.lit(0).alias("pos"))))
    rows = rows.withColumn("_hits", F.concat(*places))
    key = lambda x: F.concat_ws(":", x["field"], x["term"])
    by = F.transform(F.array_distinct(F.transform("_hits", key)), lambda k: F.struct(k, F.transform(F.filter("_hits", lambda x: key(x) == k), lambda x: x["pos"])))
    sizes = F.create_map(*(x for f in fields for x in (F.lit(f), F.size(f"_{f}"))))
    return rows.select(*keys, *also, "mask", "counts", sizes.alias("sizes"), F.size(F.array_distinct("_title")).alias("unlike") if "title" in fields else F.lit(0).alias("unlike"), F.map_from_entries(by).alias("places"))


def answered(
    docs: DataFrame, keys: list[str], queries: list[Query], base: dict[str, list[str]] | None = None, names: dict[str, list[str]] | None = None, fields: dict[str, str] = DEFAULT,
    arrays: tuple[str, ...] = ("labels",), weights: dict[str, float] = scores.FIELDS, topic_weight: float = 1.0, flags: dict[str, str] | None = None,
) -> DataFrame:
    """query_id, keys, rank, total_size, the scores of the fields and ``score`` of each query's page.

    ``docs``: keys, title and the other ``fields``, geographies and identifiers (arrays of strings), counts (topic to count),
    published and the label arrays that filters ask for; geographies and identifiers may be missing.

    With ``flags`` (penalty to boolean column) the rows are passages: their score is the rank of their fields less the
    penalties of their flags, and one for each asked topic that they carry; positive conditions of an AND group must hold in
    one element.
    """
    spark = docs.sparkSession
    for c in ("geographies", "identifiers"):
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast("array<string>"))
    base = rewriting.rulebase("documents") if base is None else base
    names = rewriting.geographies() if names is None else names
    looks = asked(spark, queries, base, names)
    wanted: dict[str, set[str]] = {f: set() for f in (*fields, "geographies", "identifiers")}
    for q in looks:
        for f in fields:
            wanted[f] |= {*(q["items"] or []), *((q["words"] or []) if f == "title" else [])}
        wanted["geographies"] |= set(q["places"] or [])
        wanted["identifiers"] |= {q["whole"]} - {None, ""}
    topics = sorted({t for q in queries for t in q.topics()})
    numeric = sorted({q.order for q in queries} - {None, "title"})
    rows = docs.withColumn("title_key", F.lower("title") if "title" in docs.columns else F.lit(""))
    rows = rows.withColumns({f"_by_{c}": F.col(c).cast("double") for c in numeric} | {f"_is_{k}": F.col(c) for k, c in (flags or {}).items()})
    also = ["title_key", *(f"_by_{c}" for c in numeric), *(f"_is_{k}" for k in flags or {})]
    known = tables.kept(index(rows, keys, fields, wanted, bitmaps(queries, arrays, flags is not None), topics, also))

    # stated queries only: one row of sizes, one for each asked field and term
    n, *lengths = known.agg(F.count("*"), *(F.avg(F.col("sizes")[f]) for f in fields)).first()
    average = {f: x or 1.0 for f, x in zip(fields, lengths, strict=True)}
    df = {r.k: r.n for r in known.select(F.explode(F.map_keys("places")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    idf = lambda f, t: F.log(F.lit(1 + (n - df.get(f"{f}:{t}", 0) + 0.5) / (df.get(f"{f}:{t}", 0) + 0.5)))

    answers: dict[str, list[int]] = {}
    for i, (q, look) in enumerate(zip(queries, looks, strict=True)):
        for f, terms in [*((f, look["items"]) for f in fields), ("title", look["words"]), ("geographies", look["places"]), ("identifiers", [look["whole"]] if look["whole"] else [])]:
            for t in terms or []:
                answers.setdefault(f"{f}:{t}", []).append(i)
    none = F.array().cast("array<int>")
    matches = F.create_map(*(x for k, v in answers.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(set(v))))))) if answers else F.create_map().cast("map<string,array<int>>")
    every = [i for i, q in enumerate(queries) if not looks[i]["words"]]
    hit = F.array_distinct(F.concat(F.flatten(F.transform(F.map_keys("places"), lambda k: F.coalesce(F.try_element_at(matches, k), none))), F.array(*map(F.lit, every)).cast("array<int>")))
    allowed = F.filter(hit, lambda i: F.getbit(F.get("mask", F.floor(i / BITS).cast("int")), i % BITS) == 1)
    pairs = known.withColumn("_i", F.explode(allowed))

    listed = spark.createDataFrame(
        [(i, q.query_id, looks[i]["items"] or [], looks[i]["words"] or [], looks[i]["places"] or [], looks[i]["whole"] or "", q.topics(), q.order, q.descending, q.size, q.number) for i, q in enumerate(queries)],
        "_i int, query_id long, items array<string>, words array<string>, names array<string>, whole string, topics array<string>, _order string, _down boolean, _size int, _number int",
    )
    weight = {f: F.create_map(*(x for t in sorted(wanted[f]) for x in (F.lit(t), idf(f, t)))) if wanted[f] else None for f in fields}
    pairs = pairs.join(tables.stated(listed), "_i")
    at = lambda f, t: F.coalesce(F.try_element_at("places", F.concat(F.lit(f"{f}:"), t)), none)

    def rank(f: str, terms: str) -> Column:
        if weight[f] is None:
            return F.lit(0.0)
        norm = K1 * (1 - B + B * F.col("sizes")[f] / average[f])
        part = lambda t: weight[f][t] * F.size(at(f, t)) / (F.size(at(f, t)) + norm)
        return F.coalesce(F.try_divide(F.aggregate(terms, F.lit(0.0), lambda s, t: s + part(t)), F.aggregate(terms, F.lit(0.0), lambda s, t: s + weight[f][t])), F.lit(0.0))

    has = lambda f, terms: F.exists(terms, lambda t: F.size(at(f, t)) > 0).cast("double")
    ranks = {f: rank(f, "items") for f in fields} | {"title_synonyms": rank("title", "words") if "title" in fields else F.lit(0.0), "geographies": has("geographies", "names"), "identifiers": (F.size(at("identifiers", F.col("whole"))) > 0).cast("double")}
    near, whole = F.lit(0.0), F.lit(0.0)
    if "title" in fields:
        near = nearness.of_places(F.col("words"), lambda w: at("title", w))
        whole = F.coalesce(F.try_divide(F.size(F.filter(F.array_distinct("words"), lambda w: F.size(at("title", w)) > 0)), F.col("unlike")), F.lit(0.0))
    topic = topic_weight * F.aggregate("topics", F.lit(0.0), lambda s, t: s + F.log1p(F.coalesce(F.try_element_at("counts", t), F.lit(0.0))))
    parts = scores.document_score(ranks, near, whole, topic, weights)
    if flags is not None:
        text, is_ = reduce(add, (ranks[f] for f in fields)), {k: F.col(f"_is_{k}") for k in flags}
        carried = topic_weight * F.aggregate("topics", F.lit(0.0), lambda s, t: s + F.least(F.coalesce(F.try_element_at("counts", t), F.lit(0.0)), F.lit(1.0)))
        parts = {"text_score": text, "penalty": scores.penalty(is_), "topic_score": carried, "score": scores.additive(text, carried, is_)}
    scored = pairs.select("query_id", *keys, *(F.round(c, 6).alias(k) for k, c in parts.items()), "_order", "_down", "_size", "_number", *also)

    by = F.when(F.col("_order").isNull(), -F.col("score"))
    for c in numeric:
        by = by.when(F.col("_order") == c, F.when(F.col("_down"), -F.col(f"_by_{c}")).otherwise(F.col(f"_by_{c}")))
    name = lambda down: F.when((F.col("_order") == "title") & (F.col("_down") == down) & (F.col("title_key") != ""), F.col("title_key"))
    order = [by.asc_nulls_last(), name(False).asc_nulls_last(), name(True).desc_nulls_last(), *keys]
    last = max(q.size * q.number for q in queries)
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= last)
    page = ranked.where((F.col("rank") <= F.col("_size") * F.col("_number")) & (F.col("rank") > F.col("_size") * (F.col("_number") - 1)))
    totals = scored.groupBy("query_id").agg(F.count("*").alias("total_size"))  # one row for each stated query
    return page.join(F.broadcast(totals), "query_id").select("query_id", *keys, "rank", "total_size", *parts)
