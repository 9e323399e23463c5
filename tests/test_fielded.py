"""Fielded answers and rewriting on literal rows."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import fielded, rewriting
from corpusmill.operators.fielded import Query

LABELS = "array<struct<id: string, type: string, value: string, relationship: string>>"
ROWS = f"id int, title string, description string, passages string, geographies array<string>, identifiers array<string>, counts map<string,double>, published long, labels {LABELS}"


def label(i):
    return (i, i.split("::")[0], i.split("::")[1], "tagged")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "Climate act", "about law", "net zero by 2050, at $100", ["United Kingdom"], ["AB 12"], {"Q1": 3.0}, 10, [label("concept::Q1"), label("k::a")]),
        (2, "zero net", None, "at $1000 the zero of net things", ["United States"], [], {"Q1": 200.0}, None, [label("concept::Q1"), label("k::b")]),
        (3, None, "Zebra", None, None, None, None, 5, []),
        (4, "alpha beta gamma", "", "the electric cars", ["New Zealand"], ["ab 12"], {}, 7, None),
        (4, "alpha beta gamma", "", "the electric cars", ["New Zealand"], ["ab 12"], {}, 7, None),
    ]
    return spark.createDataFrame(rows, ROWS)


def ids(docs, *queries, **more):
    out = fielded.answered(docs, ["id"], list(queries), **more).orderBy("query_id", "rank").collect()
    return {q.query_id: [r.id for r in out if r.query_id == q.query_id] for q in queries}


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_rewrites(spark):
    base = {n: rewriting.rulebase(n) for n in ("documents", "labels", "passages")}
    of = lambda q, n: one(spark, rewriting.variants(F.lit(q), base[n]))
    assert of("NZ", "documents") == ["nz", "net zero"] and of("nz", "labels") == ["net zero"]
    assert of("tcfd", "labels") == ["task force on climate related financial disclosures"]
    assert of("a nature-based solution law", "passages") == ["a nature based solution law", "a nature based solution act", "a nbs law", "a nbs act"]
    assert of("nature based nz", "passages") == ["nature based nz", "nature based net zero"]
    assert one(spark, rewriting.items(F.lit("evs phaseout"), base["passages"])) == ["evs", "electric car", "electric vehicle", "phase", "out"]
    assert one(spark, rewriting.variants(F.lit(""), base["documents"])) == [""]
    assert one(spark, rewriting.variants(F.lit(None).cast("string"), base["documents"])) is None


def test_fields_geographies_and_identifiers(docs):
    got = ids(docs, Query(1, "nz"), Query(2, "UK"), Query(3, "ab 12"), Query(4, "$100"), Query(5, "nothing here"), Query(6, "law"))
    # a geography weighs more than a phrase of one text; of the two names with "united" only the asked one is meant
    assert got == {1: [4, 4, 1], 2: [1], 3: [1, 4, 4], 4: [1], 5: [], 6: [1]}


def test_title_counts_order_and_wholeness(docs):
    rows = {r.id: r for r in fielded.answered(docs, ["id"], [Query(1, "zero net"), Query(2, "alpha beta gamma")]).collect()}
    # next to each other in order, and nothing else in the title
    assert rows[2].title_score == pytest.approx(3 * rows[2].title_synonyms_score + 1 + 1, abs=1e-5)
    assert rows[4].title_score == pytest.approx(3 * rows[4].title_synonyms_score + 2, abs=1e-5) and rows[4].total_size == 2


def test_topics_count_only_without_an_order(docs):
    tree = {"field": "labels.value.id", "op": "contains", "value": "concept::Q1"}
    assert ids(docs, Query(1, None, tree), Query(2, None, tree, "published"), Query(3, "climate net zero", tree)) == {1: [2, 1], 2: [1, 2], 3: [2, 1]}
    assert ids(docs, Query(3, "climate law", tree), topic_weight=0.0) == {3: [1]}
    rows = fielded.answered(docs, ["id"], [Query(2, None, tree, "published")]).collect()
    assert {r.topic_score for r in rows} == {0.0}


def test_missing_values_come_last_either_way(docs):
    q = [Query(1, None, None, "published", True), Query(2, None, None, "published", False), Query(3, None, None, "title", True), Query(4, None, None, "title", False)]
    assert ids(docs, *q) == {1: [1, 4, 4, 3, 2], 2: [3, 4, 4, 1, 2], 3: [2, 1, 4, 4, 3], 4: [4, 4, 1, 2, 3]}


def test_pages_and_totals(docs):
    rows = fielded.answered(docs, ["id"], [Query(1, None, size=2, number=2), Query(2, None, size=2, number=9)]).collect()
    assert sorted((r.rank, r.total_size) for r in rows) == [(3, 5), (4, 5)]


def test_many_filters_in_one_bitmap(spark, docs):
    has = lambda v: {"field": "labels.value.id", "op": "contains", "value": v}
    trees = [None, {"op": "and", "filters": []}, has("k::a"), {"op": "and", "filters": [has("concept::Q1"), {**has("k::a"), "op": "not_contains"}]}] * 40
    got = docs.select("id", fielded.bitmaps([Query(i, None, t) for i, t in enumerate(trees)]).alias("m")).distinct().collect()
    passes = {r.id: [i for i in range(160) if r.m[i // fielded.BITS] >> i % fielded.BITS & 1] for r in got}
    assert passes[1] == [i for i in range(160) if i % 4 < 3] and passes[2] == [i for i in range(160) if i % 4 in (0, 1, 3)] and passes[3] == [i for i in range(160) if i % 4 < 2]


def test_no_documents(spark, docs):
    assert fielded.answered(docs.limit(0), ["id"], [Query(1, "a"), Query(2)]).count() == 0
