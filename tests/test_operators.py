"""Literal cases of the operators that the given tables cannot show."""

import json
import zlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import analysis, derive, detectors, documents, facets, feeds, filters, labels, metrics, nearness, runs, scores, selection, updates
from corpusmill.sources import jsonl, readers, shards
from corpusmill.streaming import passages as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rewrites_and_synonyms(spark):
    phrases = lambda q: analysis.rewritten(F.lit(q))
    hit = lambda q, text: one(spark, analysis.any_phrase(F.lit(text), phrases(q)))
    assert hit("ndc", "the nationally-determined contribution of a state") and hit("nature based solution", "an NBS for cities")
    assert hit("gga", "the global goal on adaptation") and not hit("gga", "adaptation of the global goal") and hit("evs", "one electric vehicle")
    assert "united kingdom" in one(spark, analysis.with_synonyms(F.lit("UK"))) and "united states" not in one(spark, analysis.with_synonyms(F.lit("UK")))


def test_currency(spark):
    hit = lambda q, t: one(spark, F.size(F.array_except(analysis.analyzed(F.lit(q)), analysis.analyzed(F.lit(t)))) == 0)
    assert hit("$100", "it costs $100 today") and not hit("$100", "it costs $1000 today")
    assert one(spark, derive.currency_words(F.lit("£5 €6"))) == "pound5 euro6"


def test_exact_phrase_has_currency_words(spark):
    hit = lambda q, t: one(spark, analysis.exact_phrase(F.lit(t), q))
    assert hit("Of, the", "one OF%%% the&&& way") and not hit("Of, the", "Of$$$ the&&& way") and not hit("Of, the", "of € the way")
    assert hit("$100", "a grant of $100 was") and not hit("$100", "a grant of 100 was") and not hit("$100", "£100") and not hit("100", "$100")
    assert hit("istanbul", "in İSTANBUL") and not hit("of the", "İof the") and not hit("--", "a -- b")


def test_highlight(spark):
    assert one(spark, analysis.highlighted(F.lit("A Thing, things and thing."), ["thing"])) == "A <hi>Thing</hi>, things and <hi>thing</hi>."
    assert one(spark, analysis.highlighted(F.lit("C++ (or C) and É, CC"), ["c++", "c", "(", "é"])) == "<hi>C++</hi> (or <hi>C</hi>) and <hi>É</hi>, CC"
    assert one(spark, analysis.highlighted(F.lit("a.b acb"), ["a.b"])) == "<hi>a.b</hi> acb" and one(spark, analysis.highlighted(F.lit("a"), [])) == "a"


def test_control_characters_and_values(spark):
    from corpusmill.operators import search

    assert one(spark, search.strip_controls(F.lit("a\x00b\x0bc\td\n\r\x1fe"))) == "abc\td\n\re"
    assert one(spark, derive.parsed_value(F.lit('Keyword("a "b" c")'))) == 'a "b" c' and one(spark, derive.parsed_value(F.lit("plain"))) == "plain"


def test_keys(spark):
    kind, middle, value = documents.parsed_key(F.lit("geography::geography::USA::United States of America"))
    assert [one(spark, c) for c in (kind, middle, value)] == ["geography", "geography::USA", "United States of America"]


def test_reference_lists(spark):
    entries = "Hansen, J., Sato, M. (2019). Storms. Nature, 5. doi:10.1. Lal, R. (2016). Soils. Geoderma, 2018. https://a.b Retrieved 2020. " * 2
    prose = "The committee of the parties decided that it will be in force for all of the members as it was agreed in the text of the treaty. " * 2
    contacts = "Smith, J. (2019). Tel. 55 Fax 66 E-mail a@b.c. Jones, K. (2018). Tel. 77 Fax 88 E-mail d@e.f. Brown, L. (2017). Tel. 99." * 2
    assert [one(spark, detectors.reference_list(F.lit(t))) for t in (entries, prose, contacts, "J. (2019). doi:1")] == [True, False, False, False]


def test_questionnaires(spark):
    said = [one(spark, derive.questionnaire(F.lit(t))) for t in ("Is it? Yes/No", "Is it? Perhaps", "yes/no", "Is it? n/a")]
    assert said == [True, False, False, True] and not one(spark, derive.questionnaire(F.lit("not applicable")))


def test_closure_of_a_long_chain_and_a_cycle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "parent int, child int")
    assert derive.closure(chain).count() == 100 * 101 // 2
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (None, 1)], "parent int, child int")
    assert derive.closure(cycle).count() == 9


def test_direct_parents_skip_the_grandparent(spark):
    paths = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C")], "ancestor string, descendant string")
    assert sorted(map(tuple, derive.direct_parents(paths).collect())) == [("B", "A"), ("C", "B")]


def test_return_at_midnight_does_not_count(spark):
    rows = [(1, "2024-01-01 10:00:00", "u", "/search", "a"), (2, "2024-01-02 00:00:00", "u", "/x", "b"), (3, "2024-01-01 11:00:00", "v", "/search", "c"), (4, "2024-01-02 00:00:01", "v", "/x", "d")]
    events = spark.createDataFrame(rows, "event_id int, ts string, distinct_id string, url string, session_id string").withColumn("ts", F.to_timestamp("ts"))
    assert metrics.retention(events, 7).first().value == 50.0


def test_non_searchers(spark):
    rows = [(1, "2024-01-01 10:00:00", "u", "/a", "a"), (2, "2024-01-05 00:00:00", "u", "/x", "b"), (3, "2024-01-01 11:00:00", "v", "/search", "c"), (4, "2024-01-01 11:00:00", "w", "/a", "d")]
    events = spark.createDataFrame(rows, "event_id int, ts string, distinct_id string, url string, session_id string").withColumn("ts", F.to_timestamp("ts"))
    assert metrics.non_searcher_retention(events).first().value == 50.0


def test_disjunctive_facets(spark):
    label = "array<struct<id:string,type:string,value:string,relationship:string>>"
    docs = lambda rows: spark.createDataFrame([([(f"{t}::{v}", t, v, "r") for t, v in r],) for r in rows], f"labels {label}")
    has = lambda i, op="contains": {"field": "labels.value.id", "op": op, "value": i}
    got = lambda d, tree: {(r.value, r["count"]) for r in facets.disjunctive(d, tree).collect()}
    three = docs([[("category", "Law")], [("category", "Law")], [("category", "Policy")]])
    assert got(three, {"op": "and", "filters": [has("category::Law")]}) == {("Law", 2), ("Policy", 1)}
    assert got(three, {"op": "and", "filters": [has("category::Policy", "not_contains")]}) == {("Law", 2), ("Policy", 1)}
    two = docs([[("category", "Law"), ("geography", "USA")], [("category", "Policy"), ("geography", "USA")], [("category", "Law"), ("geography", "GBR")]])
    assert got(two, {"op": "and", "filters": [has("category::Law"), has("geography::USA")]}) == {("Law", 1), ("Policy", 1), ("USA", 1), ("GBR", 1)}
    assert filters.label_type(has("plain")) is None


def test_flat_facets_have_no_limit(spark):
    docs = spark.range(6000).select(F.array(F.struct(F.lit("t").alias("type"), F.col("id").cast("string").alias("value"))).alias("labels"))
    assert facets.flat(docs).count() == 6000 and facets.flat(docs, most=5).count() == 5


def test_sparse_map_scores(spark):
    maps = [{"Q13": 0.98}, {"Q13": 0.5, "Q14": 0.6}, {"Q14": 0.2}]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,double>")
    got = [r.s for r in df.select("i", F.round(scores.blended(F.col("m"), F.create_map().cast("map<string,double>"), {"Q13": 0.99, "Q14": 0.5}, 5.0, 0.0), 4).alias("s")).orderBy("i").collect()]
    assert got == [4.851, 3.975, 0.5]


def test_topic_scores(spark):
    many, few = F.create_map(F.lit("a"), F.lit(200)), F.create_map(F.lit("a"), F.lit(1))
    assert one(spark, scores.document_topics(many, ["a"])) > one(spark, scores.document_topics(few, ["a"])) and one(spark, scores.document_topics(many, ["a"], 0.0)) == 0
    assert one(spark, scores.passage_topics(F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(1)), ["a", "b"])) == 2.0


def test_updates_touch_only_known_ids_unless_they_create(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, f string, g string")
    assign = "id int, f struct<assign:string>, g struct<assign:string>"
    changes = spark.createDataFrame([(1, (None,), None), (3, ("n",), None)], assign)
    got = {r.id: (r.f, r.g) for r in updates.apply_updates(base, changes, "id").collect()}
    assert got == {1: (None, "x"), 2: ("b", "y")}
    assert updates.apply_updates(base, changes, "id", create=True).count() == 3


def test_labels_from_topics(spark):
    topic = "struct<concept_id:string,classifier_id:string,start_index:int,end_index:int,labelled_text:string,labellers:array<string>,prediction_probability:double,timestamps:array<string>>"
    rows = [("p1", ([("Q1", "c", 0, 2, "ab", ['Keyword("x")'], 0.5, []), ("Q1", "c", 3, 4, "c", ["y"], 0.5, [])],)), ("p2", None)]
    records = spark.createDataFrame([(u, (t,)) for u, t in rows], f"update string, fields struct<topics:struct<assign:array<{topic}>>>")
    got = {r.update: r.fields for r in feeds.labels_from_topics(records).collect()}
    assert [x.value for x in got["p1"].labels.assign] == ["x", "y"] and got["p1"].concept_counts.assign == {"concept::Q1": 2} and got["p2"].labels.assign == []


def test_chunks(spark, tmp_path):
    jsonl.write_updates(spark.range(27).coalesce(1), str(tmp_path / "u"), per_file=10)
    counts = [sum(1 for line in open(f)) for f in (tmp_path / "u").glob("*.json")]
    assert max(counts) <= 10 and sum(counts) == 27


def test_sources(spark, tmp_path):
    for d in ("docs", "blocks", "inf", "parts"):
        (tmp_path / d).mkdir()
    (tmp_path / "docs" / "a.jsonl").write_text(json.dumps({"id": "1", "title": "t", "attributes": {"a": "5", "b": 5, "c": True, "identifier::n": "k"}}) + "\n\n")
    got = readers.documents(spark, str(tmp_path / "docs")).select("id", *(c.alias(n) for n, c in documents.typed_attributes(F.col("attributes")).items())).first()
    assert got.attributes_string == {"a": "5", "identifier::n": "k"} and got.attributes_double == {"b": 5.0} and got.attributes_boolean == {"c": 1} and got.identifiers == {"n": "k"}
    (tmp_path / "blocks" / "d1_translated_en.json").write_text(json.dumps({"pdf_data": {"text_blocks": [{"id": "b0", "idx": 0, "text": "x"}, {"id": "b1", "idx": 1, "text": "y"}]}}, indent=1))
    (tmp_path / "blocks" / "d2.json").write_text(json.dumps({"pdf_data": None}))
    assert [(r.document_id, r.id) for r in readers.text_blocks(spark, str(tmp_path / "blocks")).orderBy("idx").collect()] == [("d1", "b0"), ("d1", "b1")]
    (tmp_path / "inf" / "d1.json").write_text(json.dumps({"b0": [{"id": "Q1"}, {"id": "Q1"}], "b1": []}))
    assert [(r.document_id, r.passage_id, r.concept.id) for r in readers.inferences(spark, str(tmp_path / "inf")).collect()] == [("d1", "b0", "Q1")] * 2
    (tmp_path / "wide.csv").write_text("doc,note,air|Q1,sea.x|Q2\n1,n,2,\n2,m,zero,1.0\n")
    assert {tuple(r) for r in readers.labelled_wide(spark, str(tmp_path / "wide.csv"), ["doc"]).collect()} == {("1", "Q1", 2), ("2", "Q2", 1)}
    for i in range(3):
        (tmp_path / "parts" / f"p{i}.json").write_text(json.dumps({"id": i}) + "\n")
    assert [r.id for r in readers.parts(spark, str(tmp_path / "parts"), "id int", 2).orderBy("id").collect()] == [0, 1]


def test_hash_sample_follows_crc32(spark):
    rows = spark.createDataFrame([(f"doc.{i}",) for i in range(200)] + [(None,)], "d string")
    got = {r.d for r in rows.where(filters.hash_sample(F.col("d"), 30)).collect()}
    assert got == {f"doc.{i}" for i in range(200) if zlib.crc32(f"doc.{i}".encode()) % 100 < 30} | {None}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"id": 1, "content": "A HEADING", "type": "Text"}) + "\n")
    out = streams.derived(spark, str(tmp_path / "in"), "id int, content string, type string").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first().looks_like_short_heading
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, f string").write.parquet(str(tmp_path / "base"))
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.json").write_text(json.dumps({"id": 1, "f": {"assign": "z"}}) + "\n")
    q = streams.apply_stream(spark.readStream.schema("id int, f struct<assign:string>").json(str(tmp_path / "up")), str(tmp_path / "base"), "id", str(tmp_path / "c2"), str(tmp_path / "t"))
    q.awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "version=0")).collect()} == {(1, "z"), (2, "b")}


def test_unknown_field_raises():
    with pytest.raises(ValueError):
        filters.build({"op": "and", "filters": [{"field": "x", "op": "contains", "value": 1}]})


def test_contents_listings(spark):
    listing = "Foreword ii\nThe state of the seas .... 3\nWhat was done .... 7\nWhat is left .... 12\nThanks to all xv"
    falling = "The seas .... 30\nThe lakes .... 20\nThe rivers .... 12\nThe wells .... 7\nThe rain .... 3"
    numbered = "3.1 Seas\n3.2 Lakes\n3.3 Rivers\n3.4 Wells\n3.5 Rain"
    table = "Seas\n1.0\n2.0\nLakes\n3.0\nRivers\nWells\nRain\nContents\n4.5\n6.1"
    equations = "Contents\na = b here\nc = d here\nthe sea\nthe lake\nthe rain"
    split = "Seas of old\n3\nLakes of old\n7\n3.1.2\n3.1.3\nRivers of old\nWells of old\nRain of old"
    rows = [("a", listing, None), ("b", listing, 11), ("c", falling, 1), ("d", numbered, 10), ("e", table, 1), ("f", equations, 1), ("g", split, 1), ("h", None, 1), ("i", "", None)]
    got = detectors.contents_listings(spark.createDataFrame(rows, "k string, content string, page_number int")).where("looks_like_table_of_contents")
    assert {r.k for r in got.collect()} == {"a", "d", "g"}


def test_folios(spark):
    assert [one(spark, detectors.folio(F.lit(t))) for t in ("12", "xiv", "MCM", "iiv", "", "x1")] == [12, 14, 1900, 3, None, None]


def test_entities_of_odd_shapes(spark):
    rows = [("Q1", '{"labels": {"en": {"value": "seas"}}, "aliases": [], "descriptions": [], "claims": []}'), ("Q2", '{"labels": []}'), ("Q3", "no json"), ("Q4", None), ("Q5", '{"labels": {"en": {"value": ""}}}')]
    got = labels.concepts(spark.createDataFrame(rows, "id string, json string")).collect()
    assert [(r.id, r.preferred_label, r.alternative_labels, r.description, r.negative_labels) for r in got] == [("Q1", "seas", [], None, [])]


def test_shards_are_bounded_and_stale_ones_go(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(4000).select("id", F.lit("x" * 50).alias("t"))
    assert shards.write_shards(rows, path, 20_000) > 10
    first = list((tmp_path / "out").glob("*.json"))
    assert max(f.stat().st_size for f in first) < 40_000
    assert shards.write_shards(rows.limit(100), path, 20_000) == 1 and len(list((tmp_path / "out").glob("*.json"))) == 1
    assert shards.write_shards(rows.limit(0), path) == 1
    shards.write_results(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), str(tmp_path / "r"))
    assert [json.loads(x) for f in (tmp_path / "r").glob("*.json") for x in f.read_text().splitlines()] == [{"a": 1, "b": None}]


def test_run_ids_depend_on_the_outcomes_only(spark):
    rows = [("e", 1, True), ("e", 2, False), ("f", 1, True)]
    ids = lambda r: {x.engine: x.run_id for x in runs.run_ids(spark.createDataFrame(r, "engine string, case_id int, passed boolean")).collect()}
    assert ids(rows) == ids(rows[::-1]) and ids(rows)["e"] != ids([("e", 1, True), ("e", 2, True)])["e"] and len(ids(rows)["e"]) == 8


def test_percent_ranks_with_ties_and_one_row(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 5), ("b", 2)], "g string, v int")
    assert sorted((r.g, r.v, r.p) for r in selection.percent_ranks(rows, "g", "v", "p").collect()) == [("a", 1, 0.0), ("a", 1, 0.0), ("a", 5, 1.0), ("b", 2, 0.0)]


def test_nearest_are_bounded_and_matches_stay(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], False), (2, [1.0, 0.1], False), (3, [0.0, 1.0], True), (4, [0.0, -1.0], False), (5, [0.0, 0.0], False)], "id int, v array<double>, m boolean")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, query_vector array<double>")
    got = nearness.hybrid(rows, "id", "v", F.col("m"), asked, most=1).collect()
    assert sorted((r.id, r.near, r.matched) for r in got) == [(1, True, False), (3, False, True)]


def test_retention_needs_time():
    with pytest.raises(ValueError):
        metrics.old_enough(date(2024, 1, 10), 30, date(2024, 1, 31))
    assert metrics.old_enough(date(2024, 1, 1), 30, date(2024, 1, 31)) == date(2024, 1, 1)
