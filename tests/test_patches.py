"""Folded patches, patched tables, counters, nested files and records."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import counters, detectors, feeds, updates
from corpusmill.sources import jsonl, nested
from corpusmill.streaming import patched

BASE = "id int, f string, g int"
PATCH = "id int, seq int, make boolean, f struct<assign:string>, g struct<assign:int>"


def log(seed, n=200):
    r = random.Random(seed)
    pick = lambda values: None if r.random() < 0.5 else (r.choice(values),)
    return [(r.randrange(12), i, r.random() < 0.2, pick(["a", "b", None]), pick([1, 2, None])) for i in range(n)]


def brute(base, patches):
    rows = {i: [f, g] for i, f, g in base}
    for i, _, make, f, g in sorted(patches, key=lambda p: p[1]):
        if i not in rows and make:
            rows[i] = [None, None]
        if i in rows:
            for k, v in enumerate((f, g)):
                if v is not None:
                    rows[i][k] = v[0]
    return {i: tuple(v) for i, v in rows.items()}


def as_dict(df):
    rows = df.collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: (r.f, r.g) for r in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_folds_equal_one_patch_after_the_other(spark, seed):
    base, patches = [(i, f"f{i}", i) for i in range(6)], log(seed)
    df = spark.createDataFrame(patches, PATCH)
    fold = lambda rows: updates.fold(rows, "id", "seq", F.col("make"))
    table = spark.createDataFrame(base, BASE)
    assert as_dict(updates.apply_folds(table, fold(df), "id")) == brute(base, patches)
    # folds of parts add up
    parts = [fold(df.where(F.col("seq") % 3 == k)) for k in range(3)]
    whole = parts[2].unionByName(parts[0]).unionByName(parts[1])
    assert as_dict(updates.apply_folds(table, updates.refold(whole, "id"), "id")) == brute(base, patches)


def test_a_second_update_needs_an_order(spark):
    base = spark.createDataFrame([(1, "a", 1)], BASE)
    twice = spark.createDataFrame([(1, ("x",)), (1, ("y",))], "id int, f struct<assign:string>")
    with pytest.raises(Exception, match="need an order"):
        updates.apply_updates(base, twice, "id").collect()
    ordered = spark.createDataFrame([(1, 2, ("x",)), (1, 1, ("y",)), (2, 1, ("z",))], "id int, seq int, f struct<assign:string>")
    assert as_dict(updates.apply_updates(base, ordered, "id", order="seq")) == {1: ("x", 1)}
    assert as_dict(updates.apply_updates(base, ordered, "id", create=True, order="seq")) == {1: ("x", 1), 2: ("z", None)}


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_a_stream_rewrites_only_what_it_touches(spark, tmp_path):
    target, feed = str(tmp_path / "t"), tmp_path / "feed"
    feed.mkdir()
    base = [(i, "old", i) for i in range(200)]
    patched.create(spark.createDataFrame(base, BASE), target, "id", 16)
    first = files(target)
    changes = lambda: spark.readStream.schema("id int, seq int, f struct<assign:string>").json(str(feed))
    (feed / "1.json").write_text("\n".join(json.dumps(x) for x in [{"id": 3, "seq": 2, "f": {"assign": "new"}}, {"id": 3, "seq": 1, "f": {"assign": "lost"}}, {"id": 900, "seq": 1, "f": {"assign": "made"}}]))
    patched.apply_stream(changes(), target, BASE, "id", "seq", str(tmp_path / "c"), buckets=16).awaitTermination()
    second = files(target)
    assert all(second[f] == t for f, t in first.items())
    assert len({f.split("bucket=")[1].split("/")[0] for f in set(second) - set(first) if "bucket=" in f}) <= 2
    (feed / "2.json").write_text(json.dumps({"id": 5, "seq": 9, "f": {"assign": None}}))
    patched.apply_stream(changes(), target, BASE, "id", "seq", str(tmp_path / "c"), buckets=16).awaitTermination()
    want = {i: ("old", i) for i in range(200)} | {3: ("new", 3), 900: ("made", None), 5: (None, 5)}
    assert as_dict(patched.read(spark, target, BASE)) == want
    # a batch that is run again gives the same table
    again = spark.createDataFrame([(5, 9, (None,))], "id int, seq int, f struct<assign:string>")
    patched.apply_batch(again, 1, target, BASE, "id", "seq", buckets=16)
    assert as_dict(patched.read(spark, target, BASE)) == want


def test_counters_start_anew(spark):
    rows = [("a", "2024-01-01 00:01:00", 5), ("a", "2024-01-01 00:02:00", 9), ("a", "2024-01-01 00:06:00", 3), ("a", "2024-01-01 00:07:00", 3), ("b", "2024-01-01 00:01:00", 7)]
    df = spark.createDataFrame(rows, "s string, t string, count int").selectExpr("s", "cast(t as timestamp_ntz) ts", "count")
    for most in (1, 10):
        assert [r.increase for r in counters.increases(df, ["s"], most=most).orderBy("ts").collect()] == [4.0, 3.0, 0.0]
    got = {r.window.minute: r.rate for r in counters.rates(df, ["s"]).collect()}
    assert got == {0: 4 / 300, 5: 3 / 300}
    assert counters.rates(df, ["s"], step="10 minutes").count() == 1


def test_an_unseen_reset_leaves_buckets_in_order(spark):
    rows = [(1, 10, 5.0), (1, 20, 5.0), (2, 10, 4.0), (2, 20, 6.0), (3, 10, 6.0), (3, 20, 8.0)]
    df = spark.createDataFrame([("s", f"2024-01-01 00:0{m}:00", float(le), c) for m, le, c in rows], "s string, t string, le double, count double").selectExpr("s", "cast(t as timestamp_ntz) ts", "le", "count")
    r = counters.histogram_quantiles(df, ["s"], [0.5]).first()
    assert 0 < r.q50 <= 10


def test_quantiles_lie_in_the_bucket_of_their_share(spark):
    rows = [(10.0, 80), (20.0, 81), (1000.0, 100)]
    df = spark.createDataFrame([("s", f"2024-01-01 00:0{m}:00", le, c * m) for m in (1, 2) for le, c in rows], "s string, t string, le double, count int").selectExpr("s", "cast(t as timestamp_ntz) ts", "le", "count")
    r = counters.histogram_quantiles(df, ["s"], [0.5, 0.9, 0.99]).first()
    assert r.q50 == pytest.approx(6.25) and r.q90 == pytest.approx(20 + 980 * 9 / 19) and r.q99 == pytest.approx(20 + 980 * 18 / 19)


def test_dotted_names_and_groups(spark, tmp_path):
    flat = spark.createDataFrame([(1, "T", "u", 2)], ["document_id", "document_metadata.document_title", "document_metadata.source_url", "a.b.c"])
    whole = nested.from_dotted(flat).first()
    assert whole.document_metadata.document_title == "T" and whole.a.b.c == 2 and whole.document_id == 1
    row = nested.document_rows(flat).first()
    assert (row.title, row.source_url, row.original_document_id, row.description, row.labels) == ("T", "u", 1, "", [])
    with pytest.raises(KeyError):
        nested.document_rows(flat.drop("document_metadata.source_url"))
    with pytest.raises(ValueError):
        nested.from_dotted(spark.createDataFrame([(1, 2)], ["a", "a.b"]))
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, (3, "c", "x")), (1, (1, "a", "y")), (1, (2, None, "z")), (2, None)], "id int, b struct<i: int, t: string, other: string>").write.parquet(path)
    rows = nested.members(spark.read.parquet(path), "b", ["i", "t"], ["id"], ["t"])
    assert "other" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, [(x.i, x.t) for x in r.rows]) for r in nested.ordered_groups(rows, "id", "i").collect()] == [(1, [(1, "a"), (3, "c")])]


def test_evaluation_sets(spark, tmp_path):
    line = {"input": {"document": {"original_document_id": "d1"}, "topic": {"id": "Q1"}, "mentions": {"total_passages": 9, "mentions": [{"passage_index": 3, "page_number": None}], "section_sizes": {"1": 4}}, "topic_corpus": None}, "score": 2}
    (tmp_path / "e.jsonl").write_text(json.dumps(line) + "\n\n")
    r = nested.examples(spark, str(tmp_path / "e.jsonl")).first()
    assert (r.document_id, r.topic, r.score, r.total_passages, r.section_sizes, r.n_documents) == ("d1", "Q1", 2, 9, {1: 4}, None) and r.mentions[0].passage_index == 3
    (tmp_path / "v.jsonl").write_text('{"content": "A HEADING", "label": 1, "min_page": null, "stratum": "s"}\n\n{"content": "Prose.", "label": 0}\n')
    rows = nested.validation(spark, str(tmp_path / "v.jsonl"))
    got = {r.slice: r for r in detectors.evaluated(rows, {"h": feeds.heading_by_content(F.col("content"))}).collect()}
    assert got["all rows"].n == 2 and got["all rows"].f1 == 1 and got["stratum s"].n == 1


def test_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None)], "id int, f string, g int")
    jsonl.write_both(jsonl.update_records(rows, F.col("id").cast("string"), ["f", "g"]), str(tmp_path / "a"), str(tmp_path / "b"))
    assert any(n.endswith(".json.gz") for n in os.listdir(tmp_path / "b")) and not any(n.endswith(".gz") for n in os.listdir(tmp_path / "a"))
    for p in "ab":
        r = jsonl.read_records(spark, str(tmp_path / p), "f string, g int, h int").first()
        assert (r.update, r.create, r.fields.f.assign, r.fields.g.assign, r.fields.h) == ("1", False, "a", None, None) and r.fields.g is not None
    listing = "Contents\n1. Introduction 3\n2. Background 5\n3. Methods 9\n4. Results 12\n5. Annex 30"
    records = spark.createDataFrame([("a", ((listing,), ([(2,)],))), ("b", ((listing,), ([(12,), (40,)],))), ("c", ((listing,), None)), ("d", (None, None)), ("e", (("LOUD TITLE",), ([],)))], "update string, fields struct<content: struct<assign: string>, pages: struct<assign: array<struct<number: int>>>>")
    got = {r.update: tuple(r.fields[f].assign for f in feeds.RECORD_FLAGS) for r in feeds.with_record_flags(records).collect()}
    assert got["a"][1] and not got["b"][1] and got["c"][1] and got["d"] == (False, False, False) and got["e"][0]
