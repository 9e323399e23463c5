"""Folders of many small files, of none and of bad ones."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import readers


def test_many_small_files_in_few_tasks(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"doc{i}_translated_en.json").write_text(json.dumps({"pdf_data": {"text_blocks": [{"id": "b", "idx": i, "text": "x" * 100}]}}))
    (tmp_path / "bad.json").write_text("{no json")
    (tmp_path / "none.json").write_text('{"pdf_data": null}')
    blocks = readers.text_blocks(spark, str(tmp_path))
    assert blocks.rdd.getNumPartitions() == 1
    rows = blocks.select("document_id", "idx").collect()
    assert len(rows) == 600 and {(r.document_id, r.idx) for r in rows} == {(f"doc{i}", i) for i in range(600)}
    # some kilobytes a task
    assert 5 <= readers.packed(spark.read.text(str(tmp_path), wholetext=True), str(tmp_path), 10_000).rdd.getNumPartitions() <= 12
    assert readers.packed(spark.read.text(str(tmp_path), wholetext=True), str(tmp_path), 10_000).count() == 602


def test_inferences_of_small_and_bad_files(spark, tmp_path):
    (tmp_path / "d1.json").write_text(json.dumps({"p1": [{"id": "Q1"}, {"id": "Q2"}], "p2": []}))
    (tmp_path / "d2.json").write_text("[")
    assert {(r.document_id, r.passage_id, r.concept.id) for r in readers.inferences(spark, str(tmp_path)).collect()} == {("d1", "p1", "Q1"), ("d1", "p1", "Q2")}


def test_parts_with_a_cap_and_derived_fields(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.parts(spark, str(tmp_path), "a int")
    for i in (3, 1, 2):
        (tmp_path / f"part-{i}.jsonl").write_text(json.dumps({"a": i}) + "\n\n")
    got = readers.parts(spark, str(tmp_path), "a int", 2, lambda rows: rows.withColumn("b", F.col("a") * 10))
    assert {(r.a, r.b) for r in got.collect()} == {(1, 10), (2, 20)}
    assert readers.parts(spark, str(tmp_path / "part-3.jsonl"), "a int").count() == 1


def test_an_empty_folder_has_no_blocks(spark, tmp_path):
    assert readers.text_blocks(spark, str(tmp_path)).count() == 0
