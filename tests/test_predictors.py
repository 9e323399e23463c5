"""Predictors on literal rows."""

import math

import pytest

from corpusmill.operators import predictors
from corpusmill.operators.predictors import Combined, Mentioned, Threshold

PLACES = "document_id int, topic string, idx int, page_number int, section_id int"


@pytest.fixture(scope="module")
def found(spark):
    passages = spark.createDataFrame([(1, i, i // 2, i // 3) for i in range(8)] + [(2, i, None, None) for i in range(4)], "document_id int, idx int, page_number int, section_id int")
    topics = spark.createDataFrame([(1, "a", 0, 0, 0), (1, "a", 0, 0, 0), (1, "a", 4, 2, 1), (1, "a", 5, 2, 1), (2, "a", 3, None, None), (2, "b", 0, None, None)], PLACES)
    stats = spark.createDataFrame([("a", 5, 2, 100, 1000)], "topic string, collection_frequency long, document_frequency long, n_documents long, n_passages long")
    return {(r.document_id, r.topic): r for r in predictors.features(topics, passages, stats).collect()}


def test_features(found):
    r = found[1, "a"]
    assert (r.mentions, r.max_per_page, r.first_page, r.first_3_pages, r.first_fraction) == (4, 2, 0, 4, 2)
    assert r.max_section_density == pytest.approx(2 / 3) and r.first_3_pages_density == pytest.approx(3 / 6) and r.earliness == 1
    assert r.decayed == pytest.approx(2 + math.exp(-3 * 4 / 8) + math.exp(-3 * 5 / 8))
    assert r.density_df == pytest.approx(0.5 * math.log(100 / 3)) and r.lognorm_cf == pytest.approx((1 + math.log(4)) * math.log(1000 / 6))


def test_without_pages_sections_or_stats(found):
    r = found[2, "b"]
    assert (r.first_page, r.max_per_page, r.first_3_pages, r.first_3_pages_density, r.max_section_density) == (predictors.NO_PAGE, 0, 0, 0, 0)
    assert r.count_df == r.count_cf == 1 and r.density_cf == 0.25


def test_trees_rank_and_report(spark):
    rows = spark.createDataFrame([(1, "a", 2), (2, "a", 0), (3, "a", 1), (4, "a", 0)], "document_id int, topic string, score int")
    have = spark.createDataFrame([(1, "a", 9, 0.5), (2, "a", 1, 0.9), (3, "a", 3, 0.1)], "document_id int, topic string, mentions long, x double")
    count, x = Threshold("mentions", 2, 5), Threshold("x", 0.2, 0.6, False)
    registry = {"any": Mentioned(), "count": count, "x": x, "both": Combined("and", (count, Combined("or", (x, Mentioned()))))}
    got = predictors.stacked(rows, have, registry)
    by = {(r.predictor, r.document_id): (r.predicted, r.value) for r in got.collect()}
    assert by["count", 1] == (2, 9.0) and by["count", 4] == (0, 0.0) and by["x", 2] == (0, -0.9) and by["x", 3] == (2, -0.1) and by["x", 4] == (0, -1.9)
    assert [by["both", i][0] for i in (1, 2, 3, 4)] == [2, 0, 1, 0] and by["any", 4] == (0, 0.0)
    board = {r.predictor: r for r in predictors.leaderboard(got, registry).collect()}
    assert board["count"].f1_relevant == 1 and board["count"].place_f1 == 1 and board["both"].place_f1 == 2 and board["count"].ndcg_pooled == 1
    assert board["any"].recall_binary == 1 and board["any"].precision_binary == pytest.approx(2 / 3) and board["any"].n_documents == 0


def test_registry_and_sweeps():
    assert len(predictors.REGISTRY) == 21
    assert list(predictors.sweep("p", Threshold, feature=["x"], low=[1], high=[2, 3])) == ["p[high=2]", "p[high=3]"]
    assert list(predictors.sweep("p", Threshold, feature=["x"], low=[1], high=[2])) == ["p"]
    with pytest.raises(ValueError):
        Threshold("x", 2, 1)
    with pytest.raises(ValueError):
        Combined("and", ())
