"""The vector index against brute force."""

import numpy as np
import pytest

from corpusmill.operators import vectors


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    v = centres[r.integers(0, 12, 600)] + 0.5 * r.normal(size=(600, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600, [0.0] * 16), (601, None), (602, v[3].tolist()), (603, v[3].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 600, 20)] + [(900, [0.0] * 16), (901, None)], "query_id long, query_vector array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    every = np.vstack([unit, unit[3], unit[3]])
    names = np.array([*range(600), 602, 603])
    return df, q, unit, every, names


def brute(made, most, farthest):
    _, _, unit, every, names = made
    out = {}
    for q in range(0, 600, 20):
        a = np.arccos(np.clip(every @ unit[q], -1, 1))
        order = sorted(range(len(names)), key=lambda i: (round(a[i], 9), names[i]))
        out[q] = [int(names[i]) for i in order if a[i] <= farthest][:most]
    return out


@pytest.mark.parametrize("most, farthest", [(10, 0.6), (5, 3.2), (1000, 0.4)])
def test_exact(made, monkeypatch, most, farthest):
    df, q, *_ = made
    monkeypatch.setattr(vectors, "LIST_ROWS", 40)  # lists are shared out
    got = {}
    for r in vectors.nearest(vectors.build(df, "id", "v", 10), q, most, farthest).orderBy("query_id", "distance", "id").collect():
        got.setdefault(r.query_id, []).append(r.id)
    want = brute(made, most, farthest)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_probes_find_most(made):
    df, q, *_ = made
    index = vectors.build(df, "id", "v", 40)
    exact = vectors.nearest(index, q, 10, 3.2)
    assert vectors.recall(vectors.nearest(index, q, 10, 3.2, probes=12), exact, "id") >= 0.9
    assert vectors.recall(vectors.nearest(index, q, 10, 3.2, probes=1), exact, "id") < 1


def test_hybrid_and_empty(spark, made):
    df, q, *_ = made
    matched = spark.createDataFrame([(0, 0), (0, 5), (0, 5), (900, 7)], "query_id long, id long")
    rows = {(r.query_id, r.id): (r.near, r.matched) for r in vectors.hybrid(vectors.build(df, "id", "v"), q, matched, 1, 0.1).collect()}
    assert rows[0, 0] == (True, True) and rows[0, 5] == (False, True) and rows[900, 7] == (False, True) and rows[20, 20] == (True, False)
    assert vectors.nearest(vectors.build(df.limit(0), "id", "v"), q).count() == 0
