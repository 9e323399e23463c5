"""Along events: split keys give what a plain loop gives, whatever the parts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import timeline

START = datetime(2024, 1, 1)


def events(seed, n=400, users=(0, 0, 0, 1, 2, None)):
    r = random.Random(seed)
    return [(i, r.choice(users), START + timedelta(minutes=r.randrange(3000)) if r.random() < 0.97 else None, r.choice("abc")) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, u int, ts timestamp_ntz, kind string")


@pytest.mark.parametrize("most", [1, 7, 60, 10**6])
@pytest.mark.parametrize("forward, strict", [(False, False), (False, True), (True, False), (True, True)])
def test_as_of(spark, most, forward, strict):
    left, right = events(1), events(2, 150)
    got = {r.event_id: r.found and r.found.event_id for r in timeline.as_of(frame(spark, left), frame(spark, right), "u", forward=forward, strict=strict, ties=["event_id"], most=most).collect()}
    assert len(got) == len(left)
    for i, u, t, _ in left:
        fits = [(s, j) for j, v, s, _ in right if u is not None and t is not None and v == u and s is not None and ((s >= t if forward else s <= t) and not (strict and s == t))]
        assert got[i] == ((min(fits) if forward else max(fits))[1] if fits else None)


@pytest.mark.parametrize("most", [1, 7, 60, 10**6])
def test_following_and_numbers(spark, most):
    rows = [x for x in events(3) if x[1] is not None and x[2]]
    df = frame(spark, rows)
    after = {r.event_id: [x.event_id for x in r.next] for r in timeline.following(df, ["event_id"], 3, "u", most=most).collect()}
    number = {r.event_id: r.rn for r in timeline.numbered(df, "u", most=most).collect()}
    for u in (0, 1, 2):
        own = [i for i, _, _, _ in sorted((x for x in rows if x[1] == u), key=lambda x: (x[2], x[0]))]
        assert [after[i] for i in own] == [own[k + 1 : k + 4] for k in range(len(own))]
        assert [number[i] for i in own] == list(range(1, len(own) + 1))


def test_a_large_key_is_split(spark):
    df = spark.range(5000).select(F.col("id").alias("event_id"), F.lit(1).alias("u"), (F.col("id") * 60_000_000).alias("_t"))
    parted, several = timeline.cut(df, "u", "_t", most=500)
    sizes = [r.n for r in parted.groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert several and len(sizes) == 10 and max(sizes) <= 510


def test_no_events(spark):
    none = frame(spark, [])
    assert timeline.as_of(none, none, "u").count() == timeline.following(none, ["event_id"], 2, "u").count() == timeline.numbered(none, "u").count() == 0
