"""Registered queries along users' events where one user has half of all events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from corpusmill.operators import metrics, timeline

from . import fixtures as fx
from .registry import query

#: Rows of a user in one part, so that the large user is split on any of the tables.
PART = 2_000

_HOT = fx.with_sql("web_events") + ", hot AS (SELECT * REPLACE (CASE WHEN distinct_id % 2 = 0 THEN 0 ELSE distinct_id END AS distinct_id) FROM web_events), "


def _hot(spark, d):
    """The events, with every second user taken as one."""
    return fx.web_events(spark, d).withColumn("distinct_id", F.when(F.col("distinct_id") % 2 == 0, F.lit(0)).otherwise(F.col("distinct_id")))


@query("j15_latest_revision", _HOT + "r AS (SELECT * FROM hot WHERE event = 'purchase') SELECT l.event_id, r.event_id AS revision_id, r.ts AS revision_ts, r.value AS revision_value FROM hot l LEFT JOIN r ON r.event_id = (SELECT max_by(q.event_id, (q.ts, q.event_id)) FROM r q WHERE q.distinct_id = l.distinct_id AND q.ts <= l.ts) WHERE l.event = '$pageview'".replace("max_by(q.event_id, (q.ts, q.event_id))", "arg_max(q.event_id, (q.ts, q.event_id))"))
def j15_revision(spark, d):
    """Each page view with the row of the user's latest purchase up to it."""
    events = _hot(spark, d)
    revisions = events.where("event = 'purchase'").select("distinct_id", "ts", "event_id", "value")
    views = events.where("event = '$pageview'").select("distinct_id", "ts", "event_id")
    out = timeline.as_of(views, revisions, "distinct_id", ties=["event_id"], name="revision", most=PART)
    return out.select("event_id", F.col("revision.event_id").alias("revision_id"), F.col("revision.ts").alias("revision_ts"), F.col("revision.value").alias("revision_value"))


@query("j14_next_page_of_large_user", _HOT + "p AS (SELECT * FROM hot WHERE url LIKE '/document/%' AND event = '$pageview'), s AS (SELECT c.event_id, min(p.ts) AS next_ts, arg_min(p.event_id, (p.ts, p.event_id)) AS next_id FROM (FROM hot WHERE event = '$autocapture') c LEFT JOIN p ON p.distinct_id = c.distinct_id AND p.ts > c.ts GROUP BY 1) SELECT * FROM s")
def j14_large(spark, d):
    events = _hot(spark, d).select("distinct_id", "ts", "event_id", "event", "url")
    pages = events.where(F.col("url").like("/document/%") & (F.col("event") == "$pageview")).select("distinct_id", "ts", "event_id")
    out = timeline.as_of(events.where("event = '$autocapture'"), pages, "distinct_id", forward=True, strict=True, ties=["event_id"], name="page", most=PART)
    return out.select("event_id", F.col("page.ts").alias("next_ts"), F.col("page.event_id").alias("next_id"))


@query("n02_following_of_large_user", _HOT + "w AS (SELECT event_id, row_number() OVER o AS rn, lead(event_id, 1) OVER o AS n1, lead(event_id, 2) OVER o AS n2, lead(event_id, 3) OVER o AS n3 FROM hot WINDOW o AS (PARTITION BY distinct_id ORDER BY ts, event_id)) SELECT * FROM w")
def n02_large(spark, d):
    events = _hot(spark, d).select("distinct_id", "ts", "event_id")
    rows = timeline.following(timeline.numbered(events, most=PART), ["event_id"], 3, most=PART)
    return rows.select("event_id", "rn", *(F.get("next", i)["event_id"].alias(f"n{i + 1}") for i in range(3)))


_ANCHOR = """, x AS (SELECT distinct_id, min(ts) AS first_ts, arg_min(session_id, (ts, event_id)) AS s, count(*) FILTER (WHERE url LIKE '/search%') AS n FROM web_events WHERE {first} CAST(ts AS DATE) = DATE '2024-01-05' GROUP BY 1),
    y AS (SELECT x.distinct_id, e.ts > date_trunc('day', first_ts) + INTERVAL 1 DAY AND e.ts < first_ts + INTERVAL {days} DAY AND e.session_id <> x.s AS back FROM x LEFT JOIN web_events e USING (distinct_id) WHERE {kept})
    SELECT '{name}' AS metric, round(100.0 * CAST(count(DISTINCT CASE WHEN back THEN distinct_id END) AS DOUBLE) / nullif(count(DISTINCT distinct_id), 0), 6) AS value FROM y"""


@query("m04_retention_of_a_day", fx.with_sql("web_events") + _ANCHOR.format(first="url LIKE '/search%' AND", days=7, kept="true", name="retention_7"))
def m04_day(spark, d):
    return metrics.retention(fx.web_events(spark, d), 7, day=date(2024, 1, 5))


@query("m05_non_searchers_of_a_day", fx.with_sql("web_events") + _ANCHOR.format(first="", days=29, kept="n = 0", name="non_searcher_retention_29"))
def m05_day(spark, d):
    return metrics.non_searcher_retention(fx.web_events(spark, d), day=date(2024, 1, 5))


@query("m09_result_clicks", fx.with_sql("web_events") + ", u AS (SELECT DISTINCT distinct_id FROM web_events WHERE event = '$pageview' AND consent IS NOT NULL AND url LIKE '/search%' AND ts >= DATE '2024-01-03'), c AS (SELECT DISTINCT distinct_id FROM web_events WHERE event = '$autocapture' AND url LIKE '/search%' AND ts >= DATE '2024-01-03' AND (k % 10 BETWEEN 1 AND 5 OR k % 13 = 0 OR k % 17 = 0)) SELECT 'top_5_result_click_through' AS metric, round(100.0 * CAST(count(c.distinct_id) AS DOUBLE) / nullif(count(*), 0), 6) AS value FROM u LEFT JOIN c USING (distinct_id)")
def m09_clicks(spark, d):
    """Clicks by place, by the purpose of a button and by the text of a link, from the first day on that has them."""
    purpose, text = F.when(F.col("k") % 13 == 0, "search-result-family-passage"), F.when(F.col("k") % 17 == 0, "View overview")
    events = fx.web_events(spark, d).withColumns({"position": F.col("k") % 10, "purpose": purpose, "link_text": text})
    return metrics.result_click_through(events, date(2024, 1, 3), least=date(2024, 1, 2))
