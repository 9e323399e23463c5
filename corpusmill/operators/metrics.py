"""Online metrics over an event log: each is a DataFrame of one row (metric, value)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import timeline


def on_search():
    """Whether an event is on a search page."""
    return F.col("url").like("/search%")



def _one(df: DataFrame, name: str, part, whole) -> DataFrame:
    return df.agg(part.alias("_p"), whole.alias("_w")).select(F.lit(name).alias("metric"), F.round(100 * F.try_divide(F.col("_p").cast("double"), F.col("_w").cast("double")), 6).alias("value"))


def users_who_search(events: DataFrame) -> DataFrame:
    views = events.where((F.col("event") == "$pageview") & F.col("consent").isNotNull())
    return _one(views, "users_who_search", F.count_distinct(F.when(on_search(), F.col("distinct_id"))), F.count_distinct("distinct_id"))


def users_who_download(events: DataFrame, event: str = "purchase") -> DataFrame:
    """Of the users that ever consented, those with a download."""
    consenting = events.where("consent").select("distinct_id").distinct()
    return _one(events.join(consenting, "distinct_id", "left_semi"), "users_who_download", F.count_distinct(F.when(F.col("event") == event, F.col("distinct_id"))), F.count_distinct("distinct_id"))


def users_without_results(events: DataFrame) -> DataFrame:
    """Of the users that search, those that met a search without hits."""
    return _one(events.where((F.col("event") == "$pageview") & on_search()), "users_without_results", F.count_distinct(F.when(F.col("hits") == 0, F.col("distinct_id"))), F.count_distinct("distinct_id"))


def _on(events: DataFrame, day: date | None) -> DataFrame:
    """The events of a day, or of the log's first one."""
    if day is not None:
        start = F.lit(day).cast("timestamp_ntz")
        return events.where((F.col("ts") >= start) & (F.col("ts") < start + F.expr("interval 1 day")))
    first = events.agg(F.to_date(F.min("ts")).alias("_day"))  # one row
    return events.join(F.broadcast(first)).where(F.to_date("ts") == F.col("_day"))


def retention(events: DataFrame, days: int, returning=None, day: date | None = None) -> DataFrame:
    """Searchers of a day (None: the log's first) that come back after that day and within ``days`` in another session."""
    searches = _on(events, day).where(on_search())
    first = searches.groupBy("distinct_id").agg(F.min("ts").alias("_first"), F.min_by("session_id", F.struct("ts", "event_id")).alias("_session"))
    later = events if returning is None else events.where(returning)
    back = first.join(later.select("distinct_id", "ts", "session_id"), "distinct_id", "left").withColumn("_back", (F.col("ts") > F.date_trunc("day", "_first") + F.expr("interval 1 day")) & (F.col("ts") < F.col("_first") + F.expr(f"interval {days} days")) & (F.col("session_id") != F.col("_session")))
    return _one(back, f"retention_{days}", F.count_distinct(F.when(F.col("_back"), F.col("distinct_id"))), F.count_distinct("distinct_id"))


def click_through(events: DataFrame, dwell: int | None = None) -> DataFrame:
    """Searching users whose search page is followed by a document page, directly or through a family page, on which
    they stay ``dwell`` seconds (None: any time and directly only). The last page has no dwell."""
    views = events.where((F.col("event") == "$pageview") & F.col("consent")).select("distinct_id", "ts", "event_id", "url")
    after = lambda i, c: F.get("next", i - 1)[c]
    steps = timeline.following(views, ["ts", "url"], 3 if dwell is not None else 1)
    steps = steps.withColumns({**{f"_u{i}": after(i, "url") for i in (1, 2)}, **{f"_t{i}": after(i, "ts") for i in (1, 2, 3)}})
    if dwell is None:
        hit = F.col("_u1").like("/document/%")
    else:
        stay = [F.unix_timestamp(f"_t{i + 1}") - F.unix_timestamp(f"_t{i}") >= dwell for i in (1, 2)]
        hit = F.col("_u1").like("/document/%") & stay[0] | F.col("_u1").like("/documents/%") & F.col("_u2").like("/document/%") & stay[1]
    return _one(steps.where(on_search()), "click_through" if dwell is None else f"click_through_dwell_{dwell}", F.count_distinct(F.when(hit, F.col("distinct_id"))), F.count_distinct("distinct_id"))


def non_searcher_retention(events: DataFrame, days: int = 29, day: date | None = None) -> DataFrame:
    """Users of a day (None: the log's first) without a search on it that come back after that day and within ``days`` in
    another session."""
    own = _on(events, day).groupBy("distinct_id")
    first = own.agg(F.min("ts").alias("_first"), F.min_by("session_id", F.struct("ts", "event_id")).alias("_session"), F.count_if(on_search()).alias("_searches")).where("_searches = 0")
    back = first.join(events.select("distinct_id", "ts", "session_id"), "distinct_id", "left").withColumn("_back", (F.col("ts") > F.date_trunc("day", "_first") + F.expr("interval 1 day")) & (F.col("ts") < F.col("_first") + F.expr(f"interval {days} days")) & (F.col("session_id") != F.col("_session")))
    return _one(back, f"non_searcher_retention_{days}", F.count_distinct(F.when(F.col("_back"), F.col("distinct_id"))), F.count_distinct("distinct_id"))


#: Purposes of buttons and texts of links that count as a click on a result whatever its place. Fixed values.
PURPOSES = ["search-result-family-passage"]
LINK_TEXTS = ["View full summary and timeline", "View overview", "View all matches highlighted in document"]
#: First day whose clicks carry their place. Fixed value.
CLICKS_SINCE = date(2026, 1, 29)


def result_click(most: int = 5) -> Column:
    """Whether an event (columns position, purpose, link_text) is a click on one of the first ``most`` results, on a passage
    of one or on one of the links beside it."""
    has = lambda c: F.coalesce(c, F.lit(False))
    place = F.col("position").between(1, most)
    return (F.col("event") == "$autocapture") & on_search() & (has(place) | has(F.col("purpose").isin(PURPOSES)) | has(F.col("link_text").isin(LINK_TEXTS)))


def since(first: date, least: date = CLICKS_SINCE) -> date:
    """``first``, refused where the log does not have what a figure needs yet."""
    if first < least:
        raise ValueError(f"{first} is before {least}")
    return first


def top_click_through(events: DataFrame, click=None, most: int = 5) -> DataFrame:
    """Of the searching users, those with a click on one of the first ``most`` results. ``click`` is the whole condition
    of such a click; by default any recorded one whose place is among them."""
    click = (F.col("event") == "$autocapture") & (F.col("position") <= most) if click is None else click
    return _one(events, f"top_{most}_click_through", F.count_distinct(F.when(click, F.col("distinct_id"))), F.count_distinct(F.when(on_search(), F.col("distinct_id"))))


def result_click_through(events: DataFrame, first: date, most: int = 5, least: date = CLICKS_SINCE) -> DataFrame:
    """Of the users with a view of a search page from ``first`` on, those with a click on a result; refused before ``least``."""
    own = events.where(F.col("ts") >= F.lit(since(first, least)).cast("timestamp_ntz"))
    search = (F.col("event") == "$pageview") & F.col("consent").isNotNull() & on_search()
    users = own.groupBy("distinct_id").agg(F.bool_or(search).alias("_search"), F.bool_or(result_click(most)).alias("_hit")).where("_search")
    return _one(users, f"top_{most}_result_click_through", F.count_if("_hit"), F.count("*"))


def latency_quantiles(buckets: DataFrame, shares: list[float]) -> DataFrame:
    """(window, q<share>) from cumulative counts (window, le, count): linear inside the bucket that the share falls in,
    from the bound below it; the last bound where it falls beyond."""
    own = W.partitionBy("window").orderBy("le")
    steps = buckets.withColumns({"_below": F.coalesce(F.lag("le").over(own), F.lit(0.0)), "_before": F.coalesce(F.lag("count").over(own), F.lit(0)), "_all": F.max("count").over(W.partitionBy("window"))})
    at = {f"q{round(100 * s)}": F.min(F.when((F.col("count") >= s * F.col("_all")) & (F.col("_before") < s * F.col("_all")), F.col("_below") + (F.col("le") - F.col("_below")) * F.try_divide(s * F.col("_all") - F.col("_before"), F.col("count") - F.col("_before")))) for s in shares}
    return steps.groupBy("window").agg(*(e.alias(k) for k, e in at.items()))


def top_click_through_dwell(events: DataFrame, now: Column, click=None, dwell: int = 30, most: int = 5) -> DataFrame:
    """Of the users with a search page, those whose click on one of the first ``most`` results leads to a document page on
    which, or on whose family page right after it, they stay ``dwell`` seconds; the last page lasts until ``now``.

    Pages look ahead, and each click finds the next document page by an as-of join; a user of any number of events is
    split for both."""
    click = (F.col("event") == "$autocapture") & on_search() if click is None else click
    views = events.where((F.col("event") == "$pageview") & F.col("consent").isNotNull()).select("distinct_id", "ts", "event_id", "url")
    lasts = lambda start, end: F.unix_timestamp(F.coalesce(end, now)) - F.unix_timestamp(start) >= dwell
    one, two = F.get("next", 0), F.get("next", 1)
    stays = lasts(F.col("ts"), one["ts"]) | F.coalesce(one["url"].like("/documents/%"), F.lit(False)) & lasts(one["ts"], two["ts"])
    pages = timeline.following(views, ["ts", "url"], 2).where(F.col("url").like("/document/%")).select("distinct_id", "ts", "event_id", stays.alias("stays"))
    clicks = events.where(click & (F.col("position") <= most)).select("distinct_id", "ts")
    led = timeline.as_of(clicks, pages, "distinct_id", forward=True, strict=True, ties=["event_id"], name="page").select("distinct_id", F.lit(False).alias("_search"), F.coalesce("page.stays", F.lit(False)).alias("_hit"))
    both = views.select("distinct_id", on_search().alias("_search"), F.lit(False).alias("_hit")).unionByName(led)
    users = both.groupBy("distinct_id").agg(F.bool_or("_search").alias("_search"), F.bool_or("_hit").alias("_hit")).where("_search")
    return _one(users, f"top_{most}_click_through_dwell_{dwell}", F.count_if("_hit"), F.count("*"))


def periods(today: Column) -> dict[str, Column]:
    """The days that figures default to: the previous month, and for retention its first day or the Friday before where
    that is a weekend."""
    first = F.trunc(F.add_months(today, -1), "month")
    weekend = F.when(F.weekday(first) == 5, 1).when(F.weekday(first) == 6, 2).otherwise(0)
    return {"date_from": first, "date_to": F.last_day(first), "retention_date": F.date_sub(first, weekend)}


def old_enough(first: date, days: int, today: date) -> date:
    """``first``, refused unless the users had ``days`` to come back until ``today``."""
    if first > today - timedelta(days=days):
        raise ValueError(f"{first} is not {days} days before {today}")
    return first
