"""Quality rules with thresholds that adapt to language and source.

Each document's features are computed inside its row. Their distributions are kept as mergeable quantile sketches:
counts of logarithmic buckets of one percent relative error for each language, source and feature, which add up
to the sketches of a language and of the whole corpus. A group's thresholds come from its own quantiles, or from
the language's if it has too few documents, and may be stricter or looser than any constant: the median and a multiple
of the distance between the quartiles, at least of what one event makes in a document of the group's median size or the sketch's error. Only where the language
has too few documents as well do the constants of FALLBACK hold, loosened by the corpus' quantiles. The features are
then joined with the thresholds and filtered.

Null texts have no words and fail the base rules. Null languages and sources are groups of their own. A document
at a threshold is kept. An empty table gives no rows; repeated rows are judged alike, each of them counted. Further
columns are kept, but for those that the result adds. A very long text is worked out as one array of words in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, tidy, written

SPACES = "[ \\t-\\r]+"
WINDOW = 8
#: Relative error of the sketches' quantiles.
ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
#: Documents that a group needs for thresholds of its own.
LEAST_DOCS = 100
#: Multiples of the distance between the quartiles that are admitted beyond the median.
SPREAD = 5.0
#: feature: the size that it is a share of, and by how much the least event raises what is counted: a symbol, a line, two
#: windows of words, a letter. In a document of a group's median size that makes the least distance between the quartiles
#: that can be told from none, which is taken where most documents of a group are alike; nor can less than the sketches' own
#: error be told.
EVENTS = {"symbol_share": ("word_chars", 1), "dup_line_share": ("n_lines", 1), "repeat_share": ("n_words", 2 * WINDOW), "mean_word": ("n_words", 1)}
SIZES = sorted({size for size, _ in EVENTS.values()})
#: feature: (lower threshold or None, upper threshold) where group and language have too few documents; the corpus'
#: quantiles may loosen them.
FALLBACK = {"symbol_share": (None, 0.08), "dup_line_share": (None, 0.5), "repeat_share": (None, 0.3), "mean_word": (2.0, 20.0)}
ZERO = -1_000_000


def repeated_words(words: Column) -> Column:
    """Number of words inside windows of WINDOW words that occur twice or more."""

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, twice))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(windows, count))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words; drops the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACES), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rest = [c for c in docs.columns if c not in (text, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]
    return docs.select(*rest, of_words.alias("_w"), of_lines.alias("_l"), F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols")).select(*rest, "_w.*", "n_symbols", "_l.*")


def shares(df: DataFrame) -> DataFrame:
    """Adds the features that the thresholds hold for."""
    return df.withColumns(
        {
            "symbol_share": F.coalesce(F.try_divide("n_symbols", "word_chars"), F.lit(0.0)),
            "dup_line_share": F.coalesce(F.try_divide("n_dup_lines", "n_lines"), F.lit(0.0)),
            "repeat_share": F.coalesce(F.try_divide("n_repeat_words", "n_words"), F.lit(0.0)),
            "mean_word": F.coalesce(F.try_divide("word_chars", "n_words"), F.lit(0.0)),
        }
    )


def sketches(df: DataFrame) -> DataFrame:
    """Sketches (lang, source, feature, bucket, n); the counts of any groups add up to the sketch of their union."""
    long = df.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in [*FALLBACK, *SIZES]))).alias("f")).select("lang", "source", "f.*")
    bucket = F.when(F.col("x") > 0, F.ceil(F.round(F.ln("x") / F.ln(F.lit(GAMMA)), 6))).otherwise(F.lit(ZERO)).cast("int")
    return long.groupBy("lang", "source", "feature", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """docs and the quartiles q1, q2, q3 of each group's features, beside the medians of its sizes."""
    merged = sketch.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))
    own = W.partitionBy(*by, "feature")
    ranked = merged.withColumn("upto", F.sum("n").over(own.orderBy("bucket"))).withColumn("docs", F.sum("n").over(own))
    value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    at = {f"q{k}": F.min(F.when(F.col("upto") > F.floor((F.col("docs") - 1) * k / 4), value)).alias(f"q{k}") for k in (1, 2, 3)}
    out = ranked.groupBy(*by, "feature").agg(F.first("docs").alias("docs"), *at.values())
    # a group has a row for each feature and size
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return out.withColumns({s: F.max(F.when(F.col("feature") == s, F.col("q2"))).over(group) for s in SIZES}).where(F.col("feature").isin(list(FALLBACK)))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, feature, low, high) of every group."""
    taken = ["q1", "q2", "q3", *SIZES]
    own = quantiles(sketch, ["lang", "source"])
    by_lang = quantiles(sketch, ["lang"]).select("lang", "feature", *(F.col(c).alias(f"l_{c}") for c in ("docs", *taken)))
    every = quantiles(sketch, []).select("feature", *(F.col(c).alias(f"e_{c}") for c in ("docs", *taken)))
    # the sketches of the corpus are one row for each feature
    both = own.join(by_lang, (own.lang.eqNullSafe(by_lang.lang)) & (own.feature == by_lang.feature), "left").drop(by_lang.lang).drop(by_lang.feature).join(F.broadcast(every), "feature", "left")
    enough = (F.col("docs") >= LEAST_DOCS) | F.coalesce(F.col("l_docs") >= LEAST_DOCS, F.lit(False))
    pick = {q: F.when(F.col("docs") >= LEAST_DOCS, F.col(q)).when(F.col("l_docs") >= LEAST_DOCS, F.col(f"l_{q}")).otherwise(F.col(f"e_{q}")) for q in taken}
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for f, (lo, hi) in FALLBACK.items():
        size, event = EVENTS[f]
        reach = SPREAD * F.greatest(pick["q3"] - pick["q1"], event / pick[size], 2 * ERROR * pick["q2"])
        below, above = F.round(pick["q2"] - reach, 9), F.round(pick["q2"] + reach, 9)
        if lo is not None:
            low = F.when(F.col("feature") == f, F.when(enough, below).otherwise(F.least(F.lit(lo), below))).otherwise(low)
        high = F.when(F.col("feature") == f, F.when(enough, above).otherwise(F.greatest(F.lit(hi), above))).otherwise(high)
    return both.select("lang", "source", "feature", low.alias("low"), high.alias("high"))


@tidy
def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the features, base_failed and kept to each document, without its text."""
    have = written(shares(features(docs, text)).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))
    sketch = written(sketches(have.where(~F.col("base_failed"))))
    limits = thresholds(sketch).groupBy("lang", "source").pivot("feature", list(FALLBACK)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    # one row of limits meets many documents of a hot source: a join that Spark can split
    both = have.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    good = ~F.col("base_failed")
    for f in FALLBACK:
        good = good & F.coalesce(F.col(f) <= F.col(f"{f}_high"), F.lit(True)) & F.coalesce(F.col(f) >= F.col(f"{f}_low"), F.lit(True))
    return both.withColumn("kept", good).drop(*(f"{f}_{x}" for f in FALLBACK for x in ("low", "high")))
