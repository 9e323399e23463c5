"""Predictors of how relevant a topic is to a document: features, a registry of rules, and their judgement in one pass.

A predictor is a small tree: a feature held against two thresholds, the mere presence of a mention, or other predictors
combined by AND (the least class) or OR (the largest). A registry is evaluated in one projection over the examples and
stacked to rows (predictor, predicted, score), from which all reports, rankings and leaderboards are grouped at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import evaluation
from .relevance import threshold_class

#: Features that take a parameter: opening pages, share of the text, rate of decay. Fixed values.
OPENINGS, FRACTION, DECAY = (3, 5, 10, 15), 0.15, 3.0
#: A page that is never early, for mentions without any page. Fixed value.
NO_PAGE = 1_000_000
CLASSES = (0, 1, 2)
BY = ["document_id", "topic"]


def features(topics: DataFrame, passages: DataFrame, stats: DataFrame | None = None, openings: Sequence[int] = OPENINGS, fraction: float = FRACTION, decay: float = DECAY) -> DataFrame:
    """All features of each (document_id, topic) with a mention.

    ``topics``: document_id, topic and the place of each mention (idx, page_number, section_id; the last two may be null).
    ``passages``: document_id, idx, page_number and section_id of all passages. ``stats``: topic, collection_frequency,
    document_frequency, n_documents and n_passages; a topic without them has an idf of 1.
    """
    early = {n: F.col("page_number") < n for n in openings}
    sizes = passages.groupBy("document_id").agg(F.count("*").alias("total"), F.max("page_number").alias("max_page"), *(F.count_if(c).alias(f"_size_{n}") for n, c in early.items()))
    sections = passages.where("section_id is not null").groupBy("document_id", "section_id").agg(F.count("*").alias("_size"))
    places = topics.groupBy(*BY, "idx", "page_number", "section_id").agg(F.count("*").alias("n")).join(sizes, "document_id")
    at = F.col("idx") / F.col("total")
    pages = places.groupBy(*BY, "page_number").agg(
        F.sum("n").alias("n"), F.min("idx").alias("first_idx"), F.first("total").alias("total"), F.first("max_page").alias("max_page"), F.sum(F.when(F.col("idx") < fraction * F.col("total"), F.col("n")).otherwise(0)).alias("first_fraction"),
        F.sum(F.col("n") * F.exp(-decay * at)).alias("decayed"), F.count("*").alias("_places"), *(F.first(f"_size_{n}").alias(f"_size_{n}") for n in openings),
    )
    whole = pages.groupBy(*BY).agg(
        F.sum("n").alias("mentions"), F.coalesce(F.max(F.when(F.col("page_number").isNotNull(), F.col("n"))), F.lit(0)).alias("max_per_page"), F.min("first_idx").alias("first_idx"), F.first("total").alias("total"), F.sum("first_fraction").alias("first_fraction"),
        F.sum("decayed").alias("decayed"), F.coalesce(F.min("page_number"), F.first("max_page"), F.lit(NO_PAGE)).alias("first_page"),
        *(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(f"first_{n}_pages") for n, c in early.items()), *(F.coalesce(F.try_divide(F.sum(F.when(c, F.col("_places"))), F.first(f"_size_{n}")), F.lit(0.0)).alias(f"first_{n}_pages_density") for n, c in early.items()),
    )
    own = places.where("section_id is not null").groupBy(*BY, "section_id").agg(F.count("*").alias("_in")).join(sections, ["document_id", "section_id"])
    dense = own.groupBy(*BY).agg(F.max(F.col("_in") / F.col("_size")).alias("max_section_density"))
    out = whole.join(dense, BY, "left").withColumns({"max_section_density": F.coalesce("max_section_density", F.lit(0.0)), "density": F.col("mentions") / F.col("total"), "earliness": 1 - F.col("first_idx") / F.col("total"), "lognorm": 1 + F.ln("mentions")})
    out = out.join(stats, "topic", "left") if stats is not None else out.withColumns({c: F.lit(None).cast("long") for c in ("n_documents", "document_frequency", "n_passages", "collection_frequency")})
    idf = lambda n, f: F.when(F.col(n).isNull() | F.col(f).isNull(), 1.0).otherwise(F.greatest(F.ln(F.col(n) / (1 + F.col(f))), F.lit(0.0)))
    weights = {"df": idf("n_documents", "document_frequency"), "cf": idf("n_passages", "collection_frequency")}
    tf_idf = {f"{tf}_{k}": F.col(c) * w for tf, c in (("count", "mentions"), ("density", "density"), ("lognorm", "lognorm")) for k, w in weights.items()}
    return out.select(*BY, "mentions", "density", "max_per_page", "max_section_density", "earliness", "first_page", "first_fraction", "decayed", *(f"first_{n}_pages" for n in openings), *(f"first_{n}_pages_density" for n in openings), *(c.alias(k) for k, c in tf_idf.items()))


def corpus_stats(topics: DataFrame, passages: DataFrame) -> DataFrame:
    """topic, collection_frequency, document_frequency, n_documents, n_passages."""
    found = topics.groupBy("topic", "document_id").agg(F.count("*").alias("n")).groupBy("topic").agg(F.sum("n").alias("collection_frequency"), F.count("*").alias("document_frequency"))
    sizes = passages.groupBy("document_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_passages"))  # one row
    return found.join(F.broadcast(sizes))


@dataclass(frozen=True)
class Threshold:
    """Class 2 from ``high`` and 1 from ``low`` on, or with smaller values better up to ``low`` and ``high``."""

    feature: str
    low: float
    high: float
    larger: bool = True

    def __post_init__(self) -> None:
        if self.low > self.high:
            raise ValueError(f"{self.low} is above {self.high}")

    def predicted(self) -> Column:
        return threshold_class(F.col(self.feature), self.low, self.high, self.larger)

    def score(self) -> Column:
        """What rows are ranked by; null without mentions."""
        value = F.col(self.feature).cast("double")
        return value if self.larger else -value


@dataclass(frozen=True)
class Mentioned:
    """Class 2 for any mention."""

    def predicted(self) -> Column:
        return F.when(F.col("mentions") > 0, 2).otherwise(0)

    def score(self) -> Column:
        return self.predicted().cast("double")


@dataclass(frozen=True)
class Combined:
    """AND takes the least class of the parts, OR the largest; parts may be combined themselves."""

    mode: str
    parts: tuple

    def __post_init__(self) -> None:
        if not self.parts or self.mode not in ("and", "or"):
            raise ValueError("parts and a mode of and / or are needed")

    def predicted(self) -> Column:
        classes = [p.predicted() for p in self.parts]
        return classes[0] if len(classes) == 1 else (F.least if self.mode == "and" else F.greatest)(*classes)

    def score(self) -> Column:
        return self.predicted().cast("double")


def sweep(prefix: str, make: Callable, **grid: Sequence) -> dict:
    """A predictor for each point of the grid; its name has the parameters that vary."""
    varying = [k for k, v in grid.items() if len(v) > 1]
    out = {}
    for point in itertools.product(*grid.values()):
        at = dict(zip(grid, point, strict=True))
        out[f"{prefix}[{','.join(f'{k}={at[k]}' for k in varying)}]" if varying else prefix] = make(**at)
    return out


_COUNT, _DENSITY = Threshold("mentions", 3.7, 308.6), Threshold("density", 0.0018735644118713008, 0.044774726260994414)
_EARLY = Threshold("first_page", 2, 43.2, False)
#: The tuned predictors. Names and thresholds are fixed values.
REGISTRY = {
    "any-mention-is-relevant": Mentioned(),
    "mention-count": _COUNT,
    "mention-density": _DENSITY,
    "max-mentions-per-page": Threshold("max_per_page", 2, 11.2),
    "max-section-density": Threshold("max_section_density", 0.09090909090909091, 1.0),
    "earliest-mention": Threshold("earliness", 0.38225324027916247, 0.9854126501582999),
    "earliest-mention-page": _EARLY,
    "first-fraction": Threshold("first_fraction", 1.5, 16),
    "decay-weighted": Threshold("decayed", 1.984270124628002, 97.3581273356797),
    "first-3-pages": Threshold("first_3_pages", 0, 1),
    "first-5-pages": Threshold("first_5_pages", 0, 3),
    "first-10-pages": Threshold("first_10_pages", 0, 7),
    "first-15-pages": Threshold("first_15_pages", 0, 11),
    "first-10-pages-density": Threshold("first_10_pages_density", 0, 0.01563994722084777),
    "(count or density) and early": Combined("and", (Combined("or", (_COUNT, _DENSITY)), _EARLY)),
    "density and early": Combined("and", (_DENSITY, _EARLY)),
    "tfidf-density-df": Threshold("density_df", 0.0017, 0.03091),
    "tfidf-density-cf": Threshold("density_cf", 0.00969, 0.09477),
    "tfidf-count-df": Threshold("count_df", 3.809, 73.6),
    "tfidf-count-cf": Threshold("count_cf", 20.73, 404.2),
    "tfidf-lognorm-df": Threshold("lognorm_df", 0.2851, 3.514),
}


def stacked(examples: DataFrame, found: DataFrame, registry: dict = REGISTRY) -> DataFrame:
    """(document_id, topic, score, predictor, predicted, value) of each example (document_id, topic, score) and predictor.

    ``value`` ranks the examples; those without mentions come one below a predictor's least value.
    """
    rows = examples.join(found, BY, "left")
    each = [F.struct(F.lit(name).alias("predictor"), p.predicted().alias("predicted"), p.score().alias("value")) for name, p in registry.items()]
    out = rows.select(*BY, "score", F.explode(F.array(*each)).alias("p")).select(*BY, "score", "p.*")
    floor = out.groupBy("predictor").agg((F.min("value") - 1).alias("_floor"))  # one row for each predictor
    return out.join(F.broadcast(floor), "predictor").withColumn("value", F.coalesce("value", "_floor", F.lit(0.0))).select(*BY, "score", "predictor", "predicted", "value")


def rankings(rows: DataFrame) -> DataFrame:
    """predictor, ndcg_by_document, ndcg_pooled, ndcg_by_topic, n_documents, n_topics; 0 where no group can be ranked."""
    zero = F.lit(0.0)
    pooled = evaluation.ndcg(rows, ["predictor"], "value", "score").select("predictor", F.col("ndcg").alias("ndcg_pooled"))
    by = lambda key, name, n: evaluation.ndcg(rows, ["predictor", key], "value", "score").groupBy("predictor").agg(F.avg("ndcg").alias(name), F.count("*").alias(n))
    names = rows.select("predictor").distinct()
    out = names.join(pooled, "predictor", "left").join(by("document_id", "ndcg_by_document", "n_documents"), "predictor", "left").join(by("topic", "ndcg_by_topic", "n_topics"), "predictor", "left")
    return out.select("predictor", *(F.coalesce(c, zero).alias(c) for c in ("ndcg_by_document", "ndcg_pooled", "ndcg_by_topic")), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "n_topics")))


def reports(rows: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Precision, recall and F1 of each class, their means, the mean F1 of the classes above 0, and those of any relevance
    against none (binary), by predictor."""
    s, p = F.col("score"), F.col("predicted")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tests = {str(c): (s == c, p == c) for c in classes} | {"any": (s > 0, p > 0)}
    sums = rows.groupBy("predictor").agg(*(F.count_if(x).alias(f"_{n}_{k}") for k, (is_, said) in tests.items() for n, x in (("tp", is_ & said), ("p", said), ("s", is_))))
    parts = {f"{n}_{k}": ratio(F.col(f"_tp_{k}"), F.col(f"_{d}_{k}")) for k in tests for n, d in (("precision", "p"), ("recall", "s"))}
    parts |= {f"f1_{k}": ratio(2 * F.col(f"_tp_{k}"), F.col(f"_p_{k}") + F.col(f"_s_{k}")) for k in tests}
    wide = sums.withColumns(parts)
    mean = lambda n, of: sum((F.col(f"{n}_{c}") for c in of), F.lit(0.0)) / len(of)
    above = [c for c in classes if c > 0]
    means = [mean(n, classes).alias(n) for n in ("precision", "recall", "f1")]
    return wide.select("predictor", *means, mean("f1", above).alias("f1_relevant"), *(f"{n}_{c}" for c in above for n in ("precision", "recall")), *(F.col(f"{n}_any").alias(f"{n}_binary") for n in ("precision", "recall", "f1")), F.col("_s_any").alias("positives"), sum((F.col(f"_s_{c}") for c in classes), F.lit(0)).alias("support"))


def leaderboard(rows: DataFrame, registry: dict = REGISTRY) -> DataFrame:
    """A row for each predictor with its reports, rankings and places by F1 of the relevant classes, by binary F1 and by
    NDCG of documents. Equal predictors keep the registry's order, which is stated and small."""
    wide = reports(rows).join(rankings(rows), "predictor")
    number = F.create_map(*(F.lit(x) for i, name in enumerate(registry) for x in (name, i)))
    place = lambda c: F.row_number().over(W.orderBy(F.round(c, 9).desc(), number[F.col("predictor")]))
    return wide.withColumns({"place_f1": place("f1_relevant"), "place_binary": place("f1_binary"), "place_ndcg": place("ndcg_by_document")})
