"""Combination of text, topic and penalty scores into relevance."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the junk flags of a passage, of a document's fields and of a label's. Fixed values.
PENALTIES = {"heading": 0.15, "contents": 0.35, "references": 0.5}
BOOST_LABEL = 0.2


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def penalty(flags: dict[str, Column], weights: dict[str, float] = PENALTIES) -> Column:
    """The sum of the weights of a passage's flags."""
    return reduce(add, (weights[k] * _flag(c) for k, c in flags.items()), F.lit(0.0))


def multiplicative(text: Column, topic: Column, flags: dict[str, Column], boost: Column | float = 1.0, weights: dict[str, float] = PENALTIES) -> Column:
    """(text * boost + topic) times what each flag leaves."""
    score = text * boost + topic
    for k, c in flags.items():
        score = score * (1 - weights[k] * _flag(c))
    return score


def additive(text: Column, topic: Column, flags: dict[str, Column]) -> Column:
    return text - penalty(flags) + topic


def proximity_boost(nearness: Column) -> Column:
    return 1 + 2 * nearness


def topic_ids(tree: dict | None) -> list[str]:
    """The concept ids of the positive conditions of a filter tree, in order, once each."""
    if not tree:
        return []
    if "filters" in tree:
        return list(dict.fromkeys(t for c in tree["filters"] for t in topic_ids(c)))
    return [tree["value"]] if tree.get("op") == "contains" and str(tree["value"]).startswith("concept::") else []


def document_topics(counts: Column, topics: list[str], weight: float = 1.0) -> Column:
    """weight * sum of log(1 + count) over the asked topics; ``counts`` is a map, missing topics count 0."""
    return weight * reduce(add, (F.log1p(F.coalesce(F.try_element_at(counts, F.lit(t)), F.lit(0)).cast("double")) for t in topics), F.lit(0.0))


def passage_topics(counts: Column, topics: list[str], weight: float = 1.0) -> Column:
    """weight * the number of asked topics that the passage carries."""
    return weight * reduce(add, (F.least(F.coalesce(F.try_element_at(counts, F.lit(t)), F.lit(0)), F.lit(1)).cast("double") for t in topics), F.lit(0.0))


def label_boost(labels: Column, query: Column) -> Column:
    """0.2 if a label's type::value is the query."""
    return BOOST_LABEL * F.exists(labels, lambda x: F.concat_ws("::", x["type"], x["value"]) == query).cast("double")


def blended(tfidf: Column, topics: Column, asked: dict[str, float], a: float, b: float) -> Column:
    """a * tfidf . asked + b * topics . asked over two sparse maps."""

    def dot(m: Column) -> Column:
        return reduce(add, (F.coalesce(F.try_element_at(m, F.lit(t)), F.lit(0.0)) * w for t, w in asked.items()), F.lit(0.0))

    return a * dot(tfidf) + b * dot(topics)


def label_score(value: Column, alternative: Column, sub: Column, proximity: Column, completeness: Column, query_completeness: Column) -> Column:
    """3 (value + proximity / 3 + completeness / 3) and the best alternative and subconcept, by the root of how much of
    the query they cover."""
    return 3 * (value + proximity / 3 + completeness / 3) + (1.5 * alternative + sub) * F.sqrt(query_completeness)


#: Weights of a document's fields. Fixed values.
FIELDS = {"title": 3.0, "description": 1.0, "passages": 1.0, "geographies": 1.0, "identifiers": 10000.0}


def document_score(ranks: dict[str, Column], proximity: Column, completeness: Column, topic: Column, weights: dict[str, float] = FIELDS) -> dict[str, Column]:
    """The components of a document's score and their sum, ``score``. ``ranks`` of the fields (title_synonyms among them, of
    weight 1) that the index has; the title also counts how near and how whole it is matched."""
    parts = {f"{k}_score": weights.get(k, 1.0) * c.cast("double") for k, c in ranks.items()}
    parts["title_score"] = parts.get("title_score", F.lit(0.0)) + proximity + completeness
    parts["topic_score"] = topic
    return parts | {"score": reduce(add, parts.values())}
