"""Query rewriting by rulebases: longest match at each word, all rewrites of a query combined.

A rulebase maps words to what may stand in their place. In an alternative, quotes mark a phrase whose words must stand
next to each other; without them each word counts alone. The words that rules begin with are compiled into one
expression with the longest first, which reads a query from left to right; it works on columns of any size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import analysis

#: (rulebase, words, whether they stay themselves as well, alternatives). Fixed values.
RULES = [
    ("documents", "tcfd", False, ["task force on climate related financial disclosures"]),
    ("documents", "fca", False, ["financial conduct authority"]),
    ("documents", "ira", False, ["inflation reduction act"]),
    ("documents", "sfdr", False, ["sustainable finance disclosure regulation"]),
    ("documents", "erp", False, ["emissions reduction plan"]),
    ("documents", "necp", False, ["national energy and climate plan"]),
    ("documents", "phaseout", False, ["phase out"]),
    ("documents", "law", True, ["act"]),
    ("documents", "nz", True, ['"net zero"']),
    ("labels", "nz", False, ["net zero"]),
    ("passages", "ndc", True, ['"nationally determined contribution"']),
    ("passages", "nature based solution", False, ['"nature based solution"', '"nbs"']),
    ("passages", "gga", True, ['"global goal adaptation"']),
    ("passages", "evs", True, ['"electric car"', '"electric vehicle"']),
]
#: Rulebases that take in another one's rules; their own come first where both have the same words. Fixed values.
INCLUDES = {"labels": "documents", "passages": "documents"}


def rulebase(name: str, rules: list = RULES, includes: dict[str, str] = INCLUDES) -> dict[str, list[str]]:
    """What may stand for which words, the words themselves among it if they stay."""
    out = rulebase(includes[name], rules, includes) if name in includes else {}
    return out | {left: ([left] if stays else []) + right for base, left, stays, right in rules if base == name}


def geographies(names: dict[str, str] = analysis.GEOGRAPHIES) -> dict[str, list[str]]:
    """The other names of geographies as a rulebase: a name stays, and the other one is a phrase."""
    return {a: [a, f'"{b}"'] for a, b in names.items()}


def alternatives(query: Column, base: dict[str, list[str]]) -> Column:
    """For each place of the query what may stand there (array of arrays); null for a null query."""
    text = F.concat(F.array_join(analysis.words(analysis.currency_words(query)), " "), F.lit(" "))
    if not base:
        return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.array(w))
    longest = sorted(base, key=lambda left: (-len(left.split()), left))
    parts = F.regexp_extract_all(text, F.lit(f"({'|'.join(map(re.escape, longest))}|[^ ]+) "), 1)
    known = F.create_map(*(x for left, right in base.items() for x in (F.lit(left), F.array(*map(F.lit, right)))))
    return F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), F.array(p)))


def variants(query: Column, base: dict[str, list[str]]) -> Column:
    """The query in all its wordings: every combination of the alternatives of its places, in order."""
    both = lambda done, more: F.flatten(F.transform(done, lambda a: F.transform(more, lambda b: F.ltrim(F.concat(a, F.lit(" "), F.replace(b, F.lit('"'), F.lit("")))))))
    return F.array_distinct(F.aggregate(alternatives(query, base), F.array(F.lit("")), both))


def items(query: Column, base: dict[str, list[str]]) -> Column:
    """What is looked for: each word by itself, each phrase as a whole, once each."""
    one = lambda a: F.when(a.startswith('"'), F.array(F.replace(a, F.lit('"'), F.lit("")))).otherwise(F.split(a, " "))
    return F.array_distinct(F.flatten(F.transform(F.flatten(alternatives(query, base)), one)))
