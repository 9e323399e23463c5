"""Nested boolean filters as Column expressions.

A tree is {"op": "and" | "or", "filters": [condition or tree, ...]}; a condition {"field", "op", "value"} and, for
attributes, "key". Negation is two-valued: rows without a value pass. An empty group is no constraint.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Logical fields of the labels array: the member of its elements.
LABEL_FIELDS = {"labels.value.id": "id", "labels.value.type": "type", "labels.value.value": "value", "labels.type": "relationship"}
MAP_OPS = {"attributes_string": {"eq", "not_eq"}, "attributes_double": {"eq", "not_eq", "gt", "gte", "lt", "lte"}, "attributes_boolean": {"eq", "not_eq"}}
COMPARE = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def epoch(value) -> int:
    """Epoch seconds of a number or an ISO date."""
    if isinstance(value, (int, float)):
        return int(value)
    t = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp())


def condition(c: dict, arrays: tuple[str, ...] = ("labels",)) -> Column:
    """One condition; a label field means any of the ``arrays``, and its negation none of them."""
    field, op, value = c["field"], c["op"], c["value"]
    if field in LABEL_FIELDS:
        if op not in ("contains", "not_contains"):
            raise ValueError(f"{op} is no operation of {field}")
        hit = reduce(or_, (_true(F.exists(a, lambda x: x[LABEL_FIELDS[field]] == value)) for a in arrays))
        return hit if op == "contains" else ~hit
    if field.startswith("attributes."):  # the map follows the type of the value
        kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"
        return condition({"field": f"attributes_{kind}", "key": field.split(".", 1)[1], "op": op, "value": value})
    if field in MAP_OPS:
        if op not in MAP_OPS[field]:
            raise ValueError(f"{op} is no operation of {field}")
        have = F.try_element_at(F.col(field), F.lit(c["key"]))
        value = int(value) if isinstance(value, bool) else value
        return ~_true(have == value) if op == "not_eq" else _true(COMPARE[op](have, value))
    if field == "published":
        if op == "not_eq":
            return ~F.col("published").eqNullSafe(F.lit(epoch(value)))
        return _true(COMPARE[op](F.col("published"), epoch(value)))
    raise ValueError(f"unknown field {field}")


def build(tree: dict | None, same_element: bool = True, arrays: tuple[str, ...] = ("labels",)) -> Column:
    """The predicate of a tree. With ``same_element`` (passages and labels) the positive label conditions of an AND group
    must hold in one element of an array; without (documents) each may hold in another."""
    if not tree:
        return F.lit(True)
    if "filters" not in tree:
        return condition(tree, arrays)
    same = [c for c in tree["filters"] if same_element and tree["op"] == "and" and c.get("field") in LABEL_FIELDS and c["op"] == "contains"]
    parts = [build(c, same_element, arrays) for c in tree["filters"] if c not in same and (c.get("filters") or "field" in c)]
    if same:
        parts.append(reduce(or_, (_true(F.exists(a, lambda x: reduce(and_, (x[LABEL_FIELDS[c["field"]]] == c["value"] for c in same)))) for a in arrays)))
    return reduce(and_ if tree["op"] == "and" else or_, parts) if parts else F.lit(True)


def label_type(c: dict) -> str | None:
    """The facet group that a condition narrows."""
    if c.get("field") == "labels.value.id":
        return c["value"].split("::", 1)[0] if "::" in c["value"] else None
    return c["value"] if c.get("field") == "labels.value.type" else None


def prune(tree: dict | None, group: str) -> dict | None:
    """The tree without the conditions of one facet group; groups that become empty go."""
    if not tree:
        return None
    if "filters" not in tree:
        return None if label_type(tree) == group else tree
    left = [x for x in (prune(c, group) for c in tree["filters"]) if x]
    return {**tree, "filters": left} if left else None


def groups(tree: dict | None) -> list[str]:
    """The facet groups that a tree narrows."""
    if not tree:
        return []
    found = [g for c in tree["filters"] for g in groups(c)] if "filters" in tree else [label_type(tree)]
    return sorted({g for g in found if g})


def any_of(ids: list[str]) -> dict:
    """A tree that any label id fulfils, such as the providers of a corpus."""
    return {"op": "or", "filters": [{"field": "labels.value.id", "op": "contains", "value": i} for i in ids]}


def all_of(ids: list[str]) -> dict:
    """A tree that needs every id, each in an element of its own."""
    return {"op": "and", "filters": [{"op": "and", "filters": c["filters"]} for c in (any_of([i]) for i in ids)]}


def both(a: dict | None, b: dict | None) -> dict | None:
    return {"op": "and", "filters": [a, b]} if a and b else a or b


def named(value: Column, alternatives: Column, prefix: str) -> Column:
    """Whether a label's value or one of its other names begins with the prefix, whatever the case."""
    low = prefix.lower()
    return _true(F.lower(value).startswith(low)) | _true(F.exists(alternatives, lambda x: F.lower(x).startswith(low)))


def hash_sample(key: Column, percent: int) -> Column:
    """Keeps rows whose key's CRC-32 modulo 100 is below ``percent``, and rows without a key."""
    return key.isNull() | (F.crc32(key.cast("string").cast("binary")) % 100 < percent)
