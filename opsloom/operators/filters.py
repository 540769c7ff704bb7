"""A filter language of nested dicts, compiled to a column.

``{"a": 1, "b": "x"}`` asks for equality of all; ``$and`` and ``$or`` hold lists of filters; ``$or_empty``,
``$or_missing`` and ``$or_null`` hold ``{column: value}`` and also admit rows in which the column is null or empty. A
missing value equals nothing. An empty filter admits every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_OK = ("$or_empty", "$or_missing", "$or_null")


def compiled(rule: dict | None) -> Column:
    terms = []
    for key, value in (rule or {}).items():
        if key == "$and":
            terms += [compiled(r) for r in value]
        elif key == "$or":
            terms.append(reduce(lambda a, b: a | b, (compiled(r) for r in value), F.lit(False)))
        elif key in EMPTY_OK:
            terms += [F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", str(v)) for c, v in value.items()]
        else:
            terms.append(F.coalesce(F.col(key) == F.lit(value), F.lit(False)))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def merged(first: dict | None, second: dict | None) -> dict:
    """Both filters; lists of ``$and`` are joined rather than nested."""
    parts = []
    for rule in (first, second):
        if rule:
            parts += rule["$and"] if set(rule) == {"$and"} else [rule]
    return {"$and": parts} if len(parts) > 1 else (parts[0] if parts else {})


def visible(org: str | None = None, user: str | None = None, source: str | None = None, extra: dict | None = None) -> dict:
    """What a caller may see: rows shared with everyone, or of no or the caller's own organisation and user."""
    own = []
    if org is not None:
        own.append({"$or_empty": {"org_id": org}})
    if user is not None:
        own.append({"$or_empty": {"user_id": user}})
    rule: dict = {"source": source} if source else {}
    if own:
        rule = merged(rule, {"$or": [{"shared": "true"}, {"$and": own}]})
    return merged(rule, extra)


def child(org: str | None = None, user: str | None = None, source: str | None = None, extra: dict | None = None) -> dict:
    """What a caller may see of the children."""
    return merged({"chunk_type": "child"}, visible(org, user, source, extra))
