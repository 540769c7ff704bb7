"""Log lines by container and time: ranges, containers, line filters, JSON fields and formats.

Lines are rows (container, ns, line) with the time in nanoseconds since 1970. Null lines pass no filter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.sources.documents import log_filter

#: Containers of the log system itself, which searches without a container leave out.
OWN = "loki|promtail"


def ranged(lines: DataFrame, end_s: int, minutes: int) -> DataFrame:
    """Lines of the minutes before a moment."""
    return lines.filter((F.col("ns") <= end_s * 1_000_000_000) & (F.col("ns") > (end_s - minutes * 60) * 1_000_000_000))


def clock(ns: Column) -> Column:
    """The time of day of a moment in nanoseconds."""
    return F.date_format(F.timestamp_micros(F.floor(ns / 1000).cast("bigint")), "HH:mm:ss")


def containers(lines: DataFrame, end_s: int, minutes: int = 60) -> DataFrame:
    return ranged(lines, end_s, minutes).select("container").distinct()


def built(container: Column, line: Column, name: str | None = None, keyword: str | None = None) -> Column:
    """Lines of containers whose name has a pattern, or of all but the log system's own, that hold a word."""
    where = container.rlike(f"^(?:.*{name}.*)$") if name else ~container.rlike(OWN)
    return F.coalesce(where & (F.contains(line, F.lit(keyword)) if keyword else line.isNotNull()), F.lit(False))


def any_keyword(lines: DataFrame, words: list[str]) -> DataFrame:
    return lines.filter(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("line"), w)))


def piped(lines: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Lines through a query: line filters, ``| json`` with the named fields, ``| line_format "…{{.field}}…"``.

    Fields that a line's JSON lacks are empty; so are all where it has no JSON.
    """
    head = re.split(r"\|\s*(?:json|line_format)\b", query, maxsplit=1)[0]
    out = lines.filter(log_filter(F.col("line"), head))
    if re.search(r"\|\s*json\b", query):
        parsed = F.try_parse_json(F.nullif(F.regexp_extract("line", r"(\{[\s\S]*\})", 1), F.lit("")))
        out = out.withColumns({f: F.coalesce(F.try_variant_get(parsed, f"$.{f}", "string"), F.lit("")) for f in fields})
    form = re.search(r'\|\s*line_format\s*"((?:[^"\\]|\\.)*)"', query)
    if form:
        parts = re.split(r"\{\{\s*\.(\w+)\s*\}\}", form[1])
        shown = [F.lit(p) if n % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for n, p in enumerate(parts)]
        out = out.withColumn("line", F.concat(*shown))
    return out
