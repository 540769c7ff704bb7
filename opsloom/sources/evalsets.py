"""Evaluation sets out of JSON: conversations flattened to questions with what was asked before.

A file holds a list of groups ``{group_id, domain, turns: [{query, expected_keywords}]}``. Groups without turns have no
questions; a question without text stays, with an empty history like the first of its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = "group_id string, domain string, turns array<struct<query:string,expected_keywords:array<string>>>"


def read(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return flattened(spark.read.schema(GROUP).option("multiLine", multi_line).json(path))


def flattened(groups: DataFrame, joiner: str = "；") -> DataFrame:
    """(group_id, domain, turn, query, expected_keywords, history, rewritten): a question behind those before it."""
    each = groups.select("group_id", "domain", "turns", F.posexplode("turns").alias("turn", "t"))
    before = F.transform(F.slice("turns", F.lit(1), F.col("turn")), lambda t: t["query"])
    history = F.array_join(before, joiner)
    rewritten = F.array_join(F.concat(before, F.array(F.col("t.query"))), joiner)
    return each.select("group_id", "domain", "turn", "t.query", "t.expected_keywords", history.alias("history"), rewritten.alias("rewritten"))
