"""Comparing a stored set of rows with a new one: what was added, changed, left alone or removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(*keys, status) with status added, updated, unchanged or deleted, by the content's MD5, in one full outer join.

    Keys are compared so that null equals null; null content equals null content.
    """
    digest = lambda df, name: df.select(*keys, F.md5(F.coalesce(F.col(content), F.lit(""))).alias(name), F.lit(1).alias(f"in_{name}"))
    a, b = digest(old, "old").alias("a"), digest(new, "new").alias("b")
    on = None
    for k in keys:
        one = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = one if on is None else on & one
    joined = a.join(b, on, "full")
    status = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "deleted")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("updated")
    )
    have = F.col("in_new").isNotNull()
    return joined.select(*(F.when(have, F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys), status.alias("status"))


def replaced(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with all rows of the keys that occur in ``new`` replaced by those of ``new``."""
    kept = stored.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new)


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row of each key: the first in the given order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
