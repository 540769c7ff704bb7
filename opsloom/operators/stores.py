"""A store of chunks as a table: adding with counters, deleting, looking up, ids, names, images.

A chunk is a row with an id, the document it belongs to and a content. Null ids match nothing. Ties and repeats of one id
in an input count as the first by content.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.changes import first_of


def routed(items: DataFrame, kind: str = "chunk_type") -> tuple[DataFrame, DataFrame]:
    """The items for the store of parents, and those for the store of children: all that aren't parents."""
    parent = F.coalesce(F.col(kind) == "parent", F.lit(False))
    return items.filter(parent), items.filter(~parent)


def write_routed(items: DataFrame, path: str, kind: str = "chunk_type") -> None:
    """Both stores as one table of files, partitioned by the kind of chunk."""
    routes = F.when(F.coalesce(F.col(kind) == "parent", F.lit(False)), "parent").otherwise("child")
    items.withColumn(kind, routes).write.mode("append").partitionBy(kind).parquet(path)


def add_status(stored: DataFrame, new: DataFrame, key: str, content: str, vector: Column | None = None) -> DataFrame:
    """new with ``status``: added, updated where the id is stored with another content, skipped where with the same, and
    failed where its vector has no length."""
    one = first_of(new.filter(F.col(key).isNotNull()), [key], [F.col(content).asc_nulls_first()])
    old = first_of(stored.filter(F.col(key).isNotNull()), [key], [F.col(content).asc_nulls_first()]).select(F.col(key), F.col(content).alias("__old"), F.lit(1).alias("__in"))
    same = F.col("__old").eqNullSafe(F.col(content))
    failed = F.coalesce(vector, F.lit(False)) if vector is not None else F.lit(False)
    status = F.when(F.col("__in") == 1, F.when(same, "skipped").when(failed, "failed").otherwise("updated")).when(failed, "failed").otherwise("added")
    return one.join(old, key, "left").withColumn("status", status).drop("__old", "__in")


def with_added(stored: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """The store after an addition: updated rows replaced, added rows put in."""
    fresh = judged.filter("status IN ('added', 'updated')").select(stored.columns)
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def without(stored: DataFrame, gone: DataFrame | None = None, key: str | None = None, rule: Column | None = None) -> DataFrame:
    """The store without the ids of ``gone``, or without the rows that a filter admits."""
    out = stored if gone is None else stored.join(gone.select(key).distinct(), key, "left_anti")
    return out if rule is None else out.filter(~F.coalesce(rule, F.lit(False)))


def looked_up(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The stored rows of a list of ids (pos, key), once for each place in the list, with ``pos``; others are left out."""
    return ids.join(stored, key)


def point_id(value: Column) -> Column:
    """The version 5 UUID of an id in the namespace of host names; Spark has no built-in for it."""

    @F.pandas_udf("string")
    def make(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, v)))

    return make(value.cast("string"))


def repaired(name: Column) -> Column:
    """A name whose UTF-8 bytes were read as Latin-1, put right; others stay as they are."""

    @F.pandas_udf("string")
    def repair(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            if v is None or v.isascii():
                return v
            try:
                raw = v.encode("latin-1")
            except UnicodeEncodeError:
                return v
            for encoding in ("utf-8", "gbk"):
                try:
                    return raw.decode(encoding)
                except UnicodeDecodeError:
                    continue
            return v

        return values.map(one)

    return repair(name)


def captions(images: DataFrame, content: str, describe: Column) -> DataFrame:
    """images with ``caption``: each different content is described once, and its copies share the words."""
    digest = images.withColumn("__hash", F.sha2(content, 256))
    once = digest.filter(F.col("__hash").isNotNull()).groupBy("__hash").agg(F.min(content).alias(content)).withColumn("caption", describe)
    return digest.join(once.select("__hash", "caption"), "__hash", "left").drop("__hash")


def stats(chunks: DataFrame, document: str, kind: str, content: str) -> DataFrame:
    """(document, parents, children, chars) of each document."""
    parent = F.coalesce(F.col(kind) == "parent", F.lit(False))
    return chunks.groupBy(document).agg(F.count_if(parent).alias("parents"), F.count_if(~parent).alias("children"), F.sum(F.length(content)).alias("chars"))
