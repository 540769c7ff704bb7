"""Quality of rankings and answers. Hits carry rank from 0; queries without relevant documents score 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.session import cut


def ranking_quality(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, mrr, ndcg) from hits (query_id, doc_id, rank) and relevant (query_id, doc_id).

    recall and ndcg look at the first k, mrr at all hits. Relevance is yes or no; repeated pairs count once.
    """
    want = relevant.distinct()
    total = want.groupBy("query_id").agg(F.count("*").alias("total"))
    # Relevance and total are joined to the few hits; the relevant pairs of all queries are never sorted.
    good = hits.join(want, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") < k, 1).otherwise(0)).alias("found"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") < k, 1 / F.log2(F.col("rank") + 2)).otherwise(0.0)).alias("gain"),
    )
    every = hits.select("query_id").distinct().join(total, "query_id", "left").join(good, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        "query_id",
        zero(F.col("found") / F.col("total")).alias("recall"),
        zero(1.0 / (F.col("first") + 1)).alias("mrr"),
        zero(F.col("gain") / ideal).alias("ndcg"),
    )


def keyword_quality(words: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, mrr, ndcg) from words (query_id, keyword) and the first k hits (query_id, rank, text).

    A keyword counts at the first hit that holds it. The ideal has all of them at the first places, one at each.
    """
    found = words.join(hits.select("query_id", "text", "rank"), "query_id", "left")
    first = found.groupBy("query_id", "keyword").agg(F.min(F.when(F.contains("text", F.col("keyword")), F.col("rank"))).alias("rank"))
    g = first.groupBy("query_id").agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 2)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return g.select("query_id", zero(F.col("found") / F.col("n")).alias("recall"), zero(1.0 / (F.col("first") + 1)).alias("mrr"), zero(F.col("gain") / F.col("n") / ideal).alias("ndcg"))


def supported(claims: DataFrame, key: str, words: Column, held: Column, least: float) -> DataFrame:
    """(key, claims, faithfulness): the share of an answer's claims of whose words the context has enough; where no model
    judges."""
    own = F.array_distinct(words)
    share = F.size(F.array_intersect(own, held)) / F.size(own)
    g = claims.groupBy(key).agg(F.count("*").alias("claims"), F.count_if(share >= least).alias("n"))
    return g.select(key, "claims", F.round(F.col("n") / F.col("claims"), 6).alias("faithfulness"))


def context_precision(judged: DataFrame) -> DataFrame:
    """(query_id, context_precision): useful hits weighted by 1 / (rank + 1), as a share of all weights."""
    weight = 1.0 / (F.col("rank") + 1)
    share = F.sum(F.when(F.col("useful"), weight).otherwise(0.0)) / F.sum(weight)
    return judged.groupBy("query_id").agg(F.round(share, 6).alias("context_precision"))


def overlap(answer: Column, truth: Column) -> Column:
    """The share of the truth's distinct tokens that the answer has."""
    distinct = F.array_distinct(truth)
    return F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, answer)) / F.size(distinct)).otherwise(0.0)


def citations(text: Column) -> Column:
    """How often a text cites by number in brackets."""
    return F.regexp_count(text, F.lit(r"\[[0-9]+\]"))


def exact_quantiles(df: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, one column for each quantile) of the values of each group, linear between neighbours as in SQL.

    The rows are range-sorted by group and value, the rows of each group in each partition are counted, and what lies at
    the ranks asked for is then picked where it stands, so no group is gathered. Groups are as few as fit the driver;
    null values take no part.
    """
    rows = df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    placed = salted.repartitionByRange("g", "v", "salt").sortWithinPartitions("g", "v").select(F.spark_partition_id().alias("part"), "g", "v")
    kept = cut(placed)
    counts: dict = {}
    for r in sorted(kept.groupBy("part", "g").count().collect(), key=lambda r: r["part"]):
        counts.setdefault(r["g"], []).append((r["part"], r["count"]))
    asked: dict[int, list[tuple]] = {}
    share: dict[tuple, float] = {}
    for g, parts in counts.items():
        total = sum(n for _, n in parts)
        for name, q in quantiles.items():
            at = q * (total - 1)
            share[g, name] = at - int(at)
            for side, rank in enumerate((int(at), min(int(at) + 1, total - 1))):
                before = 0
                for part, n in parts:
                    if before <= rank < before + n:
                        asked.setdefault(part, []).append((g, rank - before, name, side))
                    before += n

    kind = dict(rows.dtypes)["g"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            groups, values = batch.column("g").to_pandas(), batch.column("v").to_numpy(zero_copy_only=False)
            part = batch.column("part")[0].as_py() if batch.num_rows else None
            found = []
            for g in dict.fromkeys(groups.tolist()):
                mine = values[np.asarray(groups == g) if g is not None else np.asarray(groups.isna())]
                before = seen.get(g, 0)
                found += [(g, name, side, float(mine[rank - before])) for h, rank, name, side in asked.get(part, ()) if h == g and before <= rank < before + len(mine)]
                seen[g] = before + len(mine)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((batch.schema.field("g").type, pa.string(), pa.int32(), pa.float64()))], names=["g", "name", "side", "v"])

    picked = kept.mapInArrow(pick, f"g {kind}, name string, side int, v double")
    weights = df.sparkSession.createDataFrame([(g, name, w) for (g, name), w in share.items()] or [], f"g {kind}, name string, w double")
    both = picked.join(F.broadcast(weights), (picked["g"].eqNullSafe(weights["g"])) & (picked["name"] == weights["name"])).select(picked["g"], picked["name"], "side", "v", "w")
    part = F.when(F.col("side") == 0, F.col("v") * (1 - F.col("w"))).otherwise(F.col("v") * F.col("w"))
    one = lambda name: F.sum(F.when(F.col("name") == name, part)).alias(name)
    return both.groupBy(F.col("g").alias(by)).agg(*(one(name) for name in quantiles))
