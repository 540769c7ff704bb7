"""Operators on metric samples: selectors, counter increase and rate, grids, quantiles from buckets, held conditions, trends.

Samples are rows with a series key, a time in whole seconds and a value. Nulls in any of the three take no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def selector(labels: Column, text: str) -> Column:
    """The label matchers of ``{a="x",b!="y",c=~"z.*",d!~"w"}`` as a column; patterns match the whole value.

    A label that isn't set counts as empty.
    """
    terms = F.lit(True)
    for name, op, value in re.findall(r'(\w+)\s*(=~|!~|!=|=)\s*"((?:[^"\\]|\\.)*)"', text):
        have = F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))
        found = have.rlike(f"^(?:{value})$") if "~" in op else have == F.lit(value)
        terms = terms & (~found if op[0] == "!" else found)
    return terms


def increases(samples: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    """samples with ``delta``: what the counter grew by since the sample before; after a reset it counts from zero."""
    before = F.lag(value).over(W.partitionBy(*series).orderBy(ts, value))
    delta = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return samples.withColumn("delta", F.coalesce(delta, F.lit(0.0)))


def rate(samples: DataFrame, series: list[str], ts: str, value: str, window_s: int) -> DataFrame:
    """(series, bucket, increase, rate) per tumbling window, without extrapolation to the window's ends."""
    bucket = (F.floor(F.col(ts) / window_s) * window_s).cast("bigint").alias("bucket")
    grown = increases(samples, series, ts, value).groupBy(*series, bucket).agg(F.sum("delta").alias("increase"))
    return grown.withColumn("rate", F.col("increase") / window_s)


def on_grid(samples: DataFrame, series: list[str], ts: str, value: str, step_s: int, stale_s: int) -> DataFrame:
    """(series, at, value): at each multiple of the step, the latest sample not older than ``stale_s``.

    Each sample knows the next one of its series, so it yields the grid points that it holds for; nothing is joined.
    """
    nxt = F.lead(ts).over(W.partitionBy(*series).orderBy(ts, value))
    first = (F.ceil(F.col(ts) / step_s) * step_s).cast("bigint")
    held = F.least(F.col(ts) + stale_s, F.coalesce(F.col("__next") - 1, F.col(ts) + stale_s))
    last = (F.floor(held / step_s) * step_s).cast("bigint")
    spans = samples.withColumn("__next", nxt).withColumn("__a", first).withColumn("__b", last).filter("__a <= __b")
    return spans.select(*series, F.explode(F.sequence("__a", "__b", F.lit(step_s).cast("bigint"))).alias("at"), value)


def bucket_quantile(buckets: DataFrame, by: list[str], le: str, count: str, q: float) -> DataFrame:
    """(by, value): a quantile from cumulative buckets, linear inside its bucket.

    The bound of the last bucket is infinite; a quantile that falls into it is the largest finite bound.
    """
    w = W.partitionBy(*by).orderBy(le)
    total = F.max(count).over(W.partitionBy(*by))
    rows = buckets.select(
        *by, F.col(le).alias("le"), F.col(count).alias("n"), (total * q).alias("want"), F.lag(le, 1, 0.0).over(w).alias("low"), F.lag(count, 1, 0).over(w).alias("below")
    )
    hit = rows.filter(F.col("n") >= F.col("want"))
    first = hit.groupBy(*by).agg(F.min_by(F.struct("le", "n", "low", "below", "want"), "le").alias("x"))
    inside = F.col("x.low") + (F.col("x.le") - F.col("x.low")) * (F.col("x.want") - F.col("x.below")) / F.nullif(F.col("x.n") - F.col("x.below"), F.lit(0))
    value = F.when(F.col("x.le") == F.lit(float("inf")), F.col("x.low")).otherwise(F.coalesce(inside, F.col("x.le")))
    return first.select(*by, value.alias("value"))


def runs_of(points: DataFrame, series: list[str], at: str, holds: Column) -> DataFrame:
    """(series, start, end, points) of each unbroken run of points for which a condition holds."""
    w = W.partitionBy(*series).orderBy(at)
    flagged = points.withColumn("__holds", F.coalesce(holds, F.lit(False)))
    turned = F.when(F.col("__holds") != F.lag("__holds", 1, False).over(w), 1).otherwise(0)
    numbered = flagged.withColumn("__turn", turned)
    numbered = numbered.withColumn("__run", F.sum("__turn").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (
        numbered.filter("__holds")
        .groupBy(*series, "__run")
        .agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("points"))
        .drop("__run")
    )


def trend(samples: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    """(series, slope, r): least-squares slope per second and correlation, 0 where they aren't defined."""
    x, y = F.col(ts).cast("double"), F.col(value).cast("double")
    return samples.groupBy(*series).agg(
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.coalesce(F.nanvl(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)), F.lit(0.0)).alias("r"),
    )


def sessions(events: DataFrame, series: list[str], ts: str, gap_s: int) -> DataFrame:
    """(series, session_no, start, end, events): runs of events less than ``gap_s`` apart."""
    w = W.partitionBy(*series).orderBy(ts)
    fresh = F.when(F.coalesce(F.col(ts) - F.lag(ts).over(w) > gap_s, F.lit(True)), 1).otherwise(0)
    numbered = events.withColumn("__fresh", fresh)
    numbered = numbered.withColumn("session_no", F.sum("__fresh").over(w.rangeBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*series, "session_no").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("events"))


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, since: str, within_s: int, keep: list[str]) -> DataFrame:
    """left with, of ``right``, the columns ``keep`` of the latest row of the same key at most ``within_s`` before.

    An as-of join by one sort: both sides are merged in order of time per key, and each row of the left looks back to
    the last row of the right. Ties in time count as before.
    """
    r = right.select(F.col(key), F.col(since).alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(since).alias("__since"), *keep).alias("__r"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("__l"))
    le = left.select(F.col(key), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    w = W.partitionBy(key).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    seen = r.unionByName(le).withColumn("__last", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    near = F.col("__t") - F.col("__last.__since") <= within_s
    return seen.select("__l.*", *(F.when(near, F.col(f"__last.{c}")).alias(c) for c in keep))
