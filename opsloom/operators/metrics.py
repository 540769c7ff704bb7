"""The metric language beyond single series: trailing rates, aggregation by labels, vector arithmetic, rules, templates.

Samples are rows with series columns, a time in whole seconds and a value; nulls in any of them take no part. Two
samples of one series at one time count as the one with the larger value.
"""

from __future__ import annotations

import operator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.operators import timeseries


def trailing_rate(samples: DataFrame, series: list[str], ts: str, value: str, window_s: int, step_s: int) -> DataFrame:
    """(series, at, increase, rate) at each multiple of the step, over the samples of the window that ends there.

    A counter's resets count from zero. The growth between the first and the last sample is carried on to the window's
    ends: fully where a sample was due within a tenth more than the mean distance, else by half that distance, and never
    back beyond where the counter would have been zero. Windows with one sample give nothing.
    """
    one = samples.dropna(subset=[*series, ts, value]).groupBy(*series, F.col(ts).cast("bigint").alias("s")).agg(F.max(value).alias("v"))
    grown = timeseries.increases(one, series, "s", "v")
    first = F.ceil(F.col("s") / step_s) * step_s
    last = F.floor((F.col("s") + window_s - 1) / step_s) * step_s
    placed = grown.filter(first <= last).select(*series, "s", "v", "delta", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(step_s).cast("bigint"))).alias("at"))
    g = placed.groupBy(*series, "at").agg(
        F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b"), F.min_by("v", "s").alias("v"), (F.sum("delta") - F.min_by("delta", "s")).alias("d")
    )
    g = g.filter("n > 1").withColumn("mean", (F.col("b") - F.col("a")) / (F.col("n") - 1))
    ahead, behind = F.col("a") - (F.col("at") - window_s), F.col("at") - F.col("b")
    due = lambda gap: F.when(gap < 1.1 * F.col("mean"), gap).otherwise(F.col("mean") / 2)
    zero = F.when((F.col("d") > 0) & (F.col("v") >= 0), (F.col("b") - F.col("a")) * F.col("v") / F.col("d"))
    reach = F.col("b") - F.col("a") + F.least(due(ahead), zero) + due(behind)
    grown = F.col("d") * reach / (F.col("b") - F.col("a"))
    return g.select(*series, "at", grown.alias("increase"), (grown / window_s).alias("rate"))


def by_labels(points: DataFrame, by: list[str], value: str, how: str) -> DataFrame:
    """(by, value) with sum, avg, min, max or count of the points of each set of labels."""
    fn = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[how]
    return points.groupBy(*by).agg(fn(value).alias(value))


ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": F.try_divide}
COMPARISON = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def combined(left: DataFrame, right: DataFrame, on: list[str], op: str, value: str = "value") -> DataFrame:
    """(on, value): two vectors of points that agree in their labels. A comparison keeps the left value where it holds."""
    both = left.select(*on, F.col(value).alias("__a")).join(right.select(*on, F.col(value).alias("__b")), on)
    a, b = F.col("__a"), F.col("__b")
    if op in COMPARISON:
        return both.filter(COMPARISON[op](a, b)).select(*on, a.alias(value))
    return both.select(*on, ARITHMETIC[op](a, b).alias(value))


def clamp_min(x: Column, least: float) -> Column:
    return F.greatest(x, F.lit(least))


class Rule(NamedTuple):
    """An alert: when a metric compares so to a threshold for so long, with what labels and words."""

    name: str
    metric: str
    op: str
    threshold: float
    for_s: int
    severity: str
    category: str
    summary: str = ""


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    kinds = "name string, metric string, op string, threshold double, for_s int, severity string, category string, summary string"
    return spark.createDataFrame([tuple(r) for r in rules], kinds)


def evaluated(points: DataFrame, rules: DataFrame, series: list[str], step_s: int) -> DataFrame:
    """(name, severity, category, series, state, start, end, value, message) of each stretch in which a rule's condition
    held at every grid point.

    points: (metric, series, at, value). The state is firing where the stretch is as long as the rule asks, else pending.
    rules is a table, so any number of rules is one join by metric.
    """
    x, t = F.col("value"), F.col("threshold")
    holds = F.lit(False)
    for op, fn in COMPARISON.items():
        holds = holds | ((F.col("op") == op) & fn(x, t))
    met = points.join(F.broadcast(rules), "metric").filter(holds)
    order = W.partitionBy("name", *series).orderBy("at")
    fresh = F.when(F.col("at") - F.lag("at").over(order) <= step_s, 0).otherwise(1)
    runs = met.withColumn("__f", fresh).withColumn("__run", F.sum("__f").over(order.rowsBetween(W.unboundedPreceding, 0)))
    g = runs.groupBy("name", "severity", "category", "for_s", "summary", *series, "__run").agg(
        F.min("at").alias("start"), F.max("at").alias("end"), F.max_by("value", "at").alias("value")
    )
    state = F.when(F.col("end") - F.col("start") >= F.col("for_s"), "firing").otherwise("pending")
    return g.select("name", "severity", "category", *series, state.alias("state"), "start", "end", "value", filled(F.col("summary"), F.col("value")).alias("message"))


def humanized1024(x: Column) -> Column:
    """A number of bytes with the largest binary unit that it reaches."""
    out = F.format_string("%.4g", x)
    for n, unit in enumerate(("Ki", "Mi", "Gi", "Ti"), 1):
        out = F.when(x >= float(1024**n), F.format_string(f"%.2f{unit}", x / float(1024**n))).otherwise(out)
    return F.when(x < 1024, F.format_string("%.2f", x)).otherwise(out)


def percentage(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)


def humanized_duration(x: Column) -> Column:
    """Seconds as milliseconds, seconds, minutes and seconds, or hours and minutes."""
    whole = F.floor(x).cast("bigint")
    return (
        F.when(x < 1, F.concat(F.format_string("%.0f", x * 1000), F.lit("ms"))).when(x < 60, F.concat(F.format_string("%.1f", x), F.lit("s")))
        .when(x < 3600, F.concat(F.floor(whole / 60), F.lit("m "), whole % 60, F.lit("s"))).otherwise(F.concat(F.floor(whole / 3600), F.lit("h "), F.floor(whole % 3600 / 60), F.lit("m")))
    )


def filled(template: Column, value: Column) -> Column:
    """A template with its ``{{ $value }}``, plain or formatted, put in."""
    forms = {
        r"\{\{ *\$value *\| *printf \"%\.1f\" *\}\}": F.format_string("%.1f", value), r"\{\{ *\$value *\| *printf \"%\.2f\" *\}\}": F.format_string("%.2f", value),
        r"\{\{ *\$value *\| *humanize1024 *\}\}": humanized1024(value), r"\{\{ *\$value *\| *humanizePercentage *\}\}": percentage(value),
        r"\{\{ *\$value *\| *humanizeDuration *\}\}": humanized_duration(value), r"\{\{ *\$value *\}\}": value.cast("string"),
    }
    for pattern, shown in forms.items():
        template = F.regexp_replace(template, F.lit(pattern), F.coalesce(shown, F.lit("")))
    return template


def instant(samples: DataFrame, series: list[str], ts: str, value: str, at: int, back_s: int = 300) -> DataFrame:
    """(series, at, value): the latest sample of each series up to a moment, unless it is older than ``back_s``."""
    near = samples.filter((F.col(ts) <= at) & (F.col(ts) > at - back_s))
    return near.groupBy(*series).agg(F.max_by(value, F.struct(ts, value)).alias("value")).select(*series, F.lit(at).alias("at"), "value")


def ranged(samples: DataFrame, series: list[str], ts: str, value: str, end: int, minutes: int, step_s: int = 60, stale_s: int = 300) -> DataFrame:
    """(series, at, value) on the grid of the last minutes before a moment."""
    near = samples.filter((F.col(ts) <= end) & (F.col(ts) > end - minutes * 60 - stale_s))
    one = near.groupBy(*series, F.col(ts).alias("s")).agg(F.max(value).alias("value"))
    return timeseries.on_grid(one, series, "s", "value", step_s, stale_s).filter((F.col("at") >= end - minutes * 60) & (F.col("at") <= end))


def risk(current: Column, slope_per_min: Column, threshold: float, horizon_min: float, rising_ratio: float) -> Column:
    """struct(level, horizon): 3 where the threshold is reached, 2 where it will be within the horizon, 1 where the value
    rises by more than the ratio a minute, 0 else. The horizon is in minutes, null where there is none."""
    rises = (slope_per_min > 0) & ((current <= 0) | (slope_per_min >= F.abs(current) * rising_ratio))
    ahead = (F.lit(threshold) - current) / F.nullif(slope_per_min, F.lit(0.0))
    horizon = F.when(current >= threshold, 0.0).when(rises & (ahead <= horizon_min), ahead)
    level = F.when(current >= threshold, 3).when(~rises, 0).when(horizon.isNotNull(), 2).otherwise(1)
    return F.struct(level.alias("level"), horizon.alias("horizon"))


#: Risk analysers by name, each from (current, slope per minute) to a risk; further ones can be put in.
ANALYZERS = {
    "p99": lambda current, slope: risk(current, slope, 1.0, 30.0, 0.02),
    "pool": lambda current, slope: risk(current, slope, 4.0, 30.0, 0.02),
}


def registry(calls: DataFrame, name: str, labels: list[str], kind: str, ts: str, value: str, bounds: list[float]) -> DataFrame:
    """(name, labels, kind, total, last, buckets): counters as sums, gauges as the last value, histograms as cumulative
    counts below each bound."""
    below = F.array(*(F.count_if(F.col(value) <= b) for b in bounds))
    g = calls.groupBy(name, *labels, kind).agg(F.sum(value).alias("sum"), F.max_by(value, F.struct(ts, value)).alias("newest"), below.alias("below"))
    is_ = lambda k: F.col(kind) == k
    return g.select(
        name, *labels, kind, F.when(is_("counter"), F.col("sum")).alias("total"), F.when(is_("gauge"), F.col("newest")).alias("last"), F.when(is_("histogram"), F.col("below")).alias("buckets")
    )
