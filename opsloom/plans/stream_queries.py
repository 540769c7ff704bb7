"""Queries that run a stream over the events and give back what it wrote, with the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.sources.tables import table
from opsloom.streaming import streams


def stream_rate(spark, d):
    """Windows that the watermark has passed, in append mode."""
    return streams.run(streams.window_rate(streams.source(spark, d, "events", "ts"), "event_type", "ts", "6 hours"))


# The watermark stands ten minutes before the last event, in whole milliseconds.
_LAST = "(SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events)"
STREAM_RATE = f"""SELECT event_type, epoch_us(ts) // 1000000 // 21600 * 21600 AS start, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING (start + 21600) * 1000000 <= {_LAST}"""


def stream_sliding(spark, d):
    return streams.run(streams.window_rate(streams.source(spark, d, "events", "ts"), "event_type", "ts", "1 day", "12 hours"))


STREAM_SLIDING = f"""WITH w AS (SELECT event_type, value, epoch_us(ts) // 1000000 // 43200 * 43200 - unnest([0, 43200]) AS start FROM events)
    SELECT event_type, start, count(*) AS events, round(sum(value), 4) AS total FROM w GROUP BY 1, 2 HAVING (start + 86400) * 1000000 <= {_LAST}"""


def stream_sessions(spark, d):
    """Sessions that the watermark has passed, in append mode."""
    return streams.run(streams.session_rate(streams.source(spark, d, "events", "ts"), "user_id", "ts", "30 minutes"))


STREAM_SESSIONS = f"""
    WITH l AS (SELECT user_id, epoch_us(ts) AS s, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
    n AS (SELECT user_id, s, sum(CASE WHEN b IS NULL OR s - b >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s RANGE UNBOUNDED PRECEDING) AS no FROM l)
    SELECT user_id, min(s) // 1000000 AS start, count(*) AS events FROM n GROUP BY user_id, no HAVING max(s) + 1800000000 <= {_LAST}"""


def stream_late(spark, d):
    """How many windows a stream wrote, and how many rows came too late for it: none where each file is one batch."""
    rows, late = streams.run_counted(streams.window_rate(streams.source(spark, d, "events", "ts"), "event_type", "ts", "1 day"))
    return rows.agg(F.count("*").alias("windows"), F.sum("events").alias("events")).withColumn("late", F.lit(late).cast("bigint"))


STREAM_LATE = f"""SELECT count(*) AS windows, sum(n)::BIGINT AS events, 0::BIGINT AS late FROM (SELECT event_type, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY 1, 2) WHERE (day + 1) * 86400000000 <= {_LAST}"""


def stream_dedup(spark, d):
    """How many different deliveries by batch and fingerprint a stream lets through, by day; its horizon covers the table."""
    rows = streams.source(spark, d, "alert_deliveries", "received_at", "400 days").select("fingerprint", "batch_id", "received_at")
    out = streams.run(streams.first_deliveries(rows, ["fingerprint", "batch_id"]), "append")
    return out.groupBy("batch_id").agg(F.count("*").alias("fingerprints"))


STREAM_DEDUP = "SELECT batch_id, count(*) AS fingerprints FROM (SELECT DISTINCT batch_id, fingerprint FROM alert_deliveries WHERE received_at IS NOT NULL) GROUP BY 1"


def stream_held(spark, d):
    return streams.run(streams.held(streams.source(spark, d, "events", "ts"), "user_id", "ts", 3, 36000), "append")


def batch_rate(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.window_rate(rows, "event_type", "ts", "1 day")


BATCH_RATE = """SELECT event_type, epoch_us(ts) // 1000000 // 86400 * 86400 AS start, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""

QUERIES = {
    "stream_rate": stream_rate, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions, "stream_dedup": stream_dedup, "stream_held": stream_held,
    "stream_late": stream_late, "batch_rate": batch_rate,
}
SQL = {"stream_rate": STREAM_RATE, "stream_sliding": STREAM_SLIDING, "stream_sessions": STREAM_SESSIONS, "stream_dedup": STREAM_DEDUP, "stream_late": STREAM_LATE, "batch_rate": BATCH_RATE}
