"""Streams over event files: windowed rates, sessions, deduplication and held conditions, with their batch twins.

Event time is the events' own; rows later than the watermark are dropped. Every stream runs over what is there
(``availableNow``), writes each micro-batch into the shared folder, and gives the written rows back, so a restart after
a lost executor or driver goes on from the checkpoint beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsloom.session import scratch_path

WATERMARK = "10 minutes"


def source(spark: SparkSession, folder: str, name: str, event_time: str, watermark: str = WATERMARK) -> DataFrame:
    """A table's files as a stream with a watermark on its event time."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    known = spark.read.parquet(path)
    reader = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", 64)
    files = known.inputFiles()
    if files and files[0].endswith(f"/{name}.parquet"):  # one file, not a folder of them
        reader, path = reader.option("pathGlobFilter", f"{name}.parquet"), folder
    rows = reader.parquet(path)
    return rows.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, watermark)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream has written once it has gone through its input; see ``run_counted``."""
    return run_counted(stream, mode)[0]


def run_counted(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, int]:
    """The rows that a stream has written once it has gone through its input, and how many rows came too late for it.

    In append mode a window is written when the watermark has passed its end, and its state is given up, so the state is
    bounded by the watermark; windows that are open at the end aren't written. Rows are written under the number of the
    micro-batch, so that one that is repeated after a failure overwrites itself. In complete mode each micro-batch
    replaces what was there.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")
    kept = "all" if mode == "complete" else ""
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={kept or number}")
        written.append(number)

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    names = [f.name for f in stream.schema.fields]
    if not written:
        return spark.createDataFrame([], stream.schema), late
    return spark.read.schema(stream.schema).parquet(f"{base}/rows").select(*names), late


def window_rate(events: DataFrame, by: str, event_time: str, size: str, slide: str | None = None) -> DataFrame:
    """(by, start, events, total) per window; the same expression for a stream and for a table."""
    w = F.window(event_time, size, slide) if slide else F.window(event_time, size)
    grouped = events.groupBy(F.col(by), w.alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(by, F.unix_seconds("w.start").alias("start"), "events", "total")


def closed(windows: DataFrame, end: Column, events: DataFrame, event_time: str, watermark: str = WATERMARK) -> DataFrame:
    """The windows of a table that a stream over it has written: those that end at or before its final watermark."""
    last = events.agg((F.max(event_time) - F.expr(f"INTERVAL {watermark}")).alias("__last"))
    return windows.join(F.broadcast(last), end <= F.col("__last")).drop("__last")


def session_rate(events: DataFrame, by: str, event_time: str, gap: str) -> DataFrame:
    """(by, start, events) per run of events less than the gap apart."""
    grouped = events.groupBy(F.col(by), F.session_window(event_time, gap).alias("w")).agg(F.count("*").alias("events"))
    return grouped.select(by, F.unix_seconds("w.start").alias("start"), "events")


def first_deliveries(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark's horizon: at-least-once made once, in bounded state."""
    return events.dropDuplicatesWithinWatermark(keys)


def held(events: DataFrame, by: str, event_time: str, at_least: int, hold_s: int) -> DataFrame:
    """(by, fired_at, events): each time a key's events keep coming for ``hold_s`` with no gap as long as that.

    The state of a key is three numbers. It is given up when event time has passed its last event by ``hold_s``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, last, n, fired = state.get if state.exists else (0, 0, 0, 0)
        out = []
        times = sorted(int(t) for f in frames for t in f["s"])
        for t in times:
            if not n or t - last > hold_s:
                since, n, fired = t, 0, 0
            last, n = t, n + 1
            if not fired and n >= at_least and last - since >= hold_s:
                fired = 1
                out.append((key[0], last, n))
        state.update((since, last, n, fired))
        state.setTimeoutTimestamp(max(last * 1000 + hold_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[by, "fired_at", "events"])

    rows = events.filter(F.col(event_time).isNotNull()).withColumn("s", F.unix_seconds(F.col(event_time)))
    kind = dict(events.dtypes)[by]
    return rows.select(by, event_time, "s").groupBy(by).applyInPandasWithState(
        step, f"{by} {kind}, fired_at bigint, events int", "since bigint, last bigint, n int, fired int", "append", GroupStateTimeout.EventTimeTimeout
    )
