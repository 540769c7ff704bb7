"""Continuous periods and gaps of overlapping, nested and separate intervals per entity.

The intervals are range-sorted by entity and start over all partitions, so an entity may span many of them and no task
holds an entity whole. A first pass sums each partition up in one row (the reach of its last entity and where that
entity's last island would begin), the summaries are combined in order, and a second pass walks each partition again
with the state carried into it and labels every interval with the start of its island.

Defined results: intervals with a null entity or bound, or with an end not after the start, don't count. Intervals that
overlap or touch form one period. Repeated rows and ties change nothing. Columns of the input besides those named are
ignored, so clashing names do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.session import cut, stage_table

SUMMARY = "part int, head array<string>, tail array<string>, reach bigint, last_start bigint"
FRAGMENT = "entity array<string>, kind string, from_us bigint, to_us bigint"


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in frames:
        yield from zip(pdf["part"].tolist(), map(tuple, pdf["entity"]), pdf["from_us"].tolist(), pdf["to_us"].tolist())


def _summary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each partition: its first and last entity, and of the last one how far it reaches and where its last island begins."""
    head = tail = None
    part, reach, last_start = None, 0, 0
    for part, entity, start, end in _rows(frames):  # noqa: B007
        head = head or entity
        if entity != tail:
            tail, reach, last_start = entity, end, start
        else:
            if start > reach:
                last_start = start
            reach = max(reach, end)
    rows = [(part, list(head), list(tail), reach, last_start)] if head else []
    yield pd.DataFrame(rows, columns=["part", "head", "tail", "reach", "last_start"])


def _carried(summaries: list) -> dict[int, tuple]:
    """The entity, reach and island start that each partition begins with.

    With a reach R carried in, the last island of a partition of one entity still begins at its own last start if that
    lies beyond R; otherwise R covers every start in it and the carried island goes on.
    """
    state: tuple | None = None
    out = {}
    for s in summaries:
        out[s.part] = state
        tail = tuple(s.tail)
        if state and state[0] == tail and tuple(s.head) == tail:
            state = (tail, max(state[1], s.reach), s.last_start if s.last_start > state[1] else state[2])
        else:
            state = (tail, s.reach, s.last_start)
    return out


def _label(carried: dict[int, tuple | None]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, reach, island, fresh = None, 0, 0, True
        out: list[tuple] = []
        for part, now, start, end in _rows(frames):
            if fresh:
                fresh = False
                if carried.get(part):
                    entity, reach, island = carried[part]
            if now != entity:
                if entity is not None:
                    out.append((list(entity), "period", island, reach))
                entity, reach, island = now, end, start
            elif start > reach:
                out.append((list(entity), "period", island, reach))
                out.append((list(entity), "gap", reach, start))
                reach, island = end, start
            else:
                reach = max(reach, end)
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=["entity", "kind", "from_us", "to_us"])
                out.clear()
        if entity is not None:
            out.append((list(entity), "period", island, reach))
        yield pd.DataFrame(out, columns=["entity", "kind", "from_us", "to_us"])

    return run


def periods_and_gaps(df: DataFrame, entity: list[str], start: str, end: str) -> DataFrame:
    """(*entity, kind, from_us, to_us) of the intervals [start, end) of df, given in microseconds.

    kind is ``period`` for a continuous period, ``gap`` for the time between two consecutive periods of an entity.
    """
    for c in (*entity, start, end):
        df = df.filter(F.col(c).isNotNull())
    slim = df.filter(F.col(end) > F.col(start)).select(
        F.array(*(F.col(c).cast("string") for c in entity)).alias("entity"),
        F.col(start).cast("bigint").alias("from_us"),
        F.col(end).cast("bigint").alias("to_us"),
    )
    keys = ["entity", "from_us", "to_us"]
    # Written once, as the range sort reads its input twice.
    slim = stage_table(slim, "intervals")
    # The random last key spreads copies of one interval over partitions; it decides nothing.
    spread = slim.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    placed = spread.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys).drop("salt")
    kept = cut(placed.withColumn("part", F.spark_partition_id()))
    summaries = sorted(kept.mapInPandas(_summary, SUMMARY).collect(), key=lambda r: r.part)
    pieces = kept.mapInPandas(_label(_carried(summaries)), FRAGMENT)
    # An island that runs through several partitions leaves a fragment in each, all with the same start. The partial
    # aggregation before the exchange leaves one row for each island and partition.
    whole = pieces.groupBy("entity", "kind", "from_us").agg(F.max("to_us").alias("to_us"))
    named = [F.col("entity")[i].alias(c) for i, c in enumerate(entity)]
    return whole.select(*named, "kind", "from_us", "to_us")
