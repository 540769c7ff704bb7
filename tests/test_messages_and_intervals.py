from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsloom.operators import dedup, intervals


@given(st.lists(st.tuples(*[st.integers(-(2**63), 2**63 - 1)] * 3), min_size=1, max_size=20))
@settings(max_examples=50, deadline=None)
def test_permutation_turns_back(rows):
    lanes = np.array(rows, np.int64).T.copy()
    assert (dedup.unpermute(dedup.permute(lanes.copy())) == lanes).all()


def test_table_keeps_each_identifier_once():
    rng = np.random.default_rng(1)
    lanes = rng.integers(0, 3, (3, 5000))
    # The same first lane for many, so that slots collide.
    table = dedup.QuotientTable(5000)
    for part in np.array_split(np.arange(5000), 7):
        table.insert(lanes[:, part].copy(), part, np.ones(len(part), np.int64))
    batch = table.batch()
    want = defaultdict(list)
    for k in range(5000):
        want[tuple(lanes[:, k])].append(k)
    got = {tuple(r[c] for c in dedup.LANES): (r["kept"], r["n"]) for r in batch.to_pylist()}
    assert got == {k: (min(v), len(v)) for k, v in want.items()}


def test_table_of_a_shard_fills_evenly():
    # All of a shard share their first bits; in place of a crowded part of the table the bits behind those count.
    rng = np.random.default_rng(2)
    lanes = rng.integers(-(2**63), 2**63 - 1, (3, 20_000))
    lanes[0] = lanes[0].view(np.uint64) >> np.uint64(6)
    table = dedup.QuotientTable(20_000, 6)
    table.insert(lanes, np.arange(20_000), np.ones(20_000, np.int64))
    used = np.flatnonzero(table.count)
    assert len(used) == 20_000 and np.histogram(used, 8, (0, len(table.count)))[0].min() > 1500


def _copies(spark, rows, monkeypatch=None):
    df = spark.createDataFrame(rows, "id long, print string, t long, status string, kept string")
    fits = F.col("print").rlike("^[0-9a-f]{16}$")
    lanes = [F.when(fits, dedup.hex64(F.col("print"))), F.col("t"), dedup.pack8(F.col("status"))]
    return df, lanes, [F.col("print"), F.col("t"), F.col("status")]


def test_copies_match_brute_force(spark):
    rng = random.Random(3)
    prints = ["00000000000000ff", "f" * 16, "8000000000000000", "not-hex", "a" * 40, None]
    rows = [(k, rng.choice(prints), rng.choice([5, -5, None]), rng.choice(["firing", "resolved", "acknowledged", ""]), "x") for k in range(600)]
    # One message with a third of all rows, and rows that occur twice whole.
    rows += [(1000 + k, "00000000000000ff", 5, "firing", "x") for k in range(300)] + rows[:20]
    df, lanes, wide = _copies(spark, rows)
    got = sorted({(r.kept_id, r.copy_id) for r in dedup.copies(df.repartition(6), "id", lanes, wide).collect()})
    groups = defaultdict(set)
    for i, p, t, s, _ in rows:
        if None not in (p, t, s):
            groups[p, t, s].add(i)
    assert got == sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    kept = dedup.keep_one(df, "id", lanes, wide)
    assert {r.id for r in kept.collect()} == {r[0] for r in rows} - {i for _, i in got}
    assert kept.columns[0] == "id" and "kept" in kept.columns


def test_shards_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SHARD_ROWS", 64)
    rng = random.Random(4)
    rows = [(k, f"{rng.randint(0, 700):016x}", 5, "firing", "x") for k in range(2000)]
    df, lanes, wide = _copies(spark, rows)
    ids = df.select("id", *(x.alias(n) for x, n in zip(lanes, dedup.LANES))).coalesce(2)
    local = ids.select(*dedup.LANES, "id").mapInArrow(dedup._fold, dedup.ENTRY)
    found = dedup.repeated(ids, 2000)
    assert found.rdd.getNumPartitions() == 32
    top = local.selectExpr("shiftrightunsigned(q0, 59) shard").groupBy("shard").count().agg({"count": "max"}).first()[0]
    assert top <= 2 * dedup.SHARD_ROWS
    groups = defaultdict(list)
    for i, p, *_ in rows:
        groups[p].append(i)
    assert {(r.kept, r.n) for r in found.collect()} == {(min(g), len(g)) for g in groups.values() if len(g) > 1}


def test_copies_of_nothing(spark):
    df, lanes, wide = _copies(spark, [])
    assert dedup.copies(df, "id", lanes, wide).count() == 0


def brute(rows):
    by = defaultdict(list)
    for e, a, b in rows:
        if None not in (e, a, b) and b > a:
            by[e].append((a, b))
    out = set()
    for e, spans in by.items():
        spans.sort()
        lo, hi = spans[0]
        for a, b in spans[1:]:
            if a > hi:
                out |= {(e, "period", lo, hi), (e, "gap", hi, a)}
                lo, hi = a, b
            else:
                hi = max(hi, b)
        out.add((e, "period", lo, hi))
    return out


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 4), (3, 16)])
def test_periods_match_brute_force(spark, seed, parts):
    rng = random.Random(seed)
    rows = []
    for _ in range(500):
        a = rng.randint(0, 3000)
        rows.append((rng.choice(["hot", "hot", "x", "y", None]), rng.choice([a, a, a, None]), a + rng.choice([-3, 0, 1, 5, 20, 400])))
    rows += rows[:50] + [("long", 0, 10_000), ("long", 5, 6), ("long", 10_000, 10_001), ("long", 10_003, 10_004)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    df = spark.createDataFrame(rows, "e string, a long, b long").withColumn("part", F.lit("clash")).withColumn("kind", F.lit(1))
    got = {tuple(r) for r in intervals.periods_and_gaps(df, ["e"], "a", "b").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows)


def test_periods_of_nothing(spark):
    assert intervals.periods_and_gaps(spark.createDataFrame([], "e string, a long, b long"), ["e"], "a", "b").count() == 0
