from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from opsloom import hooks
from opsloom.functions import evidence, rewriting
from opsloom.operators import conversations, evaluation, metrics, retrieval, scoring, stores


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, v array<float>")


def test_dense_agrees_with_brute_force(spark):
    rng = np.random.default_rng(1)
    points = rng.integers(-3, 4, (300, 5)).astype(float)
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(300, None), (301, [1.0, 2.0]), (None, [1.0] * 5), (302, [0.0] * 5)]
    queries = spark.createDataFrame([(k, points[k].tolist()) for k in range(0, 60, 7)], "query_id int, q array<float>")
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in retrieval.dense_top(queries, _vectors(spark, rows).repartition(5), 7).collect()}
    usable = {i: np.array(v) for i, v in rows if i is not None}
    for q in range(0, 60, 7):
        a, best = points[q], []
        for i, b in usable.items():
            fits = b.ndim == 1 and len(b) == 5 and np.linalg.norm(a) * np.linalg.norm(b) > 0
            cos = a @ b / np.linalg.norm(a) / np.linalg.norm(b) if fits else 0.0
            best.append((-round((cos + 1) / 2, 9), i))
        for rank, (score, i) in enumerate(sorted(best)[:7]):
            assert got[q, rank] == (i, pytest.approx(-score, abs=1e-8))
    in_blocks = {(r.query_id, r.rank): r.doc_id for r in retrieval.dense_top(queries, _vectors(spark, rows), 7, block=3).collect()}
    assert in_blocks == {k: i for k, (i, _) in got.items()}
    assert retrieval.dense_top(queries.limit(0), _vectors(spark, rows), 3).count() == 0 and retrieval.dense_top(queries, _vectors(spark, []), 3).count() == 0


def test_best_drops_what_fell_behind(monkeypatch):
    monkeypatch.setattr(scoring, "HELD", 50)
    rng = np.random.default_rng(2)
    scores, best = np.round(rng.random((4, 600)), 2), scoring.Best(4, 5)
    for begin in range(0, 600, 40):
        best.add(scores[:, begin : begin + 40], np.arange(begin, begin + 40))
    q, s, i = best.result()
    want = [(k, -v, n) for k in range(4) for v, n in sorted(zip((-scores[k]).tolist(), range(600)))[:5]]
    assert list(zip(q.tolist(), s.tolist(), i.tolist())) == want


def test_sparse_agrees_with_a_join(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(n, [(t, rng.choice([0.25, 0.5, 1.0])) for t in rng.sample("abcdefgh", rng.randint(0, 4))]) for n in range(200)]
    index = spark.createDataFrame(rows, "doc_id long, terms array<struct<term:string,w:double>>")
    asked = spark.createDataFrame([(q, t, 0.5) for q in range(5) for t in rng.sample("abcdefghz", 3)], "query_id int, term string, w double")
    joined = asked.withColumnRenamed("w", "a").join(index.select("doc_id", F.inline("terms")), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("a") * F.col("w")), 9).alias("score"))
    want = {(r.query_id, r.rank): (r.doc_id, r.score) for r in retrieval.top(joined, 6, ["query_id"]).collect()}
    for size in (1000, 4):
        monkeypatch.setattr(scoring, "BLOCK_WEIGHTS", size)
        assert {(r.query_id, r.rank): (r.doc_id, r.score) for r in retrieval.sparse_top(asked, index, 6, ["query_id"]).collect()} == want


def test_cells_hold_every_row_and_recall_is_measured(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 4
    points = np.concatenate([c + rng.normal(size=(60, 8)) for c in centres])
    vectors = _vectors(spark, [(n, p.tolist()) for n, p in enumerate(points)])
    queries = vectors.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    exact = retrieval.dense_top(queries, vectors, 10)
    found = retrieval.approximate_top(queries, vectors, 10, 12, 4, sample=300)
    assert retrieval.recall(found, exact).first().recall >= 0.9
    every = retrieval.approximate_top(queries, vectors, 10, 12, 12, sample=300)
    assert retrieval.recall(every, exact).first().recall == 1.0


def test_heading_filter_falls_back_for_each_query(spark):
    rows = [(1, 10, 0.5, ["disk"], "the disk", "x"), (1, 11, 0.4, ["disk"], "no", "Disk full"), (1, 12, 0.9, ["disk"], "no", None), (2, 10, 0.3, ["zzz"], "a", "b"), (2, 11, 0.2, ["zzz"], None, None)]
    df = spark.createDataFrame(rows, "query_id int, parent_id int, score double, terms array<string>, text string, title string")
    got = {(r.query_id, r.parent_id): r.score for r in retrieval.heading_filter(df, F.col("terms"), F.col("text"), F.col("title")).collect()}
    assert got == {(1, 10): 0.5, (1, 11): 0.45, (2, 10): 0.3, (2, 11): 0.2}


def test_fusion_of_unknown_kind_is_by_ranks_and_convex_asks_for_two(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 0)], "query_id int, doc_id int, score double, rank int")
    assert retrieval.fused([a, a], "no such").first().score == pytest.approx(2 / 61)
    assert retrieval.fused([a, a], "convex", [0.4, 0.6]).first().score == pytest.approx(0.9)
    with pytest.raises(ValueError):
        retrieval.fused([a], "convex", [1.0])


def test_vectors_and_sigmoid(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    rows = df.select(retrieval.cosine(F.col("a"), F.col("b")).alias("c"), retrieval.unit(F.col("a")).alias("u"), retrieval.sigmoid(F.lit(0.0)).alias("s")).collect()
    assert [r.c for r in rows] == [pytest.approx(0.96), 0.0, 0.0, 0.0] and rows[0].u == [0.6, 0.8] and rows[1].u == [0.0, 0.0] and rows[0].s == 0.5


def test_variants(spark):
    df = spark.createDataFrame([("docker 怎么用",), (" ",), (None,), ("plain words",), ("我 用 git",)], "q string")
    got = [r.v for r in df.select(rewriting.enhanced(F.col("q")).alias("v")).collect()]
    assert got[0][:2] == ["docker 怎么用", "docker"] and any("container" in v for v in got[0]) and got[1] == [" "] and got[2] == [None]
    assert got[3] == ["plain words"] and "用 git" in got[4]


def first_similar_by_hand(rows, least):
    out = {}
    for k, u, words in rows:
        mine = set(words)
        near = [j for j, v, other in rows if v == u and j < k and mine and other and len(mine & set(other)) >= least * len(mine | set(other))]
        if near:
            out[u, k] = min(near)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_first_similar_is_that_found_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choice("uv"), [rng.choice("aaaabcdefgh") for _ in range(rng.randint(0, 6))]) for k in range(120)]
    df = spark.createDataFrame(rows, "k int, u string, w array<string>")
    for least in (0.4, 0.8, 1.0):
        got = {(r.u, r.k): r.earlier for r in conversations.first_similar(df, "u", "k", F.col("w"), least).collect()}
        assert got == first_similar_by_hand(rows, least)


@pytest.mark.parametrize("seed", range(3))
def test_first_similar_over_blocks_batches_and_long_entries(spark, seed, monkeypatch):
    """Owners of several blocks, cells over several batches, numbers given anew, and entries of more tokens than sketches have bits."""
    rng = random.Random(seed)
    rows = [(k // 2, rng.choice("uuuv"), [f"t{rng.randint(0, rng.choice([8, 20, 3000]))}" for _ in range(rng.choice([0, 3, 8, 20, 3000]))]) for k in range(160)]
    near = rows[150][2] and rows[150][2] + ["more"]
    rows += [(200, "u", near), (201, None, near), (None, "u", near)]
    want = first_similar_by_hand([r for r in rows if r[0] is not None and r[1]], 0.4)
    monkeypatch.setattr(conversations, "BLOCK", 16)
    monkeypatch.setattr(conversations, "SKETCHED", 64)
    monkeypatch.setattr(conversations, "COMPARED", 100)
    monkeypatch.setattr(conversations, "KEPT_TOKENS", 50)
    df = spark.createDataFrame(rows, "k int, u string, w array<string>")
    sent = []
    keep = conversations._compare
    with monkeypatch.context() as m:
        m.setattr(conversations, "_compare", lambda least, schema: sent.append(schema) or keep(least, schema))
        got = {(r.u, r.k): r.earlier for r in conversations.first_similar(df, "u", "k", F.col("w"), 0.4).collect()}
    assert got == want and want
    # The same in this process, where the small limits hold, in batches of seven rows.
    cells = [(u, k, 0, 0, 0, list(dict.fromkeys(w))) for k, u, w in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: (r[1], r[0]))]
    kinds = pa.schema([("__owner", pa.string()), ("__order", pa.int32()), ("__i", pa.int32()), ("__j", pa.int32()), ("__block", pa.int32()), ("__w", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, c)) for c in cells[n : n + 7]], kinds) for n in range(0, len(cells), 7)]
    found = [r for b in keep(0.4, sent[0])(iter(batches)) for r in b.to_pylist()]
    assert {(r["u"], r["k"]): min(x["earlier"] for x in found if (x["u"], x["k"]) == (r["u"], r["k"])) for r in found} == want


def test_first_similar_makes_no_row_for_a_token(spark):
    """Entries are sent as they are: the only rows that are added are those of an owner's blocks."""
    df = spark.createDataFrame([(1, "u", "a b")], "k int, u string, t string")
    plan = conversations.first_similar(df, "u", "k", F.split("t", " "), 0.4)._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate" in line]
    assert len(made) == 1 and "sequence" in made[0]


@pytest.mark.parametrize("parts", ["1", "4"])
def test_exact_quantiles(spark, parts):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.random() * 10, 5.0, 5.0, None])) for _ in range(500)] + [("one", 3.0), ("none", None)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p0, r.p50, r.p99, r.p100) for r in evaluation.exact_quantiles(df, "g", "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for g in {g for g, v in rows if v is not None}:
        values = [v for h, v in rows if h == g and v is not None]
        assert got[g] == pytest.approx(tuple(np.quantile(values, [0, 0.5, 0.99, 1])))
    assert "none" not in got
    assert evaluation.exact_quantiles(df.limit(0), "g", "v", {"p50": 0.5}).count() == 0


def test_risk_levels(spark):
    # (current, slope a minute) to (level, horizon), threshold 10, at most 30 minutes ahead.
    cases = [((12.0, -1.0), (3, 0.0)), ((0.0, 1.0), (2, 10.0)), ((0.0, 0.1), (1, None)), ((5.0, 0.0), (0, None)), ((5.0, 0.01), (0, None)), ((10.0, 0.0), (3, 0.0))]
    df = spark.createDataFrame([c for c, _ in cases], "c double, s double").coalesce(1)
    got = [(r.r.level, r.r.horizon) for r in df.select(metrics.risk(F.col("c"), F.col("s"), 10.0, 30.0, 0.02).alias("r")).collect()]
    assert got == [w for _, w in cases]


def test_counters_reset_and_are_carried_on(spark):
    rows = [("a", 0, 0.0), ("a", 30, 30.0), ("a", 60, 5.0), ("a", 90, 35.0), ("b", 10, 1.0)]
    df = spark.createDataFrame(rows, "series string, s long, v double")
    got = {(r.series, r.at): r.rate for r in metrics.trailing_rate(df, ["series"], "s", "v", 100, 100).collect()}
    # The window (0, 100] holds the samples at 30, 60 and 90: it grew by 5 + 30 over 60 s and is carried on over 30 s to
    # its beginning and 10 s to its end.
    assert got == {("a", 100): pytest.approx(35 * (60 + 30 + 10) / 60 / 100)}


def test_rules_pend_until_they_held_long_enough(spark):
    points = spark.createDataFrame([("cpu", "a", t, v) for t, v in [(0, 95.0), (60, 96.0), (120, 97.5), (180, 50.0), (240, 99.0)]], "metric string, job string, at long, value double")
    rules = metrics.rule_table(spark, [metrics.Rule("Hot", "cpu", ">", 90.0, 120, "critical", "cpu", '{{ $value | printf "%.1f" }}%'), metrics.Rule("None", "ram", ">", 1.0, 0, "info", "ram")])
    got = sorted((r.start, r.end, r.state, r.message) for r in metrics.evaluated(points, rules, ["job"], 60).collect())
    assert got == [(0, 120, "firing", "97.5%"), (240, 240, "pending", "99.0%")]


def test_templates(spark):
    forms = spark.createDataFrame([("{{ $value | humanize1024 }}B", 2048.0), ("{{ $value | humanizePercentage }}", 0.256), ("{{ $value | humanizeDuration }}", 3725.0), ("{{ $value }}", 1.5), ("no value", 1.0)], "t string, v double")
    assert [r.x for r in forms.select(metrics.filled(F.col("t"), F.col("v")).alias("x")).collect()] == ["2.00KiB", "25.60%", "1h 2m", "1.5", "no value"]


def test_stores(spark):
    old = spark.createDataFrame([("a", "one"), ("b", "two")], "id string, text string")
    new = spark.createDataFrame([("a", "one"), ("b", "TWO"), ("c", "x"), ("c", "x"), ("d", ""), (None, "y")], "id string, text string")
    judged = stores.add_status(old, new, "id", "text", F.col("text") == "")
    assert {r.id: r.status for r in judged.collect()} == {"a": "skipped", "b": "updated", "c": "added", "d": "failed"}
    assert {tuple(r) for r in stores.with_added(old, judged, "id").collect()} == {("a", "one"), ("b", "TWO"), ("c", "x")}
    assert {r.id for r in stores.without(old, new, "id", F.col("text") == "none").collect()} == set()
    ids = spark.createDataFrame([("doc-1",), (None,)], "i string").select(stores.point_id(F.col("i")).alias("p")).collect()
    import uuid

    assert ids[0].p == str(uuid.uuid5(uuid.NAMESPACE_DNS, "doc-1")) and ids[1].p is None
    broken = spark.createDataFrame([("中文".encode().decode("latin-1"),), ("plain",), ("é",), (None,)], "n string")
    assert [r.x for r in broken.select(stores.repaired(F.col("n")).alias("x")).collect()][:2] == ["中文", "plain"]


def test_conflict_rules_and_hooks(spark):
    df = spark.createDataFrame([("我喜欢夜班 部署", "我不喜欢夜班 部署"), ("大二", "大三"), ("a", "b")], "a string, b string")
    rows = df.select(evidence.negates(F.col("a"), F.col("b")).alias("n"), evidence.attribute(F.col("a"), 1).alias("x"), evidence.attribute(F.col("a"), 2).alias("y")).collect()
    assert [r.n for r in rows] == [True, False, False] and (rows[1].x, rows[1].y) == ("大", "二")
    assert spark.range(1).select(hooks.chat(F.lit("hello"), "mock").alias("a")).first().a == "[mock] hello"


def test_index_is_built_anew_when_documents_change(spark, tmp_path):
    from opsloom.plans import retrieval_queries

    spark.read.parquet(f"{SMALL}/eval_items.parquet").write.parquet(str(tmp_path / "eval_items.parquet"))
    docs = spark.createDataFrame([(1, "alpha beta", "s", None)], "doc_id long, text string, source string, valid_until string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert retrieval_queries.index(spark, str(tmp_path))[0].count() == 1
    docs.withColumn("doc_id", F.lit(2).cast("long")).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert retrieval_queries.index(spark, str(tmp_path))[0].count() == 2


def test_index_is_built_anew_when_the_shared_folder_was_cleared(spark, tmp_path):
    from opsloom import session
    from opsloom.plans import retrieval_queries

    spark.read.parquet(f"{SMALL}/eval_items.parquet").write.parquet(str(tmp_path / "eval_items.parquet"))
    docs = spark.createDataFrame([(1, "alpha beta", "s", None)], "doc_id long, text string, source string, valid_until string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first = retrieval_queries.index(spark, str(tmp_path))[0]
    assert first.count() == 1 and session.still_staged(first)
    session.clean()
    assert not session.still_staged(first) and retrieval_queries.index(spark, str(tmp_path))[0].count() == 1
