from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions import parsing


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


REPORT = "### 现象\n延迟升高\n\n### 根因\n连接池\n耗尽\n### 置信度\n高：证据充分\n#### 行动项\n- 【监控】加告警（负责人：王工，截止：2026-09-01）\n2. 扩容\n普通行\n"


def test_report(spark):
    r = value(spark, parsing.report(F.col("t")), REPORT)
    assert (r.symptom, r.root_cause, r.solution, r.confidence_level) == ("延迟升高", "连接池\n耗尽", None, "high")
    assert value(spark, parsing.report(F.col("t")), "no sections").confidence_level is None


def test_action_items(spark):
    items = value(spark, parsing.action_items(F.col("t")), REPORT)
    assert [(i.category, i.owner, i.deadline) for i in items] == [("监控", "王工", "2026-09-01"), ("其他", None, None)]
    assert items[1].text == "扩容" and value(spark, parsing.action_items(F.col("t")), "") == [] and value(spark, parsing.action_items(F.col("t")), None) is None


def test_variants_and_json(spark):
    assert value(spark, parsing.variants(F.col("t")), '1. "a b"\n- c\n\n2) a b') == ["a b", "c"]
    got = spark.createDataFrame([('said:\n```json\n{"k": [1, 2]}\n```',), ("{broken",), (None,)], "t string")
    assert [r.v for r in got.select(F.try_variant_get(parsing.json_part(F.col("t")), "$.k[1]", "int").alias("v")).collect()] == [2, None, None]


def test_expansions(spark):
    known = {"k8s": ["kubernetes"], "数据库": ["db", "database"]}
    assert value(spark, parsing.expansions(F.col("t"), known), "K8s 的数据库") == ["database", "db", "kubernetes"]
    assert value(spark, parsing.expansions(F.col("t"), known), "dbx") == [] and value(spark, parsing.expansions(F.col("t"), {}), "db") == []
