"""Queries of the problems on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import leakage, pii, splitting, stuffing, tokens
from opsloom.sources.tables import spread, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = splitting.pieces(
        spread(table(spark, folder, "elements")), table(spark, folder, "split_limits"), "element_id", "element_type", "text", ["heading_path"]
    )
    return cut.filter("oversized").select("element_id").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    cut = splitting.pieces(
        spread(table(spark, folder, "elements")), table(spark, folder, "split_limits"), "element_id", "element_type", "text", ["heading_path"]
    )
    return cut.filter("oversized").drop("oversized").distinct()


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    """Both sources of user texts as (src, rec_id, text)."""
    asked = spread(table(spark, folder, "chat_requests").select(F.lit("chat_requests").alias("src"), F.col("request_id").alias("rec_id"), F.col("message").alias("text")))
    turns = spread(table(spark, folder, "turns").select(F.lit("turns").alias("src"), F.col("turn_id").alias("rec_id"), F.col("content").alias("text")))
    return asked.unionByName(turns)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(_messages(spark, folder), "text", ["src", "rec_id"], table(spark, folder, "name_parts"))
    shown = F.when(F.col("kind").isin("email", "phone", "id_number"), F.col("value")).otherwise("")
    return found.select("src", "rec_id", "kind", shown.alias("found")).distinct()


def p4_masked(spark: SparkSession, folder: str) -> DataFrame:
    texts = pii.mask(_messages(spark, folder), "text", "masked", table(spark, folder, "name_parts"))
    return texts.select("src", "rec_id", "masked").distinct()


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", tokens.ids_of(F.col("text")).alias("ids"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaks(spread(table(spark, folder, "documents").select("doc_id", "text")), table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = stuffing.judged(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")
    return pages.filter(F.col("stuffed_share") > stuffing.LEAST).select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p4_found": p4_found, "p4_masked": p4_masked, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}

SQL = {
    "p1_found": """
        SELECT DISTINCT e.element_id
        FROM elements e
        JOIN split_limits l ON lower(trim(e.element_type, ' ' || chr(9))) = l.element_type
        WHERE length(e.text) > l.max_chars
    """,
}
