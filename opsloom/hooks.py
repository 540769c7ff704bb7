"""Where models are plugged in, with defaults that need none, and the data tools of an agent as SQL functions.

A hook is a function from columns to a column, or from a table to a table. Defaults are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import rewriting
from opsloom.operators import retrieval

#: Embedding models: text to vector.
EMBEDDERS = rewriting.EMBEDDERS
#: Rerankers: tokens of query and text to a score.
RERANKERS: dict[str, Callable[[Column, Column], Column]] = {"lexical": retrieval.lexical_overlap}
#: Describers of images, from their content; nothing is known of one without a model.
DESCRIBERS: dict[str, Callable[[Column], Column]] = {"none": lambda content: F.lit(None).cast("string")}
#: Readers of text in images.
READERS: dict[str, Callable[[Column], Column]] = {"none": lambda content: F.lit("")}
#: Chat models: prompt to answer, null where the model fails.
CHATS: dict[str, Callable[[Column], Column]] = {"mock": lambda prompt: F.concat(F.lit("[mock] "), F.substring(prompt, 1, 80))}
#: Retrievers: (query_id, query) to hits.
RETRIEVERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def chat(prompt: Column, *models: str) -> Column:
    """The answer of the first model that gives one, in the order named."""
    return F.coalesce(*(CHATS[m](prompt) for m in models))


def other_question(question: Column, *models: str) -> Column:
    """Another way to ask, by a model; null where it is the same question again."""
    answer = chat(F.concat(F.lit("Ask differently: "), question), *models)
    return F.when(F.trim(answer) != F.trim(question), answer)


#: The data tools of an agent, as SQL functions over the tables.
TOOLS = {
    "query_alerts": """(svc STRING) RETURNS TABLE (severity STRING, alerts BIGINT) RETURN
        SELECT labels['severity'], count(*) FROM alert_deliveries WHERE labels['service'] = svc GROUP BY 1""",
    "query_metrics": """(kind STRING) RETURNS TABLE (day BIGINT, mean DOUBLE) RETURN
        SELECT floor(unix_seconds(CAST(ts AS TIMESTAMP)) / 86400), round(avg(value), 6) FROM events WHERE event_type = kind GROUP BY 1""",
    "search_titles": """(word STRING) RETURNS TABLE (doc_id BIGINT, title STRING) RETURN
        SELECT doc_id, title FROM documents WHERE contains(title, word)""",
}


def register_tools(spark: SparkSession, folder: str) -> None:
    """Makes the tools known to SQL, over the tables of a folder as temporary views."""
    for name in ("alert_deliveries", "events", "documents"):
        spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").createOrReplaceTempView(name)
    for name, body in TOOLS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
