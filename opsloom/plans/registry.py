"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from opsloom.plans import agent_queries, conversation_queries, core_problems, metric_queries, retrieval_queries, series_queries, store_queries, stream_queries, structure_queries, text_queries

FLAGSHIP = "hybrid_parent_child"
MODULES = [core_problems, retrieval_queries, text_queries, series_queries, conversation_queries, stream_queries, structure_queries, metric_queries, store_queries, agent_queries]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
