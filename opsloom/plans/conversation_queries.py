"""Queries of the conversation, store and set operators, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import text
from opsloom.operators import changes, conversations, evaluation, folds, retrieval
from opsloom.sources.tables import table


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of known sessions; rows that occur twice once."""
    return table(spark, d, "turns").filter("session_id IS NOT NULL").select("turn_id", "session_id", "speaker_role", "content").distinct()


TURNS = "t AS (SELECT DISTINCT turn_id, session_id, speaker_role, content FROM turns WHERE session_id IS NOT NULL)"


def session_stats(spark, d):
    t = _turns(spark, d)
    return t.groupBy("session_id").agg(
        F.count("*").alias("turns"), F.count("content").alias("with_content"), F.count_distinct(F.lower(F.trim("speaker_role"))).alias("roles"), F.max("turn_id").alias("last_turn")
    )


SESSION_STATS = f"""WITH {TURNS} SELECT session_id, count(*) AS turns, count(content) AS with_content, count(DISTINCT lower(trim(speaker_role, ' '))) AS roles, max(turn_id) AS last_turn FROM t GROUP BY 1"""


def recent_turns(spark, d):
    return conversations.recent(_turns(spark, d), "session_id", ["turn_id"], 3).select("session_id", "turn_id", F.substring("content", 1, 100).alias("content"))


RECENT_TURNS = f"""WITH {TURNS} SELECT session_id, turn_id, substr(content, 1, 100) AS content FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) <= 3"""


def budget_suffix(spark, d):
    tokens = F.coalesce(text.token_estimate(F.col("content")), F.lit(0))
    return conversations.within_budget(_turns(spark, d), "session_id", ["turn_id"], tokens, 300).select("session_id", "turn_id", "used")


BUDGET_SUFFIX = f"""WITH {TURNS}, n AS (SELECT session_id, turn_id, coalesce(floor(h * 1.5 + (length(content) - h) / 4)::INT, 0) AS k FROM (SELECT *, len(regexp_extract_all(content, '[一-鿿]')) AS h FROM t)),
    u AS (SELECT session_id, turn_id, sum(k) OVER w AS used, row_number() OVER w AS n FROM n WINDOW w AS (PARTITION BY session_id ORDER BY turn_id DESC ROWS UNBOUNDED PRECEDING))
    SELECT session_id, turn_id, used::BIGINT AS used FROM u WHERE used <= 300 OR n = 1"""


def history_rewrite(spark, d):
    t = conversations.with_history(_turns(spark, d), "session_id", ["turn_id"], "content", 2)
    asks = conversations.refers_back(F.col("content"))
    return t.select("turn_id", F.md5("history").alias("history"), asks.alias("refers_back"))


def _history_sql() -> str:
    words = " OR ".join(f"contains(content, '{w}')" for w in conversations.REFERRING)
    return f"""WITH {TURNS} SELECT turn_id, md5(coalesce(string_agg(content, '；' ORDER BY turn_id) OVER (PARTITION BY session_id ORDER BY turn_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS history,
      coalesce(length(content) < 5 OR {words}, false) AS refers_back FROM t"""


def budget_parts(spark, d):
    """Turns as context parts by role and recency, fitted into a budget for each session."""
    role = F.lower(F.trim(F.coalesce("speaker_role", F.lit(""))))
    t = _turns(spark, d).withColumn("tokens", F.coalesce(text.token_estimate(F.col("content")), F.lit(0)))
    t = t.withColumn("rank", -F.when(role == "user", 20).when(role == "assistant", 40).otherwise(10)).withColumn("may_cut", role == "assistant")
    fitted = folds.budget_fit(t, "session_id", "rank", "turn_id", "tokens", "may_cut", 200)
    return fitted.groupBy("status").agg(F.count("*").alias("parts"), F.sum("kept_tokens").alias("tokens"))


BUDGET_PARTS = f"""WITH RECURSIVE {TURNS}, p AS (SELECT session_id, turn_id, lower(trim(coalesce(speaker_role, ''), ' ')) AS role, coalesce(floor(h * 1.5 + (length(content) - h) / 4)::INT, 0) AS k FROM (SELECT *, len(regexp_extract_all(content, '[一-鿿]')) AS h FROM t)),
    o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE role WHEN 'user' THEN -20 WHEN 'assistant' THEN -40 ELSE -10 END, turn_id) AS n FROM p),
    f AS (SELECT session_id, 0 AS n, 0 AS used, 0 AS kept, '' AS status FROM (SELECT DISTINCT session_id FROM o)
      UNION ALL SELECT session_id, n, used + g, g, st FROM (SELECT *, CASE st WHEN 'whole' THEN k WHEN 'cut' THEN 200 - used ELSE 0 END AS g FROM
        (SELECT o.session_id, o.n, o.k, f.used, CASE WHEN o.k <= 200 - f.used THEN 'whole' WHEN o.role = 'assistant' AND o.k > 0 AND 200 - f.used > 50 THEN 'cut' ELSE 'dropped' END AS st FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)))
    SELECT status, count(*) AS parts, sum(kept)::BIGINT AS tokens FROM f WHERE n > 0 GROUP BY 1"""


def answer_overlap(spark, d):
    """How much of each turn's words the turn before it already had, and how often it cites."""
    from pyspark.sql import Window as W

    t = _turns(spark, d).withColumn("words", text.eval_tokens(F.lower("content")))
    before = F.lag("words").over(W.partitionBy("session_id").orderBy("turn_id"))
    t = t.withColumn("before", before).filter("before IS NOT NULL AND words IS NOT NULL")
    return t.select("turn_id", F.round(evaluation.overlap(F.col("before"), F.col("words")), 6).alias("overlap"), evaluation.citations(F.col("content")).alias("citations"))


ANSWER_OVERLAP = f"""WITH {TURNS}, w AS (SELECT turn_id, session_id, content, regexp_extract_all(lower(content), '[a-zA-Z0-9_一-龥]+') AS words FROM t),
    b AS (SELECT *, lag(words) OVER (PARTITION BY session_id ORDER BY turn_id) AS before FROM w)
    SELECT turn_id, round(CASE WHEN len(words) = 0 THEN 0 ELSE len(list_intersect(list_distinct(words), before)) / len(list_distinct(words)) END, 6) AS overlap,
      len(regexp_extract_all(content, '\\[[0-9]+\\]'))::INT AS citations FROM b WHERE before IS NOT NULL AND words IS NOT NULL"""


def repeated_questions(spark, d):
    """Each user's question with the first earlier one much like it."""
    asked = table(spark, d, "chat_requests").filter("user_id IS NOT NULL").select("request_id", "user_id", "message")
    # A row that stands in the table twice adds nothing, as only entries with lower numbers count.
    return conversations.first_similar(asked, "user_id", "request_id", text.eval_tokens(F.lower("message")), 0.4)


REPEATED_QUESTIONS = """WITH q AS (SELECT DISTINCT request_id, user_id, list_distinct(regexp_extract_all(lower(message), '[a-zA-Z0-9_一-龥]+')) AS w FROM chat_requests WHERE user_id IS NOT NULL AND message IS NOT NULL)
    SELECT a.user_id, a.request_id, min(b.request_id) AS earlier FROM q a JOIN q b ON a.user_id = b.user_id AND b.request_id < a.request_id AND len(a.w) > 0 AND len(b.w) > 0
    WHERE len(list_intersect(a.w, b.w)) >= 0.4 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) GROUP BY 1, 2"""


def store_replace(spark, d):
    """Stored elements after the files with a table were loaded anew without it."""
    old = table(spark, d, "elements").select("element_id", "file_id", "text", "element_type").distinct()
    kind = F.lower(F.trim("element_type"))
    with_table = old.filter(kind == "table").select("file_id").distinct()
    new = old.join(with_table, "file_id", "left_semi").filter(F.coalesce(kind, F.lit("")) != "table")
    now = changes.replaced(old, new, "file_id")
    return now.groupBy("file_id").agg(F.count("*").alias("elements"), F.sum(F.length("text")).alias("chars"))


STORE_REPLACE = """WITH o AS (SELECT DISTINCT element_id, file_id, text, element_type FROM elements), w AS (SELECT DISTINCT file_id FROM o WHERE lower(trim(element_type, ' ')) = 'table'),
    n AS (SELECT o.* FROM o WHERE (file_id NOT IN (FROM w)) OR coalesce(lower(trim(element_type, ' ')), '') <> 'table')
    SELECT file_id, count(*) AS elements, sum(length(text))::BIGINT AS chars FROM n WHERE file_id NOT IN (FROM w) OR file_id IN (SELECT file_id FROM n) GROUP BY 1"""


def stale_documents(spark, d):
    """Documents past their date by source, and the mean age of the rest in days."""
    t = table(spark, d, "documents")
    now = F.lit("2026-08-31T00:00:00").cast("timestamp")
    old = retrieval.expired(F.col("valid_until"), now)
    age = (F.unix_seconds(now) - F.unix_seconds(F.col("created_at").cast("timestamp"))) / 86400
    return t.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(old).alias("expired"), F.round(F.avg(F.when(~old, age)), 4).alias("age_days"))


STALE_DOCUMENTS = """SELECT source, count(*) AS documents, count(*) FILTER (o) AS expired, round(avg(CASE WHEN NOT o THEN (epoch_us(TIMESTAMP '2026-08-31') // 1000000 - epoch_us(created_at) // 1000000) / 86400 END), 4) AS age_days
    FROM (SELECT *, coalesce(try_cast(regexp_replace(replace(valid_until, '/', '-'), '[Zz]$', '') AS TIMESTAMP) < TIMESTAMP '2026-08-31', false) AS o FROM documents) GROUP BY 1"""


def document_pages(spark, d):
    """The second page of ten documents of the largest source, newest first, with the total beside it: a paged listing."""
    t = table(spark, d, "documents").filter("source = 'ops-wiki-mirror'")
    page = t.orderBy(F.desc("created_at"), "doc_id").offset(10).limit(10).select("doc_id", "title", F.substring("text", 1, 50).alias("head"))
    return page.join(F.broadcast(t.agg(F.count("*").alias("total"))), F.lit(True))


DOCUMENT_PAGES = """SELECT doc_id, title, substr(text, 1, 50) AS head, (SELECT count(*) FROM documents WHERE source = 'ops-wiki-mirror') AS total
    FROM documents WHERE source = 'ops-wiki-mirror' ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 10 OFFSET 10"""


def merged_results(spark, d):
    """Requests and turns of one user base merged, the first kept of each user's texts that begin with the same 100 characters.

    The key is a prefix, as in the SQL: different long texts of a user with a common beginning count as one. The reference's key
    (SET-1) has doc_id as well, which these tables lack.
    """
    a = table(spark, d, "chat_requests").select("user_id", F.col("message").alias("text"), F.lit(0).alias("side"), F.col("request_id").alias("id"))
    b = table(spark, d, "turns").select("user_id", F.col("content").alias("text"), F.lit(1).alias("side"), F.col("turn_id").alias("id"))
    rows = a.unionByName(b).filter("text IS NOT NULL AND user_id IS NOT NULL")
    kept = changes.first_of(rows, ["user_id", F.substring("text", 1, 100)], [F.col("side"), F.col("id")])
    return kept.groupBy("side").agg(F.count("*").alias("kept"), F.sum("id").alias("ids"))


MERGED_RESULTS = """WITH r AS (SELECT user_id, message AS text, 0 AS side, request_id AS id FROM chat_requests UNION ALL SELECT user_id, content, 1, turn_id FROM turns),
    k AS (SELECT * FROM r WHERE text IS NOT NULL AND user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, substr(text, 1, 100) ORDER BY side, id) = 1)
    SELECT side, count(*) AS kept, sum(id)::BIGINT AS ids FROM k GROUP BY 1"""

QUERIES = {
    "session_stats": session_stats, "recent_turns": recent_turns, "budget_suffix": budget_suffix, "history_rewrite": history_rewrite, "budget_parts": budget_parts,
    "answer_overlap": answer_overlap, "repeated_questions": repeated_questions, "store_replace": store_replace, "stale_documents": stale_documents,
    "document_pages": document_pages, "merged_results": merged_results,
}
SQL = {
    "budget_parts": BUDGET_PARTS, "session_stats": SESSION_STATS, "recent_turns": RECENT_TURNS, "budget_suffix": BUDGET_SUFFIX, "history_rewrite": _history_sql(), "answer_overlap": ANSWER_OVERLAP,
    "repeated_questions": REPEATED_QUESTIONS, "store_replace": STORE_REPLACE, "stale_documents": STALE_DOCUMENTS, "document_pages": DOCUMENT_PAGES, "merged_results": MERGED_RESULTS,
}
