"""Queries of the stores, listings and migrations, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom import hooks
from opsloom.functions import text
from opsloom.operators import filters, stores
from opsloom.session import scratch_path
from opsloom.sources import documents as docs
from opsloom.sources import evalsets
from opsloom.sources.tables import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Elements as chunks: headings are the parents, everything else children."""
    e = table(spark, d, "elements").select("element_id", "file_id", "pos", "element_type", "text").distinct()
    kind = F.when(F.lower(F.btrim("element_type", F.lit(" \t"))) == "heading", "parent").otherwise("child")
    return e.select(F.concat_ws("_", "file_id", "pos", F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16)).alias("chunk_id"), "element_id", "file_id", "pos", kind.alias("chunk_type"), "text")


CHUNKS = """c AS (SELECT DISTINCT file_id || '_' || pos || '_' || substr(md5(coalesce(text, '')), 1, 16) AS chunk_id, element_id, file_id, pos,
      CASE WHEN lower(trim(element_type, ' ' || chr(9))) = 'heading' THEN 'parent' ELSE 'child' END AS chunk_type, text FROM elements)"""


def add_routed(spark, d):
    """Chunks written to the stores of parents and children, and read back from each."""
    path = scratch_path(spark, "store")
    chunks = _chunks(spark, d)
    stores.write_routed(chunks, path)
    back = spark.read.schema(chunks.schema).parquet(path)
    parents, children = stores.routed(back)
    one = lambda df, name: df.groupBy("file_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars")).withColumn("store", F.lit(name))
    return one(parents, "parent").unionByName(one(children, "child"))


ADD_ROUTED = f"WITH {CHUNKS} SELECT file_id, chunk_type AS store, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM c GROUP BY ALL"


def add_with_dedup(spark, d):
    """What adding the chunks anew would do when tables were reformatted, images dropped and lists are new; the vectors of empty texts have no length."""
    kind = F.lower(F.btrim("element_type", F.lit(" \t")))
    e = table(spark, d, "elements").select("element_type", "text", F.concat_ws("_", "file_id", "pos").alias("id"), "file_id").distinct()
    old = e.filter(F.coalesce(kind, F.lit("")) != "list")
    new = e.filter(F.coalesce(kind, F.lit("")) != "image").withColumn("text", F.when(kind == "table", F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text")))
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    return stores.add_status(old, new, "id", "text", empty).groupBy("status").agg(F.count("*").alias("chunks"))


ADD_WITH_DEDUP = """WITH e AS (SELECT DISTINCT element_type, text, file_id || '_' || pos AS id, file_id FROM elements),
    old AS (SELECT * FROM e WHERE coalesce(lower(trim(element_type, ' ' || chr(9))), '') <> 'list' QUALIFY row_number() OVER (PARTITION BY id ORDER BY text NULLS FIRST) = 1),
    n0 AS (SELECT id, CASE WHEN lower(trim(element_type, ' ' || chr(9))) = 'table' THEN replace(text, ' ', '') ELSE text END AS text FROM e WHERE coalesce(lower(trim(element_type, ' ' || chr(9))), '') <> 'image'),
    new AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY text NULLS FIRST) = 1)
    SELECT CASE WHEN old.id IS NOT NULL AND old.text IS NOT DISTINCT FROM new.text THEN 'skipped' WHEN trim(coalesce(new.text, ''), ' ') = '' THEN 'failed' WHEN old.id IS NOT NULL THEN 'updated' ELSE 'added' END AS status, count(*) AS chunks
    FROM new LEFT JOIN old USING (id) GROUP BY 1"""


def store_deletes(spark, d):
    """The store after deletes by id, by document and by filter."""
    c = _chunks(spark, d)
    ids = c.filter("pos = 0").select("chunk_id")
    files = table(spark, d, "elements").filter("page_number >= 9").select("file_id")
    left = stores.without(stores.without(stores.without(c, ids, "chunk_id"), files, "file_id"), rule=filters.compiled({"chunk_type": "parent"}) & (F.length("text") < 12))
    return left.groupBy("file_id", "chunk_type").agg(F.count("*").alias("chunks"))


STORE_DELETES = f"""WITH {CHUNKS} SELECT file_id, chunk_type, count(*) AS chunks FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM c WHERE pos = 0 AND chunk_id IS NOT NULL)
    AND file_id NOT IN (SELECT file_id FROM elements WHERE page_number >= 9 AND file_id IS NOT NULL) AND NOT coalesce(chunk_type = 'parent' AND length(text) < 12, false) GROUP BY 1, 2"""


def store_lookups(spark, d):
    """Documents by a list of ids in its order, some of them twice and one unknown."""
    ids = spark.createDataFrame([(n, i) for n, i in enumerate([7, 3, 3, 999_999_999, 1, 5])], "pos int, doc_id bigint")
    return stores.looked_up(table(spark, d, "documents").select("doc_id", "title", "lang"), ids, "doc_id")


STORE_LOOKUPS = "SELECT pos, doc_id, title, lang FROM (VALUES (0, 7), (1, 3), (2, 3), (3, 999999999), (4, 1), (5, 5)) v(pos, doc_id) JOIN documents USING (doc_id)"


def point_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", stores.point_id(F.concat(F.lit("doc-"), "doc_id")).alias("point_id"))


def file_names(spark, d):
    """Names of files made safe, from the titles of documents with a folder, control characters and much more length."""
    t = table(spark, d, "documents").filter("title IS NOT NULL")
    long = F.concat(F.lit("/a/b\\c\x01"), F.repeat(F.regexp_replace("title", r"[/\\]", "-"), 8), F.lit(".md"))
    return t.select("doc_id", text.safe_file_name(long).alias("file_name"))


FILE_NAMES = r"""WITH t AS (SELECT doc_id, 'c' || '_' || repeat(regexp_replace(title, '[/\\]', '-', 'g'), 8) || '.md' AS n FROM documents WHERE title IS NOT NULL)
    SELECT doc_id, CASE WHEN strlen(n) <= 128 THEN n ELSE substr(n[:length(n) - 3], 1, 60) || '.md' END AS file_name FROM t"""


def upload_metadata(spark, d):
    """Each document's inferred fields under the fields it states, without empty values."""
    t = table(spark, d, "documents")
    guessed = F.map_from_arrays(F.array(F.lit("doc_type"), F.lit("service")), F.array(docs.inferred_type(F.col("title"), F.col("text")), docs.inferred_service(F.col("title"), F.col("text"))))
    stated = F.map_filter(F.map_from_arrays(F.array(F.lit("doc_type"), F.lit("service"), F.lit("valid_until")), F.array("doc_type", "service", "valid_until")), lambda k, v: F.coalesce(v, F.lit("")) != "")
    merged = text.metadata_union(guessed, stated)
    return t.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


def _upload_sql() -> str:
    name = " ".join(f"WHEN contains(n, '{w}') THEN '{k}'" for w, k in docs.TYPE_RULES)
    body = " ".join(f"WHEN contains(b, '{w}') THEN '{k}'" for w, k in docs.TYPE_RULES[:6])
    return f"""WITH t AS (SELECT *, lower(coalesce(title, '')) AS n, lower(substr(coalesce(text, ''), 1, 2000)) AS b FROM documents),
    u AS (SELECT doc_id, coalesce(nullif(doc_type, ''), CASE {name} {body} END) AS k, coalesce(nullif(service, ''), nullif(regexp_extract(n, '{docs.SERVICE}', 1), ''), nullif(regexp_extract(b, '{docs.SERVICE}', 1), '')) AS s, nullif(valid_until, '') AS v FROM t)
    SELECT doc_id, concat_ws(';', 'doc_type=' || nullif(k, '[]'), 'service=' || nullif(s, '[]'), 'valid_until=' || nullif(v, '[]')) AS metadata FROM u"""


def duplicate_uploads(spark, d):
    """Documents whose text the same organisation had stored before: the check before an upload."""
    r = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.coalesce("org_id", F.lit("")).alias("owner"), F.md5("text").alias("digest"))
    first = r.groupBy("owner", "digest").agg(F.min("doc_id").alias("first"))
    return r.join(first, ["owner", "digest"]).filter("doc_id > first").select("doc_id", "owner", "first")


DUPLICATE_UPLOADS = """SELECT doc_id, coalesce(org_id, '') AS owner, min(doc_id) OVER (PARTITION BY coalesce(org_id, ''), md5(text)) AS first FROM documents WHERE text IS NOT NULL QUALIFY doc_id > first"""


def document_stats(spark, d):
    return stores.stats(_chunks(spark, d), "file_id", "chunk_type", "text")


DOCUMENT_STATS = f"WITH {CHUNKS} SELECT file_id, count(*) FILTER (chunk_type = 'parent') AS parents, count(*) FILTER (chunk_type <> 'parent') AS children, sum(length(text))::BIGINT AS chars FROM c GROUP BY 1"


def visible_children(spark, d):
    """Children that a caller of an organisation may see, of one kind of source, and how many there are for each."""
    t = table(spark, d, "documents").withColumn("chunk_type", F.when(F.col("lang") == "de", "parent").otherwise("child"))
    t = t.withColumn("user_id", F.when(F.col("lang") == "en", "u1").when(F.col("lang") == "zh", "u2")).withColumn("shared", F.when(F.col("doc_type") == "faq", "true"))
    rule = filters.child(org="org-1", user="u1")
    return t.filter(filters.compiled(rule)).groupBy("org_id", "user_id", "shared").agg(F.count("*").alias("documents"))


VISIBLE_CHILDREN = """WITH t AS (SELECT org_id, CASE lang WHEN 'en' THEN 'u1' WHEN 'zh' THEN 'u2' END AS user_id, CASE WHEN doc_type = 'faq' THEN 'true' END AS shared FROM documents WHERE coalesce(lang <> 'de', true))
    SELECT org_id, user_id, shared, count(*) AS documents FROM t WHERE coalesce(shared, '') = 'true' OR (coalesce(org_id, '') IN ('', 'org-1') AND coalesce(user_id, '') IN ('', 'u1')) GROUP BY ALL"""


def business_fields(spark, d):
    """Known fields out of front matter, here made from each document's columns."""
    t = table(spark, d, "documents").filter("title IS NOT NULL")
    head = F.concat(F.lit("---\ndoc_type: "), F.coalesce("doc_type", F.lit("")), F.lit("\nservice: "), F.coalesce("service", F.lit("")), F.lit("\nauthor: someone\nvalid_until: "), F.coalesce("valid_until", F.lit("")), F.lit("\n---\nbody"))
    fields = docs.business_fields(docs.front_matter(head))
    return t.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("fields"))


BUSINESS_FIELDS = r"""SELECT doc_id, concat_ws(';', 'doc_type=' || nullif(trim(doc_type, ' '), ''), 'service=' || nullif(trim(service, ' '), ''), 'valid_until=' || nullif(trim(valid_until, ' '), '')) AS fields FROM documents WHERE title IS NOT NULL"""


def migrated_items(spark, d):
    """Orders with their lines, and customers without orders, as one list of items: a migration of two sources."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    points = o.groupBy("o_orderkey").agg(F.count("*").alias("points"), F.round(F.sum("l_quantity"), 2).alias("weight")).select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), "points", "weight")
    c = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    rest = c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.lit(0).cast("bigint").alias("points"), F.round("c_acctbal", 2).alias("weight"))
    return points.unionByName(rest)


MIGRATED_ITEMS = """SELECT 'order' AS kind, l_orderkey AS id, count(*) AS points, round(sum(l_quantity), 2) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 2
    UNION ALL SELECT 'customer', c_custkey, 0, round(c_acctbal, 2) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""


def review_marks(spark, d):
    """Documents of services that had many resolved alerts, marked for review."""
    bad = table(spark, d, "alert_deliveries").filter("lower(trim(status)) = 'resolved'").groupBy(F.col("labels")["service"].alias("service")).agg(F.count("*").alias("n")).filter("n > 5 AND service IS NOT NULL")
    t = table(spark, d, "documents").select("doc_id", "service").join(bad.select("service", F.lit(True).alias("__bad")), "service", "left")
    return t.select("doc_id", F.coalesce("__bad", F.lit(False)).alias("needs_review"))


REVIEW_MARKS = """WITH b AS (SELECT labels['service'] AS service FROM alert_deliveries WHERE lower(trim(status, ' ')) = 'resolved' AND labels['service'] IS NOT NULL GROUP BY 1 HAVING count(*) > 5)
    SELECT doc_id, service IS NOT NULL AND service IN (FROM b) AS needs_review FROM documents"""


def satisfaction(spark, d):
    """Positive answers as a share of all by user: here requests that used web search."""
    t = table(spark, d, "chat_requests").filter("user_id IS NOT NULL")
    return t.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if("use_web_search").alias("positive"), F.round(F.avg(F.coalesce("use_web_search", F.lit(False)).cast("int")), 4).alias("satisfaction"))


SATISFACTION = "SELECT user_id, count(*) AS total, count(*) FILTER (use_web_search) AS positive, round(avg(coalesce(use_web_search, false)::INT), 4) AS satisfaction FROM chat_requests WHERE user_id IS NOT NULL GROUP BY 1"


def escaped_search(spark, d):
    """Documents whose title holds a user's pattern with special characters, taken literally."""
    words = ["(", "INC-", "a.b", "[x]", "+"]
    t = table(spark, d, "documents").select("doc_id", "title", F.explode(F.array(*map(F.lit, words))).alias("word"))
    return t.filter(F.expr("title rlike concat('\\\\Q', word, '\\\\E')")).groupBy("word").agg(F.count("*").alias("documents"))


ESCAPED_SEARCH = "SELECT word, count(*) AS documents FROM documents, (VALUES ('('), ('INC-'), ('a.b'), ('[x]'), ('+')) v(word) WHERE contains(title, word) GROUP BY 1"


def listing(spark, d):
    """The newest twenty documents of an organisation or of none, by optional kind: a listing."""
    t = table(spark, d, "documents").filter(filters.compiled({"$or_empty": {"org_id": "org-1"}}))
    return t.orderBy(F.col("created_at").desc_nulls_last(), "doc_id").limit(20).select("doc_id", "title", "org_id", F.substring("text", 1, 200).alias("head"))


LISTING = "SELECT doc_id, title, org_id, substr(text, 1, 200) AS head FROM documents WHERE coalesce(org_id, '') IN ('', 'org-1') ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 20"


def stale_by_status(spark, d):
    """Deliveries still firing long after they were received, by service: a scan for what is stuck."""
    a = table(spark, d, "alert_deliveries").filter("lower(trim(status)) IN ('firing', 'pending') AND received_at < timestamp_ntz'2026-10-01'")
    return a.groupBy(F.col("labels")["service"].alias("service")).agg(F.count("*").alias("stale"), F.min("delivery_id").alias("oldest"))


STALE_BY_STATUS = "SELECT labels['service'] AS service, count(*) AS stale, min(delivery_id) AS oldest FROM alert_deliveries WHERE lower(trim(status, ' ')) IN ('firing', 'pending') AND received_at < TIMESTAMP '2026-10-01' GROUP BY 1"


def page_furniture(spark, d):
    """Elements that repeat on many pages of their file, and page numbers: headers and footers of a layout."""
    e = table(spark, d, "elements").select("file_id", "pos", "text", "page_number").distinct().filter("text IS NOT NULL AND page_number IS NOT NULL")
    return docs.furniture(e).groupBy("reason").agg(F.count("*").alias("elements"), F.count_distinct("file_id").alias("files"))


PAGE_FURNITURE = r"""WITH e AS (SELECT DISTINCT file_id, pos, text, page_number FROM elements WHERE text IS NOT NULL AND page_number IS NOT NULL),
    t AS (SELECT file_id, count(DISTINCT page_number) AS pages FROM e GROUP BY 1), r AS (SELECT file_id, trim(text, ' ') AS t, count(*) AS n FROM e GROUP BY 1, 2),
    m AS (SELECT e.file_id, CASE WHEN regexp_full_match(trim(text, ' '), '\d+|第\s*\d+\s*页|Page\s+\d+|-\s*\d+\s*-|\d+\s*/\s*\d+|第\s*\d+\s*页\s*共\s*\d+\s*页') THEN 'page number' WHEN r.n >= greatest(2, pages // 2) THEN 'repeated' ELSE 'body' END AS reason
      FROM e JOIN t USING (file_id) JOIN r ON r.file_id = e.file_id AND r.t = trim(e.text, ' '))
    SELECT reason, count(*) AS elements, count(DISTINCT file_id) AS files FROM m GROUP BY 1"""

def page_paragraph_runs(spark, d):
    """Paragraphs of each file put together where one goes on from the element before it."""
    e = table(spark, d, "elements").select("file_id", "pos", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("page_number", F.lit(0)).alias("page")).distinct()
    e = e.groupBy("file_id", "pos").agg(F.min("text").alias("text"), F.min("page").alias("page"))
    order = W.partitionBy("file_id").orderBy("pos")
    on = docs.goes_on(F.lag("text").over(order), F.col("text"), F.lit(False)) & (F.col("page") - F.lag("page").over(order) <= 1)
    marked = e.withColumn("__f", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("__f").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("file_id", "run").agg(F.count("*").alias("blocks"), F.min("pos").alias("pos"), F.sum(F.length("text")).alias("chars")).filter("blocks > 1").drop("run")


PAGE_PARAGRAPH_RUNS = r"""WITH e AS (SELECT file_id, pos, min(coalesce(text, '')) AS text, min(coalesce(page_number, 0)) AS page FROM elements GROUP BY 1, 2),
    l AS (SELECT *, lag(text) OVER w AS bt, lag(page) OVER w AS bp FROM e WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
    m AS (SELECT *, CASE WHEN coalesce(NOT regexp_matches(rtrim(bt, ' '), '[。！？.!?：:"”）)]\z') AND trim(text, ' ') <> '' AND NOT regexp_matches(trim(text, ' '), '^(?:\d+[.)]|[一二三四五六七八九十]+[、.]|第[一二三四五六七八九十\d]+[章节部分]|[A-Z]|[•·▪]|[-*+]\s)') AND page - bp <= 1, false) THEN 0 ELSE 1 END AS f FROM l),
    r AS (SELECT *, sum(f) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT file_id, count(*) AS blocks, min(pos) AS pos, sum(length(text))::BIGINT AS chars FROM r GROUP BY file_id, run HAVING count(*) > 1"""


def eval_sets(spark, d):
    """Sessions as a set of conversations in JSON, read back as questions with what was asked before."""
    t = table(spark, d, "turns").filter("session_id IS NOT NULL AND content IS NOT NULL").select("turn_id", "session_id", "content").distinct()
    words = F.slice(F.array_distinct(text.eval_tokens(F.col("content"))), 1, 2)
    listed = F.array_sort(F.collect_list(F.struct("turn_id", F.col("content").alias("query"), words.alias("expected_keywords"))))
    groups = t.groupBy(F.col("session_id").alias("group_id")).agg(listed.alias("l")).withColumn("domain", F.lit("operations"))
    path = scratch_path(spark, "evalset")
    groups.select("group_id", "domain", F.transform("l", lambda x: F.struct(x["query"].alias("query"), x["expected_keywords"].alias("expected_keywords"))).alias("turns")).write.json(path)
    return evalsets.read(spark, path, False).select("group_id", "turn", F.md5("rewritten").alias("rewritten"), F.md5("history").alias("history"), F.size("expected_keywords").alias("keywords"))


EVAL_SETS = """WITH t AS (SELECT DISTINCT turn_id, session_id, content FROM turns WHERE session_id IS NOT NULL AND content IS NOT NULL),
    n AS (SELECT *, row_number() OVER w - 1 AS turn, string_agg(content, '；') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, coalesce(string_agg(content, '；') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS h
      FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn_id, content))
    SELECT session_id AS group_id, turn::INT AS turn, md5(r) AS rewritten, md5(h) AS history, least(2, len(list_distinct(regexp_extract_all(content, '[a-zA-Z0-9_一-龥]+'))))::INT AS keywords FROM n"""


def tool_functions(spark, d):
    """What the tools of an agent say when SQL calls them."""
    hooks.register_tools(spark, d)
    return spark.sql("""SELECT 'alerts' AS tool, severity AS name, CAST(alerts AS DOUBLE) AS value FROM query_alerts('payment-service')
        UNION ALL SELECT 'metrics', CAST(day AS STRING), mean FROM query_metrics('error') UNION ALL SELECT 'titles', title, CAST(doc_id AS DOUBLE) FROM search_titles('INC-')""")


TOOL_FUNCTIONS = """SELECT 'alerts' AS tool, labels['severity'] AS name, count(*)::DOUBLE AS value FROM alert_deliveries WHERE labels['service'] = 'payment-service' GROUP BY 2
    UNION ALL SELECT 'metrics', (epoch_us(ts) // 86400000000)::VARCHAR, round(avg(value), 6) FROM events WHERE event_type = 'error' GROUP BY 2 UNION ALL SELECT 'titles', title, doc_id FROM documents WHERE contains(title, 'INC-')"""


def chat_fallback(spark, d):
    """Answers of the first of two chat models that gives one; the first fails on long questions."""
    q = table(spark, d, "eval_items").select("item_id", "query")
    models = {**hooks.CHATS, "short": lambda p: F.when(F.length(p) <= 40, F.concat(F.lit("[short] "), p))}
    answer = F.coalesce(models["short"](F.col("query")), models["mock"](F.col("query")))
    return q.select("item_id", answer.alias("answer"))


CHAT_FALLBACK = "SELECT item_id, CASE WHEN length(query) <= 40 THEN '[short] ' || query ELSE '[mock] ' || substr(query, 1, 80) END AS answer FROM eval_items"


def mojibake(spark, d):
    """Titles whose bytes were read as Latin-1, put right: the number that come back as they were, by language."""
    t = table(spark, d, "documents").filter("title IS NOT NULL")
    broken = F.decode(F.encode("title", "UTF-8"), "ISO-8859-1")
    back = t.withColumn("back", stores.repaired(broken))
    return back.groupBy("lang").agg(F.count("*").alias("titles"), F.count_if(F.col("back") == F.col("title")).alias("restored"))


MOJIBAKE = "SELECT lang, count(*) AS titles, count(*) AS restored FROM documents WHERE title IS NOT NULL GROUP BY 1"


def shared_captions(spark, d):
    """Images described once for each content, with copies sharing the words."""
    e = table(spark, d, "elements").filter("lower(trim(element_type)) = 'image'").select("element_id", "text").distinct()
    c = stores.captions(e, "text", F.concat(F.lit("an image: "), F.substring("text", 1, 20)))
    return c.select("element_id", "caption")


SHARED_CAPTIONS = "SELECT DISTINCT element_id, 'an image: ' || substr(text, 1, 20) AS caption FROM elements WHERE lower(trim(element_type, ' ')) = 'image'"


def task_list(spark, d):
    """The newest twenty requests of sessions, as a monitor lists its tasks."""
    r = table(spark, d, "chat_requests").filter("session_id IS NOT NULL").select("request_id", "session_id", "received_at").distinct()
    return r.orderBy(F.col("received_at").desc_nulls_last(), F.desc("request_id"), "session_id").limit(20).select("request_id", "session_id")


TASK_LIST = "SELECT request_id, session_id FROM (SELECT DISTINCT request_id, session_id, received_at FROM chat_requests WHERE session_id IS NOT NULL) ORDER BY received_at DESC NULLS LAST, request_id DESC, session_id LIMIT 20"

_ALL = [
    (page_paragraph_runs, PAGE_PARAGRAPH_RUNS), (eval_sets, EVAL_SETS), (tool_functions, TOOL_FUNCTIONS), (chat_fallback, CHAT_FALLBACK), (mojibake, MOJIBAKE), (shared_captions, SHARED_CAPTIONS), (task_list, TASK_LIST),
    (add_routed, ADD_ROUTED), (add_with_dedup, ADD_WITH_DEDUP), (store_deletes, STORE_DELETES), (store_lookups, STORE_LOOKUPS), (file_names, FILE_NAMES), (upload_metadata, _upload_sql()),
    (duplicate_uploads, DUPLICATE_UPLOADS), (document_stats, DOCUMENT_STATS), (visible_children, VISIBLE_CHILDREN), (business_fields, BUSINESS_FIELDS), (migrated_items, MIGRATED_ITEMS),
    (review_marks, REVIEW_MARKS), (satisfaction, SATISFACTION), (escaped_search, ESCAPED_SEARCH), (listing, LISTING), (stale_by_status, STALE_BY_STATUS), (page_furniture, PAGE_FURNITURE),
    (point_ids, None),
]
QUERIES = {query.__name__: query for query, _ in _ALL}
SQL = {query.__name__: sql for query, sql in _ALL if sql}
