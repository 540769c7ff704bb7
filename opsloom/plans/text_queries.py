"""Queries of the text, governance, filter, source and chunking operators, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import governance, text
from opsloom.operators import changes, chunking, filters
from opsloom.sources import documents as docs
from opsloom.sources.tables import spread, table


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", *(columns or ("text",))))


def tokenizers(spark, d):
    t = _docs(spark, d)
    return t.select(
        "doc_id",
        F.coalesce(F.size(text.word_tokens(F.col("text"))), F.lit(0)).alias("words"),
        F.coalesce(F.size(F.array_distinct(text.eval_tokens(F.col("text")))), F.lit(0)).alias("eval_tokens"),
        F.coalesce(F.size(text.tfidf_tokens(F.col("text"))), F.lit(0)).alias("tfidf_tokens"),
    )


HAN = "[一-鿿]"
TOKENIZERS = f"""
    SELECT doc_id, coalesce(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), 0)::INT AS words,
      coalesce(len(list_distinct(regexp_extract_all(text, '[a-zA-Z0-9_一-龥]+'))), 0)::INT AS eval_tokens,
      coalesce(len(regexp_extract_all(lower(text), '[a-z]+')) + len(regexp_extract_all(text, '{HAN}'))
        + greatest(len(regexp_extract_all(text, '{HAN}')) - 1, 0), 0)::INT AS tfidf_tokens
    FROM documents"""


def clean_markdown(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(text.clean_markdown(F.col("text"))).alias("cleaned"))


def _clean_sql() -> str:
    out = "text"
    for pattern, by in text.MARKDOWN_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"SELECT doc_id, md5({out}) AS cleaned FROM documents"


def clean_headings(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_heading(F.col("title")).alias("heading"))


CLEAN_HEADINGS = r"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title,
      '\[¶\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g'), '[：:]+$', '') AS heading
    FROM documents"""


def page_text(spark, d):
    t = _docs(spark, d)
    clean = text.clean_page_text(F.col("text"))
    return t.select("doc_id", F.size(text.paragraphs(clean)).alias("paragraphs"), text.language(F.col("text")).alias("language"))


PAGE_TEXT = r"""WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
    p AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\n\s*\n')) AS p FROM c), q AS (SELECT doc_id, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM p),
    s AS (SELECT doc_id, unnest(CASE WHEN length(p) > 1000 THEN regexp_extract_all(p, '[^。！？；]*[。！？；]|[^。！？；]+$') ELSE [p] END) AS x FROM q), n AS (SELECT doc_id, count(*)::INT AS k FROM s WHERE regexp_replace(x, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1)
    SELECT c.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(k, 0) ELSE NULL END AS paragraphs, CASE WHEN zh > en THEN 'zh' WHEN en > zh THEN 'en' WHEN text IS NOT NULL THEN 'mixed' END AS language
    FROM (SELECT *, len(regexp_extract_all(text, '[一-鿿]')) AS zh, len(regexp_extract_all(text, '[a-zA-Z]')) AS en FROM c) c LEFT JOIN n ON n.doc_id = c.doc_id"""


def language_counts(spark, d):
    t = table(spark, d, "documents").select(text.language(F.col("text")).alias("detected"), F.lower("lang").alias("stated"))
    return t.groupBy("detected", "stated").agg(F.count("*").alias("documents"))


LANGUAGE_COUNTS = f"""
    SELECT CASE WHEN zh > en THEN 'zh' WHEN en > zh THEN 'en' WHEN zh IS NOT NULL THEN 'mixed' END AS detected, stated, count(*) AS documents
    FROM (SELECT len(regexp_extract_all(text, '{HAN}')) AS zh, len(regexp_extract_all(text, '[a-zA-Z]')) AS en, lower(lang) AS stated FROM documents)
    GROUP BY ALL"""


def token_estimates(spark, d):
    return _docs(spark, d).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


TOKEN_ESTIMATES = f"""
    SELECT doc_id, floor(h * 1.5 + (length(text) - h) / 4)::INT AS tokens
    FROM (SELECT doc_id, text, len(regexp_extract_all(text, '{HAN}')) AS h FROM documents)"""


def markdown_scores(spark, d):
    s = text.markdown_score(F.col("text"))
    return _docs(spark, d).select("doc_id", s.alias("score"), F.coalesce(s >= 3, F.lit(False)).alias("is_markdown"))


MARKDOWN_SCORES = r"""
    WITH lines AS (SELECT doc_id, list_transform(string_split(text, chr(10))[1:50], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM documents),
    scored AS (SELECT doc_id, list_sum(list_transform(l, lambda x:
        (CASE WHEN regexp_matches(x, '^#{1,6}\s+') THEN 2 ELSE 0 END) + (CASE WHEN starts_with(x, '```') THEN 2 ELSE 0 END)
        + (CASE WHEN regexp_matches(x, '\[.*?\]\(.*?\)') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(x, '^[-*+]\s+') THEN 1 ELSE 0 END)
        + (CASE WHEN starts_with(x, '>') THEN 1 ELSE 0 END)))::INT AS score FROM lines)
    SELECT doc_id, score, coalesce(score >= 3, false) AS is_markdown FROM scored"""


def content_ids(spark, d):
    return _docs(spark, d).select("doc_id", text.content_id(F.col("text")).alias("content_id"), F.sha2(F.col("text"), 256).alias("cache_key"))


CONTENT_IDS = "SELECT doc_id, substr(md5(text), 1, 16) AS content_id, sha256(text) AS cache_key FROM documents"


def sliding_chunks(spark, d):
    c = _docs(spark, d).filter("text IS NOT NULL").select("doc_id", text.sliding_chunks(F.col("text")).alias("c"))
    return c.select("doc_id", F.posexplode("c").alias("chunk_no", "chunk")).select("doc_id", "chunk_no", F.md5("chunk").alias("chunk"))


SLIDING_CHUNKS = """
    WITH a AS (SELECT doc_id, text, length(text) AS n, (length(text) - 400 + 299) // 300 + 1 AS c FROM documents WHERE text IS NOT NULL),
    b AS (SELECT *, CASE WHEN n <= 400 THEN 1 WHEN c > 8 THEN greatest(1, (n - 400 + 6) // 7) ELSE 300 END AS s FROM a),
    e AS (SELECT doc_id, text, n, s, unnest(range(0, CASE WHEN n <= 400 THEN 1 ELSE (n - 400 + s - 1) // s + 1 END)) AS k FROM b)
    SELECT doc_id, k::INT AS chunk_no, md5(CASE WHEN n <= 400 THEN text ELSE substr(text, (k * s + 1)::BIGINT, 400) END) AS chunk FROM e"""


def pii_rules(spark, d):
    t = table(spark, d, "turns").select("turn_id", F.col("content").alias("text"))
    masked = governance.mask(F.col("text"))
    return t.select(
        "turn_id", F.md5(masked).alias("masked"), governance.has_sensitive(F.col("text")).alias("sensitive"),
        F.md5(governance.mask_outside_code(F.col("text"))).alias("outside_code"),
    ).distinct()


def injection_risk(spark, d):
    asked = spread(table(spark, d, "chat_requests").select(F.col("message").alias("text")))
    turns = spread(table(spark, d, "turns").select(F.col("content").alias("text")))
    risk = asked.unionByName(turns).select(governance.injection_risk(F.col("text")).alias("risk"))
    return risk.groupBy("risk").agg(F.count("*").alias("texts"))


def _risk_sql() -> str:
    cases = " ".join(
        f"WHEN regexp_matches(t, '{p}') THEN '{level}'" for level, ps in governance.INJECTION_RULES.items() for p in ps
    )
    return f"""
    SELECT CASE {cases} ELSE 'none' END AS risk, count(*) AS texts
    FROM (SELECT coalesce(message, '') AS t FROM chat_requests UNION ALL SELECT coalesce(content, '') FROM turns) GROUP BY 1"""


def filter_language(spark, d):
    rule = {"$and": [{"$or": [{"lang": "zh"}, {"doc_type": "sop"}]}, {"$or_empty": {"service": "payment-service"}}]}
    return table(spark, d, "documents").filter(filters.compiled(rule)).select("doc_id", "lang", "doc_type", "service")


FILTER_LANGUAGE = """
    SELECT doc_id, lang, doc_type, service FROM documents
    WHERE (lang = 'zh' OR doc_type = 'sop') AND coalesce(service, '') IN ('', 'payment-service')"""


def visible_documents(spark, d):
    t = table(spark, d, "documents")
    t = t.withColumn("user_id", F.lit(None).cast("string")).withColumn("shared", F.when(F.col("doc_type") == "faq", "true"))
    org = "org-1"
    return t.filter(filters.compiled(filters.visible(org=org, user="u1"))).groupBy("org_id").agg(F.count("*").alias("documents"))


VISIBLE_DOCUMENTS = """
    SELECT org_id, count(*) AS documents FROM documents WHERE doc_type = 'faq' OR coalesce(org_id, '') IN ('', 'org-1') GROUP BY 1"""


def infer_metadata(spark, d):
    t = table(spark, d, "documents")
    kind = docs.inferred_type(F.col("title"), F.col("text"))
    service = docs.inferred_service(F.col("title"), F.col("text"))
    source = F.when(kind.isNotNull() | service.isNotNull(), "auto_inferred")
    return t.select("doc_id", kind.alias("inferred_type"), service.alias("inferred_service"), source.alias("inferred_source"))


def _infer_sql() -> str:
    name = " ".join(f"WHEN contains(n, '{w}') THEN '{k}'" for w, k in docs.TYPE_RULES)
    body = " ".join(f"WHEN contains(b, '{w}') THEN '{k}'" for w, k in docs.TYPE_RULES[:6])
    return f"""
    WITH t AS (SELECT doc_id, lower(coalesce(title, '')) AS n, lower(substr(coalesce(text, ''), 1, 2000)) AS b FROM documents),
    u AS (SELECT doc_id, CASE {name} {body} END AS k,
      coalesce(nullif(regexp_extract(n, '{docs.SERVICE}', 1), ''), nullif(regexp_extract(b, '{docs.SERVICE}', 1), '')) AS s FROM t)
    SELECT doc_id, k AS inferred_type, s AS inferred_service, CASE WHEN k IS NOT NULL OR s IS NOT NULL THEN 'auto_inferred' END AS inferred_source FROM u"""


def table_html(spark, d):
    t = table(spark, d, "elements").filter((F.lower(F.trim("element_type")) == "table") & F.col("text").rlike(r"^\|[^\n]*\n\|[ \-|]+\n"))
    return t.select("element_id", F.md5(docs.table_html(F.col("text"))).alias("html"), F.regexp_count("text", F.lit("\n")).alias("breaks")).distinct()


TABLE_HTML = r"""
    WITH t AS (SELECT DISTINCT element_id, text, string_split(trim(text, ' '), chr(10)) AS r FROM elements
      WHERE lower(trim(element_type)) = 'table' AND regexp_matches(text, '^\|[^\n]*\n\|[ \-|]+\n')),
    c AS (SELECT element_id, text, list_transform(r, lambda x: list_transform(string_split(regexp_replace(x, '^\s*\||\|\s*$', '', 'g'), '|'), lambda y: trim(y, ' '))) AS r FROM t)
    SELECT element_id, md5('<table><tr>' || list_aggregate(list_transform(r[1], lambda y: '<th>' || y || '</th>'), 'string_agg', '') || '</tr>'
      || coalesce(list_aggregate(list_transform(r[3:], lambda x: '<tr>' || list_aggregate(list_transform(x, lambda y: '<td>' || y || '</td>'), 'string_agg', '') || '</tr>'), 'string_agg', ''), '') || '</table>') AS html,
      (length(text) - length(replace(text, chr(10), '')))::INT AS breaks FROM c"""


def markdown_elements(spark, d):
    t = table(spark, d, "documents").select(F.concat("doc_id", F.lit(".md")).alias("name"), "text")
    parsed = docs.elements_of(t, "name", "text")
    return parsed.groupBy("element_type").agg(F.count("*").alias("elements"), F.count_distinct("path").alias("files"), F.sum(F.length("text")).alias("chars"))


def duplicate_contents(spark, d):
    """Content groups with more than one document: what a store by content id would skip."""
    t = _docs(spark, d).filter("text IS NOT NULL").withColumn("content_id", text.content_id(F.col("text")))
    return t.groupBy("content_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).filter("copies > 1")


DUPLICATE_CONTENTS = """
    SELECT substr(md5(text), 1, 16) AS content_id, count(*) AS copies, min(doc_id) AS kept FROM documents WHERE text IS NOT NULL
    GROUP BY 1 HAVING count(*) > 1"""


def incremental_diff(spark, d):
    """Stored elements against what the same files' elements would be after every table was reformatted and images dropped."""
    old = table(spark, d, "elements").select("file_id", "pos", "text", "element_type").distinct()
    kind = F.lower(F.trim("element_type"))
    new = old.filter(F.coalesce(kind, F.lit("")) != "image").withColumn("text", F.when(kind == "table", F.replace("text", F.lit(" "), F.lit(""))).otherwise(F.col("text")))
    first = lambda df: changes.first_of(df, ["file_id", "pos"], [F.col("element_type"), F.col("text")])
    return changes.diff(first(old), first(new), ["file_id", "pos"], "text").groupBy("status").agg(F.count("*").alias("elements"))


INCREMENTAL_DIFF = """
    WITH old AS (SELECT DISTINCT file_id, pos, text, element_type FROM elements),
    new AS (SELECT file_id, pos, CASE WHEN lower(trim(element_type)) = 'table' THEN replace(text, ' ', '') ELSE text END AS text, element_type
      FROM old WHERE coalesce(lower(trim(element_type)), '') <> 'image'),
    a AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY file_id, pos ORDER BY element_type NULLS FIRST, text NULLS FIRST) = 1),
    b AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY file_id, pos ORDER BY element_type NULLS FIRST, text NULLS FIRST) = 1)
    SELECT CASE WHEN a.file_id IS NULL THEN 'added' WHEN b.file_id IS NULL THEN 'deleted' WHEN coalesce(a.text, '') = coalesce(b.text, '') THEN 'unchanged' ELSE 'updated' END AS status,
      count(*) AS elements
    FROM a FULL JOIN b ON a.file_id = b.file_id AND a.pos = b.pos GROUP BY 1"""


def _chunks(cut):
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = chunking.chunked(_docs(spark, d), "doc_id", "text", cut)
        return c.select("doc_id", "chunk_no", "path", F.md5("chunk").alias("chunk"), F.length("chunk").alias("chars"))

    return query


def log_levels(spark, d):
    lines = _docs(spark, d).filter("text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.filter(docs.log_filter(F.col("line"), r'|~ "^[0-9]{4}-[0-9]{2}-[0-9]{2}T" != "INFO"'))
    return lines.groupBy(docs.log_level(F.col("line")).alias("level")).agg(F.count("*").alias("lines"), F.count_distinct("line").alias("different"))


LOG_LEVELS = """
    WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
    SELECT nullif(regexp_extract(line, '(ERROR|WARNING|WARN|INFO|DEBUG|TRACE)', 1), '') AS level, count(*) AS lines, count(DISTINCT line) AS different
    FROM l WHERE regexp_matches(line, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') AND NOT contains(line, 'INFO') GROUP BY 1"""


def label_selector(spark, d):
    from opsloom.operators import timeseries

    t = table(spark, d, "alert_deliveries")
    rule = '{service=~"(payment|order)-.*",severity!="warning",alertname!~"Disk.*"}'
    hit = t.filter(timeseries.selector(F.col("labels"), rule))
    return hit.groupBy(F.col("labels")["service"].alias("service"), F.col("labels")["alertname"].alias("alertname")).agg(F.count("*").alias("deliveries"))


LABEL_SELECTOR = """
    SELECT labels['service'] AS service, labels['alertname'] AS alertname, count(*) AS deliveries FROM alert_deliveries
    WHERE regexp_full_match(coalesce(labels['service'], ''), '(payment|order)-.*') AND coalesce(labels['severity'], '') <> 'warning'
      AND NOT regexp_full_match(coalesce(labels['alertname'], ''), 'Disk.*') GROUP BY 1, 2"""


def series_keys(spark, d):
    t = table(spark, d, "alert_deliveries").filter("labels IS NOT NULL")
    key = text.series_key(F.lit("alert.firing"), F.map_filter(F.col("labels"), lambda k, v: k.isin("service", "severity")))
    return t.groupBy(key.alias("series")).agg(F.count("*").alias("deliveries"))


SERIES_KEYS = """
    SELECT 'alert_firing{' || list_aggregate(list_sort(list_transform(list_filter(map_entries(labels), lambda e: e.key IN ('service', 'severity')),
      lambda e: CASE WHEN e.value IS NULL THEN e.key ELSE e.key || '=' || e.value END)), 'string_agg', ',') || '}' AS series, count(*) AS deliveries
    FROM alert_deliveries WHERE labels IS NOT NULL GROUP BY 1"""

QUERIES = {
    "tokenizers": tokenizers, "clean_markdown": clean_markdown, "clean_headings": clean_headings, "page_paragraphs": page_text,
    "language_counts": language_counts, "token_estimates": token_estimates, "markdown_scores": markdown_scores, "content_ids": content_ids,
    "sliding_chunks": sliding_chunks, "pii_rule_mask": pii_rules, "injection_risk": injection_risk, "filter_language": filter_language,
    "visible_documents": visible_documents, "infer_metadata": infer_metadata, "table_html": table_html, "markdown_elements": markdown_elements,
    "duplicate_contents": duplicate_contents, "incremental_diff": incremental_diff, "chunk_fixed": _chunks(chunking.fixed), "chunk_smart": _chunks(chunking.smart),
    "chunk_headings": _chunks(chunking.by_headings), "chunk_auto": _chunks(chunking.auto), "chunk_parent_child": _chunks(chunking.parent_child),
    "log_levels": log_levels, "label_selector": label_selector, "series_keys": series_keys,
}
SQL = {
    "clean_markdown": _clean_sql(), "page_paragraphs": PAGE_TEXT, "tokenizers": TOKENIZERS, "clean_headings": CLEAN_HEADINGS, "language_counts": LANGUAGE_COUNTS, "token_estimates": TOKEN_ESTIMATES,
    "markdown_scores": MARKDOWN_SCORES, "content_ids": CONTENT_IDS, "sliding_chunks": SLIDING_CHUNKS, "injection_risk": _risk_sql(),
    "filter_language": FILTER_LANGUAGE, "visible_documents": VISIBLE_DOCUMENTS, "infer_metadata": _infer_sql(), "table_html": TABLE_HTML,
    "duplicate_contents": DUPLICATE_CONTENTS, "incremental_diff": INCREMENTAL_DIFF, "log_levels": LOG_LEVELS,
    "label_selector": LABEL_SELECTOR, "series_keys": SERIES_KEYS,
}
