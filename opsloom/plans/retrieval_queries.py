"""Queries of the retrieval, fusion and evaluation operators, with the SQL each is compared with.

What is searched are windows of documents, so that a long document is found by its parts; they roll up to their document
as parent. The windows with their term weights and vectors are written once for each state of the documents and shared
by all queries of a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.functions import parsing, rewriting, text
from opsloom.operators import changes, conversations, evaluation, retrieval
from opsloom.session import stage_table, still_staged
from opsloom.sources.tables import spread, state_of, table

NOW = "2026-08-31T00:00:00"
TOKEN = "[a-zA-Z0-9_一-龥]+"
# A document takes part if it holds a letter or a digit.
WORDY = r"[\p{L}\p{N}]"
#: Windows of one document at most; a window's id is its document's times this and its number.
WINDOWS = 1 << 20
#: Hits of each route, hits of each variant of a query, and parents that are shown.
CHILDREN, PER_VARIANT, PARENTS = 15, 45, 5


def _tokens(c: str):
    return text.eval_tokens(F.lower(c))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "source", "valid_until")).filter(F.col("text").rlike(WORDY))


def _queries(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "query", "expected_keywords")


_built: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def index(spark, d) -> tuple[DataFrame, DataFrame]:
    """(windows, terms): windows (doc_id, parent_id, terms, v) with the number of the window as doc_id; terms (term, df, idf)."""
    key = (spark.sparkContext.applicationId, *state_of(spark, d, "documents"))
    if key not in _built or not all(map(still_staged, _built[key])):
        cut = F.posexplode(text.sliding_chunks(F.col("text"), most=None)).alias("no", "chunk")
        windows = _corpus(spark, d).select("doc_id", cut).select((F.col("doc_id") * WINDOWS + F.col("no")).alias("doc_id"), "chunk")
        counts = windows.select("doc_id", "chunk", F.sort_array(_tokens("chunk")).alias("tokens")).filter("size(tokens) > 0")
        counts = counts.select("doc_id", F.size("tokens").alias("size"), retrieval.counted(F.col("tokens")).alias("counts"), rewriting.EMBEDDERS["hashing"](F.col("chunk")).alias("v"))
        counts = stage_table(counts, "windows")
        frequency = counts.select(F.explode(F.transform("counts", lambda c: c["term"])).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        terms = stage_table(retrieval.idf(frequency, counts.count()), "terms")
        weighted = retrieval.weighted_rows(counts.drop("v"), terms, "doc_id").join(counts.select("doc_id", "v"), "doc_id")
        _built[key] = stage_table(weighted.withColumn("parent_id", F.floor(F.col("doc_id") / WINDOWS).cast("bigint")), "index"), terms
    return _built[key]


def _variants(spark, d) -> DataFrame:
    """(query_id, variant, query): each question as it is and rewritten."""
    return _queries(spark, d).select("query_id", F.posexplode(rewriting.enhanced(F.col("query"))).alias("variant", "query"))


def _asked(spark, d, terms: DataFrame) -> DataFrame:
    variants = _variants(spark, d).select("query_id", "variant", F.sort_array(_tokens("query")).alias("tokens"))
    counts = variants.select("query_id", "variant", F.size("tokens").alias("size"), F.inline(retrieval.counted(F.col("tokens"))))
    return retrieval.weights(counts, terms, ["query_id", "variant"])


def _sparse(spark, d, k: int = CHILDREN) -> DataFrame:
    """The k windows of each question by term weights: of each variant the best, of these each at its best score."""
    windows, terms = index(spark, d)
    each = retrieval.sparse_top(_asked(spark, d, terms), windows, PER_VARIANT, ["query_id", "variant"])
    return retrieval.top(each.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k, ["query_id"])


def _dense(spark, d, k: int = CHILDREN) -> DataFrame:
    vectors = _queries(spark, d).select("query_id", rewriting.EMBEDDERS["hashing"](F.col("query")).alias("q"))
    return retrieval.dense_top(vectors, index(spark, d)[0].select("doc_id", "v"), k)


def _hits(spark, d) -> DataFrame:
    """(route, query_id, doc_id, score, rank): the best windows of each question by term weights (1) and by vectors (2)."""
    columns = ["query_id", "doc_id", "score", "rank"]
    return _sparse(spark, d).select(F.lit(1).alias("route"), *columns).unionByName(_dense(spark, d).select(F.lit(2).alias("route"), *columns))


def _route(spark, d, number: int = 1) -> DataFrame:
    return _sparse(spark, d) if number == 1 else _dense(spark, d)


def _fused(hits: DataFrame, how: str = "rrf", second: float = 1.0, first: float = 1.0, k: int = 60) -> DataFrame:
    weight = F.when(F.col("route") == 1, first).otherwise(second)
    return retrieval.fused_hits(hits.withColumn("weight", weight), how, k)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _holds(t: str, low: str = "low") -> str:
    return f"regexp_matches({low}, '(^|[^a-z0-9_]){t}($|[^a-z0-9_])')" if t.isascii() else f"contains({low}, '{t}')"


_CLOSED = parsing.closed(rewriting.SYNONYMS)
_EXPANDED = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {_holds(t)} AND NOT {_holds(s)} THEN '{s}' END" for t in sorted(_CLOSED) for s in sorted(_CLOSED[t])) + "], lambda x: x IS NOT NULL)))"
_TABLE = "MAP {" + ", ".join(f"'{t}': {_list(sorted(s))}" for t, s in sorted(_CLOSED.items())) + "}"
_CUTS = ", ".join(f"CASE WHEN ends_with(query, '{s}') AND length(query) > {len(s)} THEN trim(query[:length(query) - {len(s)}], ' ') END" for s in rewriting.SUFFIXES)
# The first of each variant, in order.
VARIANTS = rf"""
    q0 AS (SELECT item_id AS query_id, query, lower(trim(query, ' ')) AS low, regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+') AS t FROM eval_items),
    q1 AS (SELECT *, {_EXPANDED} AS more, list_filter(t, lambda x: NOT list_contains({_list(rewriting.STOP_WORDS)}, x)) AS w FROM q0),
    qz AS (SELECT *, flatten(list_transform(w, lambda y: [y] || coalesce({_TABLE}[y], []))) AS z FROM q1),
    q2 AS (SELECT query_id, query, unnest([trim(query, ' '), {_CUTS}, CASE WHEN len(t) >= 2 AND len(w) > 0 AND len(w) < len(t) THEN array_to_string(w, ' ') END,
      CASE WHEN len(more) > 0 THEN low || ' ' || array_to_string(more, ' ') END, array_to_string(list_filter(z, lambda x, i: list_position(z, x) = i), ' ')]) AS v,
      unnest(range({len(rewriting.SUFFIXES) + 4})) AS pos FROM qz),
    q3 AS (SELECT query_id, v AS query, min(pos) AS pos FROM q2 WHERE v IS NOT NULL AND v <> '' GROUP BY 1, 2),
    variants AS (SELECT query_id, query, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS variant FROM q3)"""
ROUTES = rf"""{VARIANTS},
    cut AS (SELECT doc_id AS parent_id, text, unnest(range(0, CASE WHEN length(text) <= 400 THEN 1 ELSE (length(text) - 400 + 299) // 300 + 1 END)) AS no FROM documents WHERE regexp_matches(text, '{WORDY}')),
    corpus AS (SELECT parent_id * {WINDOWS} + no AS doc_id, parent_id, substr(text, (no * 300 + 1)::BIGINT, 400) AS text FROM cut),
    dt AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS l FROM corpus),
    dc AS (SELECT doc_id, t AS term, len(any_value(l)) AS size, count(*) AS n FROM (SELECT doc_id, l, unnest(l) AS t FROM dt) GROUP BY 1, 2),
    idf AS (SELECT term, count(*) AS df, ln(((SELECT count(DISTINCT doc_id) FROM dc) + 1) / (count(*) + 1)) + 1 AS idf FROM dc GROUP BY 1),
    dw0 AS (SELECT doc_id, term, n::DOUBLE / size * idf AS w FROM dc JOIN idf USING (term)),
    dw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM dw0),
    qc AS (SELECT query_id, variant, t AS term, len(any_value(l)) AS size, count(*) AS n FROM (SELECT query_id, variant, l, unnest(l) AS t FROM
      (SELECT query_id, variant, regexp_extract_all(lower(query), '{TOKEN}') AS l FROM variants)) GROUP BY 1, 2, 3),
    qw0 AS (SELECT query_id, variant, term, n::DOUBLE / size * idf AS w FROM qc JOIN idf USING (term)),
    qw AS (SELECT query_id, variant, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id, variant)) AS w FROM qw0),
    each AS (SELECT query_id, variant, doc_id, round(sum(qw.w * dw.w), 9) AS score FROM qw JOIN dw USING (term) GROUP BY 1, 2, 3
      QUALIFY row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, doc_id) <= {PER_VARIANT}),
    bucket AS (SELECT term, h % {rewriting.DIMENSIONS} AS b, 1 - 2 * (h // {rewriting.DIMENSIONS} % 2)::INT AS sign FROM
      (SELECT term, ('0x' || substr(md5(term), 1, 8))::UBIGINT AS h FROM (SELECT term FROM dc UNION SELECT term FROM q_terms))),
    dv AS (SELECT doc_id, b, sum(n * sign)::DOUBLE AS x FROM dc JOIN bucket USING (term) GROUP BY 1, 2),
    qv AS (SELECT query_id, b, sum(n * sign)::DOUBLE AS x FROM q_terms JOIN bucket USING (term) GROUP BY 1, 2),
    dn AS (SELECT doc_id, sqrt(sum(x * x)) AS len FROM dv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(x * x)) AS len FROM qv GROUP BY 1),
    dots AS (SELECT query_id, doc_id, sum(qv.x * dv.x) AS d FROM qv JOIN dv USING (b) GROUP BY 1, 2),
    near AS (SELECT query_id, doc_id, round((CASE WHEN qn.len * dn.len > 0 THEN d / (qn.len * dn.len) ELSE 0 END + 1) / 2, 9) AS score FROM dots JOIN dn USING (doc_id) JOIN qn USING (query_id)),
    hits AS (SELECT 1 AS route, query_id, doc_id, max(score) AS score FROM each GROUP BY ALL UNION ALL SELECT 2, query_id, doc_id, score FROM near),
    routes AS (SELECT *, row_number() OVER (PARTITION BY route, query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM hits QUALIFY rank < {CHILDREN})"""
ROUTES = f"""
    q_terms AS (SELECT query_id, term, count(*) AS n FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(query), '{TOKEN}')) AS term FROM eval_items) GROUP BY 1, 2), {ROUTES}"""
RRF = """rrf AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score FROM routes GROUP BY 1, 2)"""


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, "score")


def query_variants(spark, d):
    return _variants(spark, d)


def sparse_top(spark, d):
    return _shown(_route(spark, d).filter("rank < 5"), "query_id", "doc_id", "rank")


def dense_text_top(spark, d):
    return _shown(_route(spark, d, 2).filter("rank < 5"), "query_id", "doc_id", "rank")


def fusion_rrf(spark, d):
    fused = _fused(_hits(spark, d))
    return _shown(retrieval.top(fused, 5, ["query_id"]), "query_id", "doc_id", "rank")


def _fusion(how: str, weights: list[float]):
    def query(spark, d):
        routes = [_route(spark, d, n) for n in (1, 2)]
        fused = retrieval.fused(routes, how, weights)
        return _shown(retrieval.top(fused, 5, ["query_id"]), "query_id", "doc_id", "rank")

    return query


def _fusion_sql(value: str) -> str:
    return f"""WITH {ROUTES}, f AS (SELECT query_id, doc_id, round({value}, 9) AS score FROM routes GROUP BY 1, 2)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank, score FROM f QUALIFY rank < 5"""


def _filtered_parents(spark, d) -> DataFrame:
    """(query_id, parent_id, score, hits, query, valid_until): parents by votes, filtered and raised by their heading."""
    votes = retrieval.parent_votes(_fused(_hits(spark, d)).withColumn("parent_id", F.floor(F.col("doc_id") / WINDOWS).cast("bigint")))
    q = _queries(spark, d).select("query_id", "query")
    terms = F.array_distinct(F.concat(text.word_tokens(F.col("query")), parsing.expansions(F.col("query"), rewriting.SYNONYMS)))
    parents = table(spark, d, "documents").select(F.col("doc_id").alias("parent_id"), "text", "title", "valid_until")
    # Few votes meet their documents, rather than the documents moving.
    found = votes.join(q.withColumn("terms", terms), "query_id").join(parents, "parent_id")
    kept = retrieval.heading_filter(found, F.col("terms"), F.col("text"), F.col("title"))
    return kept.select("query_id", "parent_id", "score", "hits", "query", "valid_until")


def heading_filter(spark, d):
    return _shown(retrieval.top(_filtered_parents(spark, d), PARENTS, ["query_id"], tie="parent_id"), "query_id", "parent_id", "hits", "rank")


def _reranked(spark, d, k: int = PARENTS) -> DataFrame:
    """(query_id, parent_id, score, hits, valid_until): the candidates of each question by their best window."""
    ranked = retrieval.ranked(_filtered_parents(spark, d), ["query_id"], tie="parent_id")
    cut = retrieval.dynamic_cut(ranked.withColumnRenamed("parent_id", "doc_id").drop("rank"), k).withColumnRenamed("doc_id", "parent_id")
    candidates = cut.filter(F.col("rank") < max(3 * k, 18)).select("query_id", "parent_id", "hits", "query", "valid_until")
    windows = index(spark, d)[0].select("parent_id", F.transform("terms", lambda t: t["term"]).alias("held"))
    overlap = retrieval.lexical_overlap(_tokens("query"), F.col("held"))
    best = windows.join(candidates, "parent_id").groupBy("query_id", "parent_id", "hits", "valid_until").agg(F.max(overlap).alias("best"))
    return best.withColumn("score", F.round(retrieval.sigmoid(F.col("best")), 9)).drop("best")


def hybrid_parent_child(spark, d):
    """The flagship: windows by vectors of the question and by term weights of all its variants, fused by reciprocal
    ranks, rolled up to their document with votes, filtered by heading, reranked by their best window where the scores
    don't stand clear, halved if out of date, and cut."""
    now = F.lit(NOW).cast("timestamp")
    aged = _reranked(spark, d).withColumn("score", retrieval.decayed(F.col("score"), F.col("valid_until"), now))
    return _shown(retrieval.top(aged, PARENTS, ["query_id"], tie="parent_id"), "query_id", "parent_id", "hits", "rank")


def hybrid_flat(spark, d):
    """Windows by both routes, term weights first, fused and cut where the best stand clear, without parents."""
    cut = retrieval.dynamic_cut(_fused(_hits(spark, d)), PARENTS).filter(F.col("rank") < max(3 * PARENTS, 18))
    return _shown(cut.filter(F.col("rank") < PARENTS), "query_id", "doc_id", "rank")


HYBRID_FLAT = f"""WITH {ROUTES}, {RRF} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank, score FROM rrf QUALIFY rank < {PARENTS}"""
FILTERED = f"""{ROUTES}, {RRF},
    v AS (SELECT query_id, parent_id, count(*) AS hits, round(max(score) + 0.1::DOUBLE * (count(*) - 1), 9) AS score FROM rrf JOIN (SELECT doc_id, parent_id FROM corpus) USING (doc_id) GROUP BY 1, 2),
    qx AS (SELECT query_id, query, t || more AS terms FROM q1),
    m AS (SELECT v.*, qx.query, valid_until, len(list_filter(terms, lambda x: contains(lower(text), x))) > 0 AS c, coalesce(len(list_filter(terms, lambda x: contains(lower(title), x))) > 0, false) AS h
      FROM v JOIN qx USING (query_id) JOIN documents ON doc_id = parent_id),
    f AS (SELECT query_id, parent_id, hits, query, valid_until, round(CASE WHEN h THEN score + 0.05::DOUBLE ELSE score END, 9) AS score FROM m QUALIFY c OR h OR NOT bool_or(c OR h) OVER (PARTITION BY query_id)),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) - 1 AS rank FROM f)"""
HEADING_FILTER = f"WITH {FILTERED} SELECT query_id, parent_id, hits, rank, score FROM fr WHERE rank < {PARENTS}"
HYBRID = f"""WITH {FILTERED},
    g AS (SELECT query_id, avg(score) FILTER (rank < {PARENTS}) AS top, avg(score) FILTER (rank >= {2 * PARENTS}) AS tail FROM fr GROUP BY 1),
    cand AS (SELECT fr.* FROM fr JOIN g USING (query_id) WHERE rank < CASE WHEN coalesce(abs(top) >= 1e-6 AND abs(top - tail) / abs(top) > 0.15, false) THEN {2 * PARENTS} ELSE {max(3 * PARENTS, 18)} END),
    ct AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '{TOKEN}')) AS qt FROM cand),
    b AS (SELECT query_id, ct.parent_id, hits, valid_until, max(CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, l)) / len(qt)::DOUBLE END) AS best
      FROM ct JOIN corpus ON corpus.parent_id = ct.parent_id JOIN dt USING (doc_id) GROUP BY ALL),
    a AS (SELECT query_id, parent_id, hits, round(1 / (1 + exp(-best)), 9)
      * CASE WHEN coalesce(try_cast(regexp_replace(replace(valid_until, '/', '-'), '[Zz]$', '') AS TIMESTAMP) < TIMESTAMP '2026-08-31', false) THEN 0.5::DOUBLE ELSE 1 END AS score FROM b)
    SELECT query_id, parent_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) - 1 AS rank, score FROM a QUALIFY rank < {PARENTS}"""


def dynamic_cut(spark, d):
    cut = retrieval.dynamic_cut(_fused(_hits(spark, d)), 5)
    return cut.groupBy("query_id").agg(F.first("clear").alias("clear"), F.count("*").alias("kept"))


DYNAMIC_CUT = f"""WITH {ROUTES}, {RRF},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM rrf),
    m AS (SELECT query_id, avg(score) FILTER (rank < 5) AS h, avg(score) FILTER (rank >= 10) AS t, count(*) AS n FROM r GROUP BY 1),
    c AS (SELECT query_id, n, coalesce(abs(h) >= 1e-6 AND abs(h - t) / abs(h) > 0.15, false) AS clear FROM m)
    SELECT query_id, clear, CASE WHEN clear THEN least(n, 10) ELSE n END AS kept FROM c"""


def _window_texts(spark, d, hits: DataFrame) -> DataFrame:
    """hits (…, doc_id) with the ``text`` of their windows and ``source``; only documents that are hit are cut."""
    found = hits.withColumn("parent_id", F.floor(F.col("doc_id") / WINDOWS).cast("bigint")).withColumn("no", (F.col("doc_id") % WINDOWS).cast("int"))
    docs = _corpus(spark, d).select(F.col("doc_id").alias("parent_id"), F.col("text").alias("whole"), "source")
    part = F.when(F.length("whole") <= 400, F.col("whole")).otherwise(F.substring("whole", F.col("no") * 300 + 1, F.lit(400)))
    return found.join(docs, "parent_id").withColumn("text", part).drop("whole", "parent_id", "no")


def simple_rerank(spark, d):
    weight = F.when(F.col("source").startswith("course"), 1.0).when(F.col("source").startswith("teaching"), 0.8).otherwise(0.5)
    hits = _window_texts(spark, d, _route(spark, d).select("query_id", "doc_id", "score"))
    scored = hits.select("query_id", "doc_id", F.round(retrieval.simple_rerank_score(F.col("score"), F.col("text"), weight), 9).alias("score"))
    return _shown(retrieval.top(scored, 5, ["query_id"]), "query_id", "doc_id", "rank")


SIMPLE_RERANK = f"""WITH {ROUTES}, s AS (SELECT query_id, doc_id, round(score * 0.6::DOUBLE
      + CASE WHEN length(text) < 50 THEN 0.3 WHEN length(text) < 200 THEN 0.8 WHEN length(text) < 500 THEN 1.0 ELSE 0.7 END::DOUBLE * 0.2::DOUBLE
      + CASE WHEN starts_with(source, 'course') THEN 1.0 WHEN starts_with(source, 'teaching') THEN 0.8 ELSE 0.5 END::DOUBLE * 0.2::DOUBLE, 9) AS score
      FROM routes JOIN (SELECT corpus.*, source FROM corpus JOIN documents d ON d.doc_id = parent_id) USING (doc_id) WHERE route = 1)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank, score FROM s QUALIFY rank < 5"""


def chunk_rerank(spark, d):
    """Each hit's document by the lexical overlap of its best window with the question: a reranker with the default
    scorer. Every window is scored."""
    windows = index(spark, d)[0].select("parent_id", F.transform("terms", lambda t: t["term"]).alias("held"))
    hits = _route(spark, d).join(index(spark, d)[0].select("doc_id", "parent_id"), "doc_id").select("query_id", "parent_id").distinct()
    pairs = windows.join(hits.join(_queries(spark, d).select("query_id", "query"), "query_id"), "parent_id")
    overlap = retrieval.lexical_overlap(_tokens("query"), F.col("held"))
    best = pairs.groupBy("query_id", "parent_id").agg(F.round(F.max(overlap), 9).alias("score"), F.round(F.avg(overlap), 9).alias("mean"))
    return _shown(retrieval.top(best, 5, ["query_id"], tie="parent_id").withColumnRenamed("parent_id", "doc_id"), "query_id", "doc_id", "rank", "mean")


CHUNK_RERANK = f"""WITH {ROUTES}, h AS (SELECT DISTINCT query_id, corpus.parent_id, list_distinct(regexp_extract_all(lower(query), '{TOKEN}')) AS qt FROM routes JOIN corpus USING (doc_id) JOIN q0 USING (query_id) WHERE route = 1),
    s AS (SELECT query_id, h.parent_id, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, l)) / len(qt)::DOUBLE END AS o FROM h JOIN corpus ON corpus.parent_id = h.parent_id JOIN dt USING (doc_id) WHERE len(l) > 0),
    b AS (SELECT query_id, parent_id, round(max(o), 9) AS score, round(avg(o), 9) AS mean FROM s GROUP BY 1, 2)
    SELECT query_id, parent_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) - 1 AS rank, mean, score FROM b QUALIFY rank < 5"""


def tfidf_fit(spark, d):
    frequency = retrieval.document_frequency(_corpus(spark, d), text.tfidf_tokens(F.col("text")))
    return retrieval.idf(frequency, _corpus(spark, d).count(), 2000).select("term", "df", F.round("idf", 6).alias("idf"))


TFIDF_FIT = r"""
    WITH c AS (SELECT doc_id, text, regexp_extract_all(text, '[一-鿿]') AS h FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]')),
    t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM c UNION ALL SELECT doc_id, unnest(h) FROM c
      UNION ALL SELECT doc_id, unnest(list_transform(range(1, greatest(len(h), 1)), lambda i: h[i] || h[i + 1])) FROM c),
    f AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY 1)
    SELECT term, df, round(ln(((SELECT count(*) FROM c) + 1) / (df + 1)) + 1, 6) AS idf FROM f ORDER BY df DESC, term LIMIT 2000"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


def _vector_queries(spark, d):
    """Every vector whose id is divisible by 100, against all vectors."""
    return _vectors(spark, d).filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("want"))


def dense_top(spark, d):
    hits = retrieval.dense_top(_vector_queries(spark, d).select("query_id", "q"), _vectors(spark, d).select("doc_id", "v"), 10)
    return _shown(hits, "query_id", "doc_id", "rank")


DENSE = """
    e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, q.label AS want, e.vec_id AS doc_id, e.label,
      round((coalesce(list_cosine_similarity(q.v, e.v), 0) + 1) / 2, 9) AS score FROM e AS q, e WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM s QUALIFY rank < 10)"""
DENSE_TOP = f"WITH {DENSE} SELECT query_id, doc_id, rank, score FROM r"


def approximate_top(spark, d):
    """Nearest vectors by cells, with the measured recall against the exact search beside them."""
    q, v = _vector_queries(spark, d).select("query_id", "q"), _vectors(spark, d).select("doc_id", "v")
    # The vectors have hardly any clusters, so most cells have to be looked into.
    found = retrieval.approximate_top(q, v, 10, 16, 12)
    return retrieval.recall(found, retrieval.dense_top(q, v, 10)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


APPROXIMATE_TOP = "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0"


def source_search(spark, d):
    """Windows of one source by vectors, filtered before they are scored, with a least score."""
    windows = index(spark, d)[0].select("doc_id", "parent_id", "v")
    of = table(spark, d, "documents").filter("source = 'ops-wiki-mirror'").select(F.col("doc_id").alias("parent_id"))
    vectors = _queries(spark, d).select("query_id", rewriting.EMBEDDERS["hashing"](F.col("query")).alias("q"))
    return _shown(retrieval.dense_top(vectors, windows.join(of, "parent_id", "left_semi").select("doc_id", "v"), 5, 0.65), "query_id", "doc_id", "rank")


SOURCE_SEARCH = f"""WITH {ROUTES} SELECT query_id, doc_id, rank, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM near JOIN corpus USING (doc_id)
    WHERE parent_id IN (SELECT doc_id FROM documents WHERE source = 'ops-wiki-mirror')) WHERE rank < 5 AND score >= 0.65"""


def keyword_concat(spark, d):
    """The share of expected keywords in the first five windows of each question joined to one text."""
    hits = _window_texts(spark, d, _route(spark, d).filter("rank < 5"))
    joined = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: F.lower(h["text"])), "\n").alias("text"))
    q = _queries(spark, d).join(joined, "query_id")
    words = F.transform("expected_keywords", lambda w: F.lower(w))
    return q.select("query_id", F.round(F.size(F.filter(words, lambda w: F.contains("text", w))) / F.size(words), 6).alias("recall"))


KEYWORD_CONCAT = f"""WITH {ROUTES}, h AS (SELECT query_id, string_agg(lower(text), chr(10) ORDER BY rank) AS text FROM routes JOIN corpus USING (doc_id) WHERE route = 1 AND rank < 5 GROUP BY 1)
    SELECT query_id, round(len(list_filter(expected_keywords, lambda w: contains(text, lower(w)))) / len(expected_keywords), 6) AS recall FROM h JOIN eval_items ON item_id = query_id"""


def variants_kept(spark, d):
    """Variants whose vectors are near their question's, all if none is, and no more than four."""
    embed = rewriting.EMBEDDERS["hashing"]
    v = _variants(spark, d).withColumn("v", embed(F.col("query")))
    own = _queries(spark, d).select("query_id", embed(F.col("query")).alias("q"))
    rows = F.array_sort(F.collect_list(F.struct("variant", "query", "v")))
    g = v.join(own, "query_id").groupBy("query_id").agg(rows.alias("l"), F.any_value("q").alias("q"))
    kept = rewriting.similar_enough(F.transform("l", lambda x: x["query"]), F.transform("l", lambda x: x["v"]), F.col("q"), retrieval.cosine, 0.7, 4)
    return g.select("query_id", F.array_join(kept, "|").alias("variants"))


VARIANTS_KEPT = f"""WITH {VARIANTS}, t AS (SELECT query_id, variant, unnest(regexp_extract_all(lower(query), '{TOKEN}')) AS t FROM variants UNION ALL SELECT item_id, -1, unnest(regexp_extract_all(lower(query), '{TOKEN}')) FROM eval_items),
    h AS (SELECT query_id, variant, ('0x' || substr(md5(t), 1, 8))::UBIGINT AS h FROM t), x AS (SELECT query_id, variant, h % 128 AS b, sum(1 - 2 * (h // 128 % 2)::INT)::DOUBLE AS x FROM h GROUP BY 1, 2, 3),
    n AS (SELECT query_id, variant, sqrt(sum(x * x)) AS len FROM x GROUP BY 1, 2), dt AS (SELECT a.query_id, a.variant, sum(a.x * q.x) AS d FROM x a JOIN x q ON q.query_id = a.query_id AND q.variant = -1 AND q.b = a.b GROUP BY 1, 2),
    c AS (SELECT v.query_id, v.variant, v.query, coalesce(CASE WHEN na.len * nq.len > 0 THEN d / (na.len * nq.len) END, 0) >= 0.7::DOUBLE AS near FROM variants v LEFT JOIN dt USING (query_id, variant) LEFT JOIN n na USING (query_id, variant) LEFT JOIN n nq ON nq.query_id = v.query_id AND nq.variant = -1),
    k AS (SELECT * FROM c QUALIFY near OR NOT bool_or(near) OVER (PARTITION BY query_id)) SELECT query_id, array_to_string(list(query ORDER BY variant)[1:4], '|') AS variants FROM k GROUP BY 1"""


def label_votes(spark, d):
    hits = retrieval.dense_top(_vector_queries(spark, d).select("query_id", "q"), _vectors(spark, d).select("doc_id", "v"), 10)
    votes = retrieval.parent_votes(hits, _vectors(spark, d).select("doc_id", F.col("label").alias("parent_id")))
    return _shown(retrieval.top(votes, 3, ["query_id"], tie="parent_id"), "query_id", "parent_id", "hits", "rank")


LABEL_VOTES = f"""WITH {DENSE}, v AS (SELECT query_id, label AS parent_id, count(*) AS hits, round(max(score) + 0.1::DOUBLE * (count(*) - 1), 9) AS score FROM r GROUP BY 1, 2)
    SELECT query_id, parent_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) - 1 AS rank, score FROM v QUALIFY rank < 3"""


def recall_mrr_ndcg(spark, d):
    """Retrieval quality of the dense route, where vectors of the query's label are the relevant ones, by label and over all."""
    q = _vector_queries(spark, d)
    hits = retrieval.dense_top(q.select("query_id", "q"), _vectors(spark, d).select("doc_id", "v"), 10)
    relevant = q.select("query_id", "want").join(_vectors(spark, d).select("doc_id", F.col("label").alias("want")), "want").select("query_id", "doc_id")
    quality = evaluation.ranking_quality(hits, relevant, 5).join(q.select("query_id", "want"), "query_id")
    by = quality.rollup("want").agg(
        F.count("*").alias("queries"), *(F.round(F.avg(m), 6).alias(m) for m in ("recall", "mrr", "ndcg")), F.round(F.expr("percentile(recall, 0.5)"), 6).alias("median_recall")
    )
    return by.withColumnRenamed("want", "label")


RECALL = f"""WITH {DENSE}, n AS (SELECT label AS want, count(*) AS total FROM e GROUP BY 1),
    m AS (SELECT query_id, want, sum(CASE WHEN label = want AND rank < 5 THEN 1 ELSE 0 END) / any_value(total)::DOUBLE AS recall,
      coalesce(1.0::DOUBLE / (min(CASE WHEN label = want THEN rank END) + 1), 0) AS mrr,
      sum(CASE WHEN label = want AND rank < 5 THEN 1 / log2(rank + 2) ELSE 0 END) / (SELECT sum(1 / log2(i + 2)) FROM range(5) t(i) WHERE i < any_value(total)) AS ndcg
      FROM r JOIN n USING (want) GROUP BY 1, 2)
    SELECT want AS label, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
      round(quantile_cont(recall, 0.5), 6) AS median_recall FROM m GROUP BY ROLLUP (want)"""


def keyword_recall(spark, d):
    """The share of the expected keywords that the first five hits of each question hold, whatever their case."""
    hits = _window_texts(spark, d, _route(spark, d).filter("rank < 5")).withColumn("text", F.lower("text"))
    words = _queries(spark, d).select("query_id", F.explode(F.array_distinct(F.transform("expected_keywords", F.lower))).alias("keyword"))
    found = words.join(hits.select("query_id", "text", "rank"), "query_id", "left")
    first = found.groupBy("query_id", "keyword").agg(F.min(F.when(F.contains("text", F.col("keyword")), F.col("rank"))).alias("rank"))
    return first.groupBy("query_id").agg(
        F.round(F.avg(F.when(F.col("rank").isNull(), 0.0).otherwise(1.0)), 6).alias("recall"),
        F.round(F.coalesce(1.0 / (F.min("rank") + 1), F.lit(0.0)), 6).alias("mrr"),
    )


KEYWORD_RECALL = f"""WITH {ROUTES},
    w AS (SELECT item_id AS query_id, unnest(list_distinct(list_transform(expected_keywords, lambda x: lower(x)))) AS keyword FROM eval_items),
    h AS (SELECT query_id, rank, lower(text) AS text FROM routes JOIN corpus USING (doc_id) WHERE route = 1 AND rank < 5),
    f AS (SELECT w.query_id, keyword, min(CASE WHEN contains(text, keyword) THEN rank END) AS rank FROM w LEFT JOIN h USING (query_id) GROUP BY 1, 2)
    SELECT query_id, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 6) AS recall, round(coalesce(1.0::DOUBLE / (min(rank) + 1), 0), 6) AS mrr FROM f GROUP BY 1"""


#: Keywords of all questions up to which they are sent to every task.
MOST_KEYWORDS = 100_000


def keyword_truth(spark, d):
    """Documents that hold any of a question's keywords, as they are: its ground truth by text.

    The keywords of all questions are one list, so each document is looked through once for each distinct keyword; more
    than ``MOST_KEYWORDS`` are refused.
    """
    words = table(spark, d, "eval_items").select("item_id", F.explode(F.array_distinct("expected_keywords")).alias("keyword"))
    distinct = words.select("keyword").distinct()
    if distinct.limit(MOST_KEYWORDS + 1).count() > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords")
    held = _corpus(spark, d).join(F.broadcast(distinct.agg(F.collect_set("keyword").alias("all"))), F.lit(True)).select(
        "doc_id", F.explode(F.filter("all", lambda k: F.contains(F.col("text"), k))).alias("keyword")
    )
    found = held.join(words, "keyword").groupBy("item_id", "doc_id").agg(F.count("*").alias("keywords"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"), F.max("keywords").alias("most_keywords"))


KEYWORD_TRUTH = r"""
    WITH w AS (SELECT item_id, unnest(list_distinct(expected_keywords)) AS keyword FROM eval_items), k AS (SELECT DISTINCT keyword FROM w),
    h AS (SELECT doc_id, keyword FROM documents, k WHERE regexp_matches(text, '[\p{L}\p{N}]') AND contains(text, keyword)),
    f AS (SELECT item_id, doc_id, count(*) AS n FROM h JOIN w USING (keyword) GROUP BY 1, 2)
    SELECT item_id, count(*) AS documents, min(doc_id) AS first_doc, max(n) AS most_keywords FROM f GROUP BY 1"""


def context_precision(spark, d):
    q = _vector_queries(spark, d)
    hits = retrieval.dense_top(q.select("query_id", "q"), _vectors(spark, d).select("doc_id", "v"), 10)
    judged = hits.join(_vectors(spark, d).select("doc_id", "label"), "doc_id").join(q.select("query_id", "want"), "query_id")
    return evaluation.context_precision(judged.withColumn("useful", F.col("label") == F.col("want")))


CONTEXT_PRECISION = f"""WITH {DENSE} SELECT query_id, round(sum(CASE WHEN label = want THEN 1.0::DOUBLE / (rank + 1) ELSE 0 END) / sum(1.0::DOUBLE / (rank + 1)), 6) AS context_precision FROM r GROUP BY 1"""


def fusion_grid(spark, d):
    """How much of a question's reciprocal-rank fusion stays among the first five over a grid of constants and weights."""
    hits = stage_table(_hits(spark, d), "hits")
    base = retrieval.top(_fused(hits), 5, ["query_id"]).select("query_id", "doc_id")
    out = None
    for k in (10, 60, 200):
        for weight in (0.5, 2.0):
            best = retrieval.top(_fused(hits, "rrf", weight, k=k), 5, ["query_id"])
            same = best.join(base, ["query_id", "doc_id"], "left_semi")
            row = same.agg(F.count("*").alias("same")).select(F.lit(k).alias("k"), F.lit(weight).alias("weight"), "same")
            out = row if out is None else out.unionByName(row)
    return out


def _grid_sql() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT {k} AS k, {w}::DOUBLE AS weight, (SELECT count(*) FROM (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, round(sum(CASE route WHEN 1 THEN 1.0::DOUBLE ELSE {w}::DOUBLE END / ({k} + rank + 1)), 9) AS score
        FROM routes GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5) JOIN base USING (query_id, doc_id)) AS same"""
        for k in (10, 60, 200)
        for w in (0.5, 2.0)
    )
    return f"WITH {ROUTES}, {RRF}, base AS (SELECT query_id, doc_id FROM rrf QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 5) {parts}"


QUERIES = {
    "hybrid_parent_child": hybrid_parent_child, "hybrid_flat": hybrid_flat, "heading_filter": heading_filter, "query_variants": query_variants,
    "approximate_top": approximate_top, "source_search": source_search, "keyword_concat": keyword_concat, "variants_kept": variants_kept,
    "dense_text_top": dense_text_top, "fusion_convex": _fusion("convex", [0.7, 0.3]), "sparse_top": sparse_top, "fusion_rrf": fusion_rrf,
    "fusion_weighted_sum": _fusion("weighted", [0.7, 0.3]), "fusion_combmnz": _fusion("combmnz", [1.0, 1.0]),
    "dynamic_cut": dynamic_cut, "simple_rerank": simple_rerank, "chunk_rerank": chunk_rerank, "tfidf_fit": tfidf_fit, "dense_top": dense_top,
    "label_votes": label_votes, "recall_mrr_ndcg": recall_mrr_ndcg, "keyword_recall": keyword_recall, "keyword_truth": keyword_truth,
    "context_precision": context_precision, "fusion_grid": fusion_grid,
}
SQL = {
    "approximate_top": APPROXIMATE_TOP, "source_search": SOURCE_SEARCH, "keyword_concat": KEYWORD_CONCAT, "variants_kept": VARIANTS_KEPT,
    "hybrid_parent_child": HYBRID, "hybrid_flat": HYBRID_FLAT, "heading_filter": HEADING_FILTER, "chunk_rerank": CHUNK_RERANK,
    "query_variants": f"WITH {VARIANTS} SELECT query_id, variant::INT AS variant, query FROM variants",
    "dense_text_top": f"WITH {ROUTES} SELECT query_id, doc_id, rank, score FROM routes WHERE route = 2 AND rank < 5",
    "fusion_convex": _fusion_sql("sum(score * CASE route WHEN 1 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END)"),
    "sparse_top": f"WITH {ROUTES} SELECT query_id, doc_id, rank, score FROM routes WHERE route = 1 AND rank < 5",
    "fusion_rrf": _fusion_sql("sum(1.0::DOUBLE / (60 + rank + 1))"),
    "fusion_weighted_sum": _fusion_sql("sum(score * CASE route WHEN 1 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END)"),
    "fusion_combmnz": _fusion_sql("sum(score) * count(*)"),
    "dynamic_cut": DYNAMIC_CUT, "simple_rerank": SIMPLE_RERANK, "tfidf_fit": TFIDF_FIT, "dense_top": DENSE_TOP, "label_votes": LABEL_VOTES,
    "recall_mrr_ndcg": RECALL, "keyword_recall": KEYWORD_RECALL, "keyword_truth": KEYWORD_TRUTH, "context_precision": CONTEXT_PRECISION,
    "fusion_grid": _grid_sql(),
}
