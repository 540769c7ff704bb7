"""Retrieval over all queries at once: dense and sparse routes, fusion, roll-up to parents, cuts.

Hits are rows (query_id, doc_id, score). Ranks are total: ties go to the smaller id. Scores are rounded before they are
ranked, so that the order of additions can't change a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.operators import scoring

DIGITS = scoring.DIGITS


def ranked(hits: DataFrame, by: list[str], score: str = "score", tie: str = "doc_id", name: str = "rank") -> DataFrame:
    """hits with their place, from 0, by falling score within each ``by``."""
    return hits.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), F.col(tie))) - 1)


def top(hits: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of each ``by``. Spark cuts to k within each partition before it shuffles, which takes a plain bound on
    the row number."""
    numbered = hits.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), F.col(tie))))
    return numbered.filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays; 0 where one has no length, is null, or their dimensions differ."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot(a, b) / both).otherwise(0.0)


def unit(v: Column) -> Column:
    """A vector at length 1; one without length as it is."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x.cast("double") / norm(v))).otherwise(v.cast("array<double>"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, block: int = scoring.BLOCK) -> DataFrame:
    """The k vectors nearest to each query by cosine, scored (cos + 1) / 2; a vector without length scores 0.5.

    queries: (query_id, q). vectors: (doc_id, v), filtered before if they are to be. least: the least score of a hit.
    """
    hits = top(scoring.dense(queries, vectors, k, block), k, ["query_id"])
    return hits if least is None else hits.filter(F.col("score") >= least)


def approximate_top(queries: DataFrame, vectors: DataFrame, k: int, cells: int, probes: int, sample: int = scoring.SAMPLE) -> DataFrame:
    """Like ``dense_top``, over the cells nearest to each query only. ``recall`` tells what it misses."""
    centres = scoring.cells_of(vectors, cells, sample)
    return top(scoring.dense(queries, vectors, k, centres=centres, probes=probes), k, ["query_id"])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the mean share of each query's exact hits that were found."""
    both = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1.0).alias("hit")), ["query_id", "doc_id"], "left")
    each = both.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r"))
    return each.agg(F.count("*").alias("queries"), F.avg("r").alias("recall"))


def original_order(hits: DataFrame) -> DataFrame:
    """The reranker that stands in for a language model: hits by their own score."""
    return ranked(hits.drop("rank"), ["query_id"])


def sparse_top(asked: DataFrame, index: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The k rows of each query by the product of term weights; see ``scoring.sparse``."""
    return top(scoring.sparse(asked, index, k, by), k, by)


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, n, size): how often each term stands in a document of ``size`` terms."""
    listed = docs.select(key, tokens.alias("__tokens")).withColumn("size", F.size("__tokens"))
    return listed.select(key, "size", F.explode("__tokens").alias("term")).groupBy(key, "term", "size").agg(F.count("*").alias("n"))


def document_frequency(docs: DataFrame, tokens: Column) -> DataFrame:
    """(term, df): how many documents hold each term. Terms are made distinct within a document before they are counted,
    so what is shuffled is one partial count for each term and partition."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(frequency: DataFrame, documents: int, most: int | None = None) -> DataFrame:
    """(term, df, idf) with idf = ln((N + 1) / (df + 1)) + 1; of the ``most`` commonest terms, ties to the smaller term."""
    found = frequency.withColumn("idf", F.log((F.lit(documents) + 1) / (F.col("df") + 1)) + 1)
    return found if most is None else found.orderBy(F.desc("df"), "term").limit(most)


def weights(counts: DataFrame, terms: DataFrame, key: list[str]) -> DataFrame:
    """(*key, term, w): tf-idf weights of unit length, for a bounded set of queries."""
    raw = counts.join(terms.select("term", "idf"), "term").select(*key, "term", (F.col("n") / F.col("size") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(*key)))
    return raw.withColumn("w", F.col("w") / length)


def counted(tokens: Column) -> Column:
    """The distinct tokens of a short text with how often each occurs, without moving any row.

    tokens: a column of sorted tokens, so that equal ones are neighbours.
    """
    n = F.size(tokens)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1)))
    ends = F.concat(F.slice(starts, 2, n), F.array(n))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(F.get(tokens, a).alias("term"), (b - a).alias("n")))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<struct<term:string,n:int>>"))


def weighted_rows(rows: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, terms array<struct<term, w>>): tf-idf weights of unit length of each row (key, size, counts).

    Terms meet their idf by an equi-join, in which AQE splits terms that are in every row; then each row is put
    together again by its key, with its length, in one aggregation.
    """
    each = rows.select(key, "size", F.inline("counts"))
    raw = each.join(terms.select("term", "idf"), "term").select(key, "term", (F.col("n") / F.col("size") * F.col("idf")).alias("w"))
    whole = raw.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    one = lambda x: F.struct(x["term"].alias("term"), (x["w"] / F.col("length")).alias("w"))
    return whole.select(key, F.transform("t", one).alias("terms"))


def fused(routes: list[DataFrame], how: str = "rrf", weights_: list[float] | None = None, k: int = 60) -> DataFrame:
    """(query_id, doc_id, score) of several routes of hits with (query_id, doc_id, score, rank).

    rrf: sum of weight / (k + rank + 1). weighted: sum of weight * score. convex: the same for two routes whose weights
    sum to 1. combmnz: sum of scores times their number. Anything else is rrf.
    """
    if how == "convex" and (len(routes) != 2 or abs(sum(weights_ or [0.5, 0.5]) - 1) > 1e-9):
        raise ValueError("a convex combination takes two routes with weights that sum to 1")
    given = weights_ or [1.0] * len(routes)
    all_ = None
    for route, weight in zip(routes, given):
        part = route.select("query_id", "doc_id", "score", "rank", F.lit(float(weight)).alias("weight"))
        all_ = part if all_ is None else all_.unionByName(part)
    return fused_hits(all_, how, k)


def fused_hits(hits: DataFrame, how: str = "rrf", k: int = 60) -> DataFrame:
    """(query_id, doc_id, score) of hits of all routes in one table, each with the ``weight`` of its route."""
    rrf = F.sum(F.col("weight") / (F.lit(k) + F.col("rank") + 1))
    weighted = F.sum(F.col("weight") * F.col("score"))
    known = {"rrf": rrf, "weighted": weighted, "convex": weighted, "combmnz": F.sum("score") * F.count("*")}
    value = known.get(how, rrf)
    return hits.groupBy("query_id", "doc_id").agg(F.round(value, DIGITS).alias("score"))


def parent_votes(hits: DataFrame, parents: DataFrame | None = None, boost: float = 0.1) -> DataFrame:
    """(query_id, parent_id, score, hits): the best child's score and ``boost`` for each further child.

    parents: (doc_id, parent_id), unless hits have their parent_id. Hits without a parent are dropped.
    """
    found = hits if parents is None else hits.join(parents, "doc_id")
    grouped = found.filter(F.col("parent_id").isNotNull()).groupBy("query_id", "parent_id").agg(F.max("score").alias("best"), F.count("*").alias("hits"))
    return grouped.select("query_id", "parent_id", F.round(F.col("best") + boost * (F.col("hits") - 1), DIGITS).alias("score"), "hits")


def decayed(score: Column, valid_until: Column, now: Column) -> Column:
    """Half the score of what is out of date; an unset or unreadable date never is."""
    return F.when(expired(valid_until, now), score * 0.5).otherwise(score)


def expired(valid_until: Column, now: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(valid_until, "/", "-"), "[Zz]$", "")
    return F.coalesce(F.try_to_timestamp(text).cast("timestamp") < now, F.lit(False))


def dynamic_cut(hits: DataFrame, k: int, gap: float = 0.15) -> DataFrame:
    """Hits of queries whose best k stand clear of the tail behind 2k cut to 2k; all hits of the others."""
    hits = ranked(hits, ["query_id"])
    by = W.partitionBy("query_id")
    head = F.avg(F.when(F.col("rank") < k, F.col("score"))).over(by)
    tail = F.avg(F.when(F.col("rank") >= 2 * k, F.col("score"))).over(by)
    clear = F.coalesce((F.abs(head) >= 1e-6) & (F.abs(head - tail) / F.abs(head) > gap), F.lit(False))
    return hits.withColumn("clear", clear).filter(~F.col("clear") | (F.col("rank") < 2 * k))


def heading_filter(parents: DataFrame, terms: Column, content: Column, heading: Column, boost: float = 0.05) -> DataFrame:
    """parents (query_id, …, score) that hold one of the query's terms in content or heading, with ``boost`` for the
    heading. Queries of which nothing would be left keep all their parents as they were."""
    held = lambda text: F.exists(terms, lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), t))
    marked = parents.withColumn("__heading", F.coalesce(held(heading), F.lit(False)))
    marked = marked.withColumn("__kept", F.col("__heading") | F.coalesce(held(content), F.lit(False)))
    some = F.max("__kept").over(W.partitionBy("query_id"))
    raised = F.round(F.when(F.col("__heading"), F.col("score") + boost).otherwise(F.col("score")), DIGITS)
    return marked.withColumn("__some", some).filter("__kept OR NOT __some").withColumn("score", raised).drop("__heading", "__kept", "__some")


def passes_gate(hits: DataFrame, least: float = 0.35, fewest: int = 2) -> DataFrame:
    """(query_id, passes): whether a query has enough hits of which the best is good enough."""
    return hits.groupBy("query_id").agg(((F.count("*") >= fewest) & (F.max("score") >= least)).alias("passes"))


def simple_rerank_score(score: Column, content: Column, source_weight: Column) -> Column:
    """0.6 of the score, 0.2 of a weight for the length of the content, 0.2 of one for its source."""
    n = F.length(content)
    size = F.when(n < 50, 0.3).when(n < 200, 0.8).when(n < 500, 1.0).otherwise(0.7)
    return score * 0.6 + size * 0.2 + source_weight * 0.2


def lexical_overlap(query_tokens: Column, text_tokens: Column) -> Column:
    """The share of the query's distinct tokens that occur in the text: the scorer where no model is plugged in."""
    distinct = F.array_distinct(query_tokens)
    return F.when(F.size(distinct) == 0, 0.0).otherwise(F.size(F.array_intersect(distinct, text_tokens)) / F.size(distinct))
