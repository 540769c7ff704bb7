"""Scoring a stated set of queries against all rows by matrix products, keeping the best of each partition.

Every partition of the rows is read once in Arrow batches. A batch is scored against a whole block of queries by one
product, and only rows that can still be among a query's best are kept, so what leaves a partition is at most k rows for
each query. Blocks of queries are bounded by a parameter; more queries than a block go through one block after the other.

Defined results: scores are rounded before they are ranked and ties go to the smaller id. Rows with a null id are no
hits. Queries of equal key count once for each of their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.session import stage_table

DIGITS = 9
#: Queries in one block, and rows of query weights in one block of the sparse route.
BLOCK, BLOCK_WEIGHTS = 1024, 500_000
#: Candidates that a partition collects before it drops those that fell behind.
HELD = 1 << 20


class Best:
    """The k best (score, id) of each of so many queries, over batches of scores."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.least = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray | None = None) -> None:
        """scores: (queries, rows). valid: which of them count at all."""
        if scores.shape[1] > self.k:
            within = np.where(valid, scores, -np.inf) if valid is not None else scores
            self.least = np.maximum(self.least, np.partition(within, -self.k, axis=1)[:, -self.k])
        take = scores >= self.least[:, None]
        if valid is not None:
            take &= valid
        q, r = np.nonzero(take)
        self.parts.append((q, scores[q, r], ids[r]))
        self.held += len(q)
        if self.held > HELD:
            self.parts = [self.result()]
            self.held = len(self.parts[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        q, s, i = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        begins = np.searchsorted(q, q, "left")
        kept = np.arange(len(q)) - begins < self.k
        return q[kept], s[kept], i[kept]


def _schema(df: DataFrame, by: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "doc_id bigint, score double"])


def _emit(best: Best, keys: pa.Table, names: list[str]) -> pa.RecordBatch:
    q, s, i = best.result()
    columns = [keys.column(c).combine_chunks().take(pa.array(q)) for c in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=[*names, "doc_id", "score"])


def in_blocks(queries: DataFrame, size: int, run: Callable[[pa.Table], DataFrame], key: str) -> DataFrame:
    """The hits of all queries, block by block. One block is planned with the rest; several are written one by one, so
    that the driver never holds more than one of them."""
    first = queries.limit(size + 1).toArrow()
    if first.num_rows <= size:
        return run(first)
    kept = stage_table(queries, "queries")
    blocks = -(-kept.count() // size)
    out = None
    for b in range(blocks):
        part = stage_table(run(kept.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toArrow()), "hits")
        out = part if out is None else out.unionByName(part)
    return out


#: Rows that cells are fitted on at most.
SAMPLE = 20_000


def cells_of(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centres of cells, by spherical k-means on a bounded sample: the rows with the smallest hashes of their ids."""
    rows = vectors.filter("v IS NOT NULL").select(F.col("v").cast("array<double>").alias("v"), F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample).toArrow()
    lists = rows.column("v").to_pylist()
    width = max(map(len, lists), default=0)
    if not width:
        return np.zeros((0, 0))
    points = np.array([[x or 0.0 for x in r] for r in lists if len(r) == width], float).reshape(-1, width)
    lengths = np.linalg.norm(points, axis=1)
    points = points[lengths > 0] / lengths[lengths > 0, None]
    centres = points[: max(1, min(cells, len(points)))].copy()
    for _ in range(rounds):
        near = (points @ centres.T).argmax(axis=1) if len(points) else np.zeros(0, int)
        for c in range(len(centres)):
            mine = points[near == c]
            if len(mine):
                centres[c] = mine.sum(axis=0)
        norms = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = np.divide(centres, norms, out=np.zeros_like(centres), where=norms > 0)
    return centres


def dense(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK, centres: np.ndarray | None = None, probes: int = 8) -> DataFrame:
    """(query_id, doc_id, score): the k best of each query in each partition by (cosine + 1) / 2.

    queries: (query_id, q). vectors: (doc_id, v). A vector without length, null or of another dimension scores 0.5.
    centres: compares a query only with the rows of its ``probes`` nearest cells, which may miss some; every row is in a
    cell, and cells have no bound on their rows. Without them all rows are compared.
    """

    asked_rows = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))

    def run(asked: pa.Table) -> DataFrame:
        rows = asked.column("q").to_pylist()
        width = max((len(r) for r in rows if r), default=0)
        matrix = np.zeros((len(rows), width))
        for n, r in enumerate(rows):
            if r and len(r) == width:
                matrix[n] = [0.0 if x is None else x for x in r]
        lengths = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
        matrix = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
        keys = asked.select(["query_id"])
        probed = None
        if centres is not None and len(centres) and width == centres.shape[1]:
            nearest = np.argsort(-(matrix @ centres.T), axis=1)[:, :probes]
            probed = np.zeros((len(matrix), len(centres)), bool)
            probed[np.arange(len(matrix))[:, None], nearest] = True

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(matrix), k)
            for batch in batches:
                if not batch.num_rows or not len(matrix):
                    continue
                lists = batch.column("v")
                fits = np.asarray(lists.value_lengths().fill_null(0)) == width
                values = np.zeros((batch.num_rows, width))
                if width and fits.any():
                    flat = lists.filter(pa.array(fits)).flatten().cast(pa.float64()).fill_null(0.0)
                    values[fits] = np.asarray(flat).reshape(-1, width)
                norms = np.sqrt((values**2).sum(axis=1, keepdims=True))
                values = np.divide(values, norms, out=np.zeros_like(values), where=norms > 0)
                ids = np.asarray(batch.column("doc_id"))
                if probed is None:
                    best.add(np.round((matrix @ values.T + 1) / 2, DIGITS), ids)
                    continue
                cell = (values @ centres.T).argmax(axis=1)
                scores, valid = np.zeros((len(matrix), len(values))), probed[:, cell]
                for c in np.unique(cell):
                    q, r = np.flatnonzero(probed[:, c]), np.flatnonzero(cell == c)
                    scores[np.ix_(q, r)] = np.round((matrix[q] @ values[r].T + 1) / 2, DIGITS)
                best.add(scores, ids, valid)
            yield _emit(best, keys, ["query_id"])

        rows_ = vectors.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "v")
        return rows_.mapInArrow(score, _schema(asked_rows, ["query_id"]))

    return in_blocks(asked_rows, block, run, "query_id")


def sparse(asked: DataFrame, index: DataFrame, k: int, by: list[str], block: int = BLOCK_WEIGHTS) -> DataFrame:
    """(*by, doc_id, score): the k best of each query in each partition by the product of term weights.

    asked: (*by, term, w). index: (doc_id, terms array<struct<term, w>>). Rows that share no term are no hits.
    """

    asked_rows = asked.select(*by, "term", "w")

    def run(rows: pa.Table) -> DataFrame:
        keys: dict[tuple, int] = {}
        where: dict[str, tuple[list[int], list[float]]] = {}
        for *key, term, w in zip(*(rows.column(c).to_pylist() for c in [*by, "term", "w"])):
            n = keys.setdefault(tuple(key), len(keys))
            at, weights = where.setdefault(term, ([], []))
            at.append(n)
            weights.append(w)
        named = pa.table({c: pa.array([key[n] for key in keys], rows.schema.field(c).type) for n, c in enumerate(by)})
        terms = {t: (np.array(at), np.array(ws)) for t, (at, ws) in where.items()}

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(keys), k)
            for whole in batches:
                # So many rows at once as keep the product within bounds.
                step = max(1, (1 << 22) // max(1, len(keys)))
                for begin in range(0, whole.num_rows, step):
                    batch = whole.slice(begin, step)
                    lists = batch.column("terms")
                    each = lists.flatten()
                    owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
                    total = np.zeros((batch.num_rows, len(keys)))
                    shared = np.zeros((batch.num_rows, len(keys)), bool)
                    hit = False
                    for row, term, w in zip(owner.tolist(), each.field("term").to_pylist(), each.field("w").to_pylist()):
                        if term in terms:
                            at, weights = terms[term]
                            total[row, at] += weights * w
                            shared[row, at] = hit = True
                    if hit:
                        best.add(np.round(total.T, DIGITS), np.asarray(batch.column("doc_id")), shared.T)
            yield _emit(best, named, by)

        return index.select(F.col("doc_id").cast("bigint").alias("doc_id"), "terms").mapInArrow(score, _schema(asked_rows, by))

    return in_blocks(asked_rows, block, run, by[0])
