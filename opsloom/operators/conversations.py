"""Operators on conversation turns: recent turns, budgets by suffix, rewritten histories, triggers, conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType


def recent(turns: DataFrame, session: str, order: list, n: int) -> DataFrame:
    """The last n turns of each session."""
    back = [F.col(c).desc() for c in order]
    return turns.withColumn("__n", F.row_number().over(W.partitionBy(session).orderBy(*back))).filter(F.col("__n") <= n).drop("__n")


def within_budget(turns: DataFrame, session: str, order: list, tokens: Column, budget: int) -> DataFrame:
    """The longest run of last turns of each session whose tokens fit a budget, and always the very last turn."""
    w = W.partitionBy(session).orderBy(*(F.col(c).desc() for c in order))
    used = F.sum(tokens).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = turns.withColumn("used", used).withColumn("__n", F.row_number().over(w))
    return marked.filter((F.col("used") <= budget) | (F.col("__n") == 1)).drop("__n")


def with_history(turns: DataFrame, session: str, order: list, text: str, n: int, joiner: str = "；") -> DataFrame:
    """turns with ``history``: the texts of up to n turns before, joined in order."""
    w = W.partitionBy(session).orderBy(*order).rowsBetween(-n, -1)
    return turns.withColumn("history", F.concat_ws(joiner, F.collect_list(text).over(w)))


# Words that refer to what was said before.
REFERRING = ["它", "他", "她", "这个", "那个", "上面", "刚才", "前面", "这些", "那些", "之前", "第一", "第二", "再", "还有"]


def refers_back(text: Column, shortest: int = 5) -> Column:
    """Whether a question leans on what was said before: it is very short, or has a referring word."""
    found = F.exists(F.array(*map(F.lit, REFERRING)), lambda w: F.contains(text, w))
    return F.coalesce((F.length(text) < shortest) | found, F.lit(False))


#: Entries of one owner that are compared in one task with as many others.
BLOCK = 16_384
#: What is held at once: pairs of sketches, and tokens of pairs that are compared token by token.
SKETCHED, COMPARED = 1 << 19, 1 << 21
#: Different tokens that a worker keeps numbers for; beyond that it starts anew with the next cell.
KEPT_TOKENS = 1_000_000


def _sketches(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each entry the bits that its tokens are hashed to, about four bits for each token of a usual entry."""
    many = max(1, min(16, -(-4 * int(sizes.mean()) // 64)))
    bit = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(64 * many)
    one, word = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6)
    return np.stack([np.bitwise_or.reduceat(np.where(word == k, one, np.uint64(0)), starts) for k in range(many)])


def _shared(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens entries a and b have in common, pair by pair; the tokens of an entry differ."""
    both = np.stack([a, b], 1).ravel()
    n = sizes[both]
    spots = np.repeat(starts[both] - np.cumsum(n) + n, n) + np.arange(n.sum())
    pair = np.repeat(np.arange(len(both)) // 2, n)
    each = np.sort(pair.astype(np.int64) << 32 | codes[spots])
    return np.bincount(each[1:][each[1:] == each[:-1]] >> 32, minlength=len(a))


def _similar(codes: np.ndarray, sizes: np.ndarray, rank: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(later, earlier) for each entry that has an earlier one much like it, of one from left and one from right.

    Two entries share at most the bits that their sketches share and as many tokens more as one of them has tokens above
    its bits. Pairs for which that is too few are passed over; all others are compared token by token.
    """
    starts = np.cumsum(sizes) - sizes
    sketches = _sketches(codes, starts, sizes)
    spare = sizes - np.bitwise_count(sketches).sum(axis=0, dtype=np.int64)
    part = least / (1 + least) * sizes
    # Sketches share at most 1,024 bits, so bounds beyond these numbers decide alike.
    need = np.floor(part).astype(np.int64)
    mine, other = np.clip((need - spare)[left], -30_000, 30_000).astype(np.int16), np.minimum(need[right], 16_000).astype(np.int16)
    words = np.ascontiguousarray(sketches[:, right])
    best = np.full(len(sizes), len(sizes))
    step = max(1, SKETCHED // len(right))
    for at in range(0, len(left), step):
        own = left[at : at + step]
        # Right stands in order too: of one block, what comes behind these entries is no earlier one.
        end = np.searchsorted(rank[right], rank[own[-1]]) if left is right else len(right)
        shared = np.zeros((len(own), end), np.int16)
        for k, w in enumerate(words):
            shared += np.bitwise_count(sketches[k, own][:, None] & w[None, :end])
        a, b = np.nonzero(shared - other[None, :end] >= mine[at : at + step, None])
        bound = shared[a, b]
        a, b = own[a], right[b]
        most = np.minimum(bound + np.minimum(spare[a], spare[b]), np.minimum(sizes[a], sizes[b]))
        kept = (rank[a] != rank[b]) & (most >= part[a] + part[b] - 1e-6)
        if left is right:
            kept &= rank[b] < rank[a]
        a, b = a[kept], b[kept]
        a, b = np.where(rank[a] > rank[b], a, b), np.where(rank[a] > rank[b], b, a)
        at_once = np.cumsum(sizes[a] + sizes[b]) // COMPARED
        for k in np.split(np.arange(len(a)), np.flatnonzero(np.diff(at_once)) + 1) if len(a) else ():
            x, y = a[k], b[k]
            both = _shared(codes, starts, sizes, x, y)
            like = both >= least * (sizes[x] + sizes[y] - both)
            np.minimum.at(best, x[like], y[like])
    later = np.flatnonzero(best < len(sizes))
    return later, best[later]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, numbers of their tokens one after another, how many each has) of some whole cells each."""
    ids: dict[str, int] = {}
    held: list[tuple[pa.Table, np.ndarray, np.ndarray]] = []
    waiting = 0

    def all_held() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        tables, codes, sizes = zip(*held)
        return pa.concat_tables(tables).combine_chunks(), np.concatenate(codes), np.concatenate(sizes)

    for batch in batches:
        words = batch.column("__w")
        sizes = np.diff(words.offsets.to_numpy())
        found = words.flatten().dictionary_encode("encode")
        numbers = np.fromiter((ids.setdefault(t, len(ids)) for t in found.dictionary.to_pylist()), np.int64, len(found.dictionary))
        rows = pa.Table.from_batches([batch]).drop_columns(["__w"])
        if not sizes.all():
            rows = rows.filter(pa.array(sizes > 0))
        if rows.num_rows:
            held.append((rows, numbers[found.indices.to_numpy(zero_copy_only=False)], sizes[sizes > 0].astype(np.int64)))
            waiting += rows.num_rows
        if waiting < BLOCK:
            continue
        rows, codes, sizes = all_held()
        last = int(_begins(rows)[-1])
        if last:
            cut = int(sizes[:last].sum())
            yield rows.slice(0, last), codes[:cut], sizes[:last]
            rows, codes, sizes = rows.slice(last), codes[cut:], sizes[last:]
            if len(ids) > KEPT_TOKENS:
                # Numbers of the cell that is still open stay.
                names, ids = list(ids), {}
                kept, codes = np.unique(codes, return_inverse=True)
                ids |= {names[c]: k for k, c in enumerate(kept)}
        held, waiting = [(rows, codes, sizes)], 0
    if held:
        yield all_held()


def _begins(rows: pa.Table) -> np.ndarray:
    """Where each cell begins."""
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for c in ("__owner", "__i", "__j"):
        values = rows.column(c).combine_chunks()
        change[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(change)


def _compare(least: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, codes, sizes in _cells(batches):
            begins = _begins(rows)
            order = rows.column("__order").combine_chunks()
            rank = np.zeros(rows.num_rows, np.int64)
            rank[1:] = np.cumsum(pc.not_equal(order[1:], order[:-1]).to_numpy(zero_copy_only=False))
            block, i, j = (rows.column(c).to_numpy() for c in ("__block", "__i", "__j"))
            ends, upto = [*begins[1:], rows.num_rows], np.concatenate([[0], np.cumsum(sizes)])
            later, earlier = [], []
            for a, b in zip(begins, ends):
                left = right = np.arange(b - a)
                if i[a] != j[a]:
                    left, right = np.flatnonzero(block[a:b] == i[a]), np.flatnonzero(block[a:b] == j[a])
                if b - a > 1 and len(left) and len(right):
                    x, y = _similar(codes[upto[a] : upto[b]], sizes[a:b], rank[a:b], left, right, least)
                    later.append(x + a)
                    earlier.append(y + a)
            if later:
                at, first = pa.array(np.concatenate(later)), pa.array(np.concatenate(earlier))
                columns = [rows.column("__owner").take(at), order.take(at), order.take(first)]
                yield pa.Table.from_arrays(columns, names=schema.names).cast(schema).combine_chunks().to_batches()[0] if len(at) else pa.RecordBatch.from_pylist([], schema)

    return run


def first_similar(entries: DataFrame, owner: str, order: str, tokens: Column, least: float) -> DataFrame:
    """(owner, order, earlier): for each entry the first earlier one of its owner that shares enough of its tokens.

    The entries of an owner meet in one task, as texts, so that each is shuffled once and no row is made for a token.
    Every pair is held against a bound by sketches of bits, and what passes token by token. An owner with more than
    ``BLOCK`` entries is dealt to blocks that meet two by two, each pair in a task of its own, so that no task holds more
    than about two blocks; an entry is then sent as often as its owner has blocks. Comparing grows with the square of an
    owner's entries. Entries without tokens are like none; neither is one with no owner or order.
    """
    rows = entries.filter(F.col(owner).isNotNull() & F.col(order).isNotNull())
    hot = rows.groupBy(owner).agg(F.count("*").alias("__n")).filter(F.col("__n") > BLOCK)
    # At most one row for each BLOCK entries.
    hot = hot.select(F.col(owner).alias("__hot"), F.ceil(F.col("__n") / BLOCK).cast("int").alias("__blocks"))
    dealt = rows.join(F.broadcast(hot), F.col(owner) == F.col("__hot"), "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    dealt = dealt.withColumn("__block", F.pmod(F.xxhash64(order), F.col("__blocks")).cast("int"))
    met = dealt.withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    met = met.withColumns({"__i": F.least("__block", "__c"), "__j": F.greatest("__block", "__c")}).drop("__hot", "__blocks", "__c")
    sent = met.repartition(F.col(owner), F.col("__i"), F.col("__j")).sortWithinPartitions(owner, "__i", "__j", order)
    words = F.coalesce(F.array_distinct(tokens), F.array().cast("array<string>"))
    cells = sent.select(F.col(owner).alias("__owner"), F.col(order).alias("__order"), "__i", "__j", "__block", words.alias("__w"))
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    out = StructType([StructField(owner, kinds["__owner"]), StructField(order, kinds["__order"]), StructField("earlier", kinds["__order"])])
    found = cells.mapInArrow(_compare(least, to_arrow_schema(out)), out)
    return found.groupBy(owner, order).agg(F.min("earlier").alias("earlier"))
