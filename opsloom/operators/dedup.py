"""Exactly one row of each message that was delivered more than once.

A message identifier of up to 192 bits is laid out in three 64-bit lanes and permuted by a Feistel network, which is a
bijection: the quotient (the first bits of the permuted identifier) names the shard and the slot, the remainder (all
lanes, kept whole) tells identifiers apart, so no two different identifiers can ever be taken for one. Every partition
first folds its own rows into quotient tables, so that a message with very many copies leaves one entry for each of
these; the entries then go to the shard of their quotient, where each identifier is inserted once. There are as many
shards as keep each within a fixed number of rows, whatever the input: the permutation spreads identifiers evenly.

Defined results: rows whose identifier is null are nobody's copy and are kept. Of equal identifiers the row with the
smallest id is kept; rows that are repeated whole count as one row. Identifiers that don't fit 192 bits are told apart
by their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.session import stage_table

LANES = ["q0", "q1", "q2"]
ROUNDS = 6
# Rows that one local table takes before it is handed on.
LOCAL_ROWS = 1 << 17
# Rows that a shard has room for.
SHARD_ROWS = 1 << 18


def pack8(text: Column) -> Column:
    """Up to eight bytes of text as one integer; null if there are more or a zero byte, so that it stays one to one."""
    packed = F.rpad(F.hex(F.encode(text, "UTF-8")), 16, "0")
    return F.when((F.octet_length(text) <= 8) & (F.instr(text, "\x00") == 0), hex64(packed))


def hex64(text: Column) -> Column:
    """Sixteen hexadecimal digits as a 64-bit integer."""
    part = lambda a: F.conv(F.substring(text, a, 8), 16, 10).try_cast("bigint")
    return F.shiftleft(part(1), 32).bitwiseOR(part(9))


def _mixed(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """A well spread function of two lanes; it needn't be invertible."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x.view(np.int64)


def permute(lanes: np.ndarray) -> np.ndarray:
    """Identifiers (three rows of lanes), mixed by a bijection: each step xors one lane with a function of the others."""
    out = np.ascontiguousarray(lanes)
    for k in range(ROUNDS):
        i = k % 3
        out[i] ^= _mixed(out[(i + 1) % 3], out[(i + 2) % 3], k)
    return out


def unpermute(lanes: np.ndarray) -> np.ndarray:
    """The identifiers that ``permute`` gave these lanes for."""
    out = np.ascontiguousarray(lanes)
    for k in reversed(range(ROUNDS)):
        i = k % 3
        out[i] ^= _mixed(out[(i + 1) % 3], out[(i + 2) % 3], k)
    return out


class QuotientTable:
    """An open-addressed table over permuted identifiers, filled by whole arrays at a time.

    The slot of an identifier is the first bits of its first lane, behind those that name its shard (``taken``), which
    all identifiers of a table share; collisions go on to the next slot. Complete remainders are compared, so a hit is
    never false.
    """

    def __init__(self, rows: int, taken: int = 0) -> None:
        self.taken = np.uint64(taken)
        self.bits = max(6, int(rows * 2 - 1).bit_length())
        size = 1 << self.bits
        self.lanes = np.zeros((3, size), np.int64)
        self.least = np.full(size, np.iinfo(np.int64).max)
        self.count = np.zeros(size, np.int64)

    def insert(self, lanes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        slot = (lanes[0].view(np.uint64) << self.taken >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(ids))
        while len(todo):
            at = slot[todo]
            free = self.count[at] == 0
            if free.any():
                # Of several newcomers at one free slot the first takes it.
                newcomers = todo[free]
                places, first = np.unique(slot[newcomers], return_index=True)
                self.lanes[:, places] = lanes[:, newcomers[first]]
            same = (self.lanes[:, at] == lanes[:, todo]).all(axis=0) & (free | (self.count[at] > 0))
            hit = todo[same]
            np.minimum.at(self.least, slot[hit], ids[hit])
            np.add.at(self.count, slot[hit], counts[hit])
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def batch(self, more_than: int = 0, plain: bool = False) -> pa.RecordBatch:
        used = self.count > more_than
        lanes = self.lanes[:, used]
        columns = [*(unpermute(lanes) if plain else lanes), self.least[used], self.count[used]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*LANES, "kept", "n"])


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for n in names]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lanes, id) of a partition, folded through tables of bounded size."""
    held: list[tuple] = []
    rows = 0

    def close() -> pa.RecordBatch:
        table = QuotientTable(rows)
        for lanes, ids in held:
            table.insert(lanes, ids, np.ones(len(ids), np.int64))
        held.clear()
        return table.batch()

    for b in batches:
        *lanes, ids = _columns(b, *LANES, "id")
        held.append((permute(np.stack(lanes)), ids))
        rows += len(ids)
        if rows >= LOCAL_ROWS:
            yield close()
            rows = 0
    if rows:
        yield close()


def _shard(bits: int):
    """Entries (lanes, kept, n) of one shard, each identifier inserted once; only those with further copies go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = QuotientTable(sum(b.num_rows for b in held), bits)
            for b in held:
                *lanes, kept, n = _columns(b, *LANES, "kept", "n")
                table.insert(np.stack(lanes), kept, n)
            yield table.batch(more_than=1, plain=True)

    return run


ENTRY = "q0 bigint, q1 bigint, q2 bigint, kept bigint, n bigint"


def repeated(ids: DataFrame, rows: int) -> DataFrame:
    """(q0, q1, q2, kept, n) of each identifier with more than one row, from so many rows (q0, q1, q2, id)."""
    local = ids.select(*LANES, "id").mapInArrow(_fold, ENTRY)
    bits = max(0, rows // SHARD_ROWS).bit_length()
    quotient = F.shiftrightunsigned("q0", 64 - bits) if bits else F.lit(0)
    return local.repartitionById(1 << bits, quotient.cast("int")).mapInArrow(_shard(bits), ENTRY)


def _pairs(rows: DataFrame, found: DataFrame, on: list[str], total: int) -> list[DataFrame]:
    """(kept, id) of the rows of each repeated identifier, those of hot ones by broadcast."""
    hot = F.col("n") > max(1, total // HOT_SHARE)
    out = [rows.join(found.filter(~hot).select(*on, "kept"), on)]
    if not found.filter(hot).isEmpty():
        out.append(rows.join(F.broadcast(found.filter(hot).select(*on, "kept")), on))
    return [p.select("kept", "id") for p in out]


def copies(df: DataFrame, id_col: str, lanes: list[Column], wide: list[Column]) -> DataFrame:
    """(kept_id, copy_id) for each row of df that is a further copy of a message.

    lanes: the identifier as three integers, null where it doesn't fit. wide: its parts as they are, null where the row
    has no identifier. A message of which a large part of all rows are copies is joined by broadcast: at most
    ``HOT_SHARE`` messages can have more than that share of the rows, so that side is bounded whatever the input.
    """
    fits = F.greatest(*(c.isNull().cast("int") for c in lanes)) == 0
    named = F.greatest(*(c.isNull().cast("int") for c in wide)) == 0
    text = F.when(named & ~fits, F.to_json(F.array(*(c.cast("string") for c in wide))))
    rows = df.filter(named).select(
        F.col(id_col).cast("bigint").alias("id"), *(x.alias(n) for x, n in zip(lanes, LANES)), text.alias("wide")
    )
    rows = stage_table(rows.filter(F.col("id").isNotNull()), "messages")
    narrow, long = rows.filter(F.col("wide").isNull()).select("id", *LANES), rows.filter(F.col("wide").isNotNull())
    total = rows.count()
    pairs = _pairs(narrow, stage_table(repeated(narrow, total), "repeated"), LANES, total)
    if not long.isEmpty():
        least = long.groupBy("wide").agg(F.min("id").alias("kept"), F.count("*").alias("n")).filter("n > 1")
        pairs += _pairs(long, stage_table(least, "repeated"), ["wide"], total)
    out = None
    for p in pairs:
        part = p.filter(F.col("id") != F.col("kept")).select(F.col("kept").alias("kept_id"), F.col("id").alias("copy_id"))
        out = part if out is None else out.unionByName(part)
    return out


#: A message with more than one in so many rows is hot; there are fewer than so many of them.
HOT_SHARE = 1000


def keep_one(df: DataFrame, id_col: str, lanes: list[Column], wide: list[Column]) -> DataFrame:
    """df without the further copies of each message."""
    gone = copies(df, id_col, lanes, wide).select(F.col("copy_id").alias(id_col))
    return df.join(gone, id_col, "left_anti")
