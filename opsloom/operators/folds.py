"""Folds whose next step depends on what was decided before: limiters, breaker, budgets.

Each runs over the rows of one key in order. The rows of a key are sorted by Spark, not gathered by Python: the function
sees the sorted partition as a stream and keeps only its small state, so a key with very many rows costs time but no
memory. Null keys form a key of their own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, key: str, order: list[str], keep: list[str], out: str, start: Callable, step: Callable) -> DataFrame:
    """(key, *keep, out…) with the columns ``out`` (a schema string) that ``step(state, row)`` gives for each row in order.

    start: makes the state of a new key. step: changes the state and returns the values of ``out``.
    """
    names = [part.split()[0] for part in out.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for pdf in frames:
            values = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                k = None if pd.isna(k) else k
                if not begun or k != now:
                    now, state, begun = k, start(), True
                values.append(step(state, row))
            made = pd.DataFrame(values, columns=names, index=pdf.index)
            yield pd.concat([pdf[[key, *keep]], made], axis=1)

    placed = df.repartition(key).sortWithinPartitions(key, *order)
    columns = [key, *(c for c in dict.fromkeys([*order, *keep]) if c != key)]
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in [key, *keep]), out])
    return placed.select(*columns).mapInPandas(run, schema)


def sliding_limit(df: DataFrame, key: str, ts: str, tie: str, most: int, window_s: int) -> DataFrame:
    """(key, ts, tie, accepted): at most ``most`` accepted requests in any window; rejected ones don't count."""

    def step(accepted: deque, row) -> tuple:
        now = getattr(row, ts)
        while accepted and accepted[0] < now - window_s:
            accepted.popleft()
        if len(accepted) >= most:
            return (False,)
        accepted.append(now)
        return (True,)

    return fold(df, key, [ts, tie], [ts, tie], "accepted boolean", deque, step)


def token_bucket(df: DataFrame, key: str, ts: str, tie: str, per_s: float, capacity: float) -> DataFrame:
    """(key, ts, tie, accepted): a bucket that fills at ``per_s`` up to ``capacity`` and gives one token a request."""

    def step(state: dict, row) -> tuple:
        now = getattr(row, ts)
        if "at" in state:
            state["left"] = min(capacity, state["left"] + (now - state["at"]) * per_s)
        state["at"] = now
        if state["left"] < 1:
            return (False,)
        state["left"] -= 1
        return (True,)

    return fold(df, key, [ts, tie], [ts, tie], "accepted boolean", lambda: {"left": capacity}, step)


def circuit_breaker(df: DataFrame, key: str, ts: str, tie: str, failed: str, threshold: int = 5, reset_s: int = 30) -> DataFrame:
    """(key, ts, tie, admitted, state): closed until ``threshold`` failures in a row, then open for ``reset_s``, then one probe."""

    def step(s: dict, row) -> tuple:
        now = getattr(row, ts)
        state = s["state"]
        if state == "open" and now - s["since"] >= reset_s:
            state = "half_open"
        if state == "open":
            s["state"] = state
            return (False, state)
        if getattr(row, failed) is True or getattr(row, failed) == 1:
            s["count"] += 1
            if state == "half_open" or s["count"] >= threshold:
                state, s["since"] = "open", now
        else:
            state, s["count"] = "closed", 0
        s["state"] = state
        return (True, state)

    return fold(df, key, [ts, tie], [ts, tie, failed], "admitted boolean, state string", lambda: {"state": "closed", "count": 0, "since": 0}, step)


def budget_fit(df: DataFrame, key: str, priority: str, tie: str, tokens: str, truncatable: str, budget: int, least: int = 50) -> DataFrame:
    """(key, tie, kept_tokens, status): parts by falling priority fitted into a budget.

    A part that doesn't fit is cut to what is left if it may be cut and more than ``least`` is left; else it is dropped
    and uses nothing. status is whole, cut or dropped.
    """

    def step(s: dict, row) -> tuple:
        n = getattr(row, tokens)
        n = 0 if pd.isna(n) else int(n)
        left = budget - s["used"]
        if n <= left:
            s["used"] += n
            return (n, "whole")
        may = getattr(row, truncatable)
        if not pd.isna(may) and may and n > 0 and left > least:
            s["used"] += left
            return (left, "cut")
        return (0, "dropped")

    return fold(df, key, [priority, tie], [tie, tokens, truncatable], "kept_tokens int, status string", lambda: {"used": 0}, step)
