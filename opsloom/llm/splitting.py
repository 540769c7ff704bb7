"""Cutting oversized texts into pieces at natural boundaries, with a given overlap.

The pieces of a text of n characters under limit m with overlap o are [c(k-1) - o, c(k)): each is at most m long, and
each begins with the last o characters of the one before. Dynamic programming over the boundary positions chooses the
cuts c that cost least: one per piece, plus a penalty for the kind of boundary, plus the squared deviation of the
piece's length from an even split.

Defined results: a text at most as long as its limit, and one whose type has no limit, is one piece; a null text is
none. Every character is in a piece. An overlap that leaves no room for progress counts as the limit less one. Cuts keep
user-perceived characters (combining marks, joined emoji, CR LF) together unless one alone exceeds the limit. Type
names are compared without case and surrounding blanks. Rows that occur twice are cut twice; the caller decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Penalties of a cut behind each kind of boundary, and inside a word, in pieces.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 0.0, 0.15, 0.2, 0.6, 1.2, 3.0
# How much a piece of no length at all, against an even split, costs.
IMBALANCE = 2.0

#: Texts that are solved side by side.
TOGETHER = 128

_BOUNDARIES = [
    (PARAGRAPH, re.compile(r"\n[ \t\r]*\n\s*")),
    (LINE, re.compile(r"\r?\n")),
    (SENTENCE, re.compile(r"[.!?…]+[\"')\]»”’]*(?=\s)\s?|[。！？；]+[”’」』）]*|</(?:p|li|tr|td|h\d)>")),
    (CLAUSE, re.compile(r"[,;:](?=\s)\s?|[，、：]|\s[–—-](?=\s)\s?|\|")),
    (WORD, re.compile(r"[ \t　]+")),
]
_JOINS = {"‍", "︎", "️"}


def _glued(text: str, at: int) -> bool:
    """Whether a cut before text[at] would part one user-perceived character."""
    c, before = text[at], text[at - 1]
    if before == "\r" and c == "\n":
        return True
    if c < "̀":
        return False
    flags = "\U0001f1e6" <= c <= "\U0001f1ff" and "\U0001f1e6" <= before <= "\U0001f1ff"
    return (
        c in _JOINS
        or before == "‍"
        or unicodedata.category(c) in ("Mn", "Me", "Mc")
        or "\U0001f3fb" <= c <= "\U0001f3ff"
        or flags
    )


def boundaries(text: str, step: int, words: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which the text may be cut, in order, and the penalty of each.

    Ends of paragraphs, lines, sentences, clauses and (with ``words``) words; and between two of all these that are
    further apart than a step, so that no piece could reach from one to the next, every position that parts no
    user-perceived character.
    """
    cost = _ends(text, {len(text): 0.0}, _BOUNDARIES[:-1])
    return _with_words(text, step, cost) if words else _arrays(cost)


def _ends(text: str, cost: dict[int, float], kinds: list) -> dict[int, float]:
    """cost with the ends of further kinds of boundaries; the first kind of a position counts."""
    n = len(text)
    for penalty, pattern in kinds:
        for m in pattern.finditer(text):
            end = m.end()
            if end < n and end not in cost:
                cost[end] = penalty
    return cost


def _arrays(cost: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    where = sorted(cost)
    return np.array(where), np.array([cost[k] for k in where])


def _with_words(text: str, step: int, cost: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    cost = _ends(text, cost, _BOUNDARIES[-1:])
    before = 0
    for at in sorted(cost):
        if at - before > step:
            cost.update(_anywhere(text, before, at, step))
        before = at
    return _arrays(cost)


def _anywhere(text: str, before: int, at: int, step: int) -> dict[int, float]:
    free = [k for k in range(before + 1, at) if not _glued(text, k)]
    # A run of joined characters longer than a step can only be cut inside.
    if any(b - a > step for a, b in zip([before, *free], [*free, at])):
        free = range(before + 1, at)
    return dict.fromkeys(free, INSIDE)


def split(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The pieces [start, end) of a text."""
    return split_all([text], limit, overlap)[0]


def split_all(texts: list[str], limit: int, overlap: int) -> list[list[tuple[int, int]]]:
    """The pieces [start, end) of each text. Texts that need the ends of words are solved side by side."""
    overlap = max(0, min(overlap, limit - 1))
    step = limit - overlap
    cuts: list[list[int]] = [[] for _ in texts]
    hard: list[tuple[int, np.ndarray, np.ndarray, float]] = []
    for at, text in enumerate(texts):
        n = len(text)
        if n <= limit:
            cuts[at] = [n]
            continue
        fewest = 1 + -(-(n - limit) // step)
        even = (n + (fewest - 1) * overlap) / fewest
        # A way with a cut behind a word or inside one costs at least this, so a cheaper way without such cuts is the best.
        cost = _ends(text, {n: 0.0}, _BOUNDARIES[:-1])
        price, cuts[at] = _cheapest(*_arrays(cost), limit, overlap, even)
        if not price <= fewest + WORD:
            hard.append((at, *_with_words(text, step, cost), even))
    hard.sort(key=lambda h: len(h[1]))
    for begin in range(0, len(hard), TOGETHER):
        group = hard[begin : begin + TOGETHER]
        # A long text among short ones is solved alone, as the others would only wait for it.
        together = [h for h in group if len(group) >= 8 and len(h[1]) <= 4 * len(group[0][1])]
        for h, found in zip(together, _cheapest_all([h[1:] for h in together], limit, overlap) if together else ()):
            cuts[h[0]] = found
        for at, where, penalty, even in group[len(together) :]:
            cuts[at] = _cheapest(where, penalty, limit, overlap, even)[1]
    return [[(0, c[0])] + [(x - overlap, y) for x, y in zip(c, c[1:])] for c in cuts]


def _cheapest_all(problems: list[tuple[np.ndarray, np.ndarray, float]], limit: int, overlap: int) -> list[list[int]]:
    """``_cheapest`` for several texts at once, one position of each after the other; the cuts only."""
    count, longest = len(problems), max(len(w) for w, _, _ in problems)
    step, weight = limit - overlap, IMBALANCE / limit**2
    where = np.full((count, longest), 1e12)
    penalty = np.zeros((count, longest))
    even = np.array([[e] for _, _, e in problems])
    width = 1
    for row, (w, p, _) in enumerate(problems):
        where[row, : len(w)], penalty[row, : len(w)] = w, p
        width = max(width, int((np.arange(len(w)) - np.searchsorted(w, w - step)).max()))
    best = np.where(where <= limit, 1 + penalty + weight * (where - even) ** 2, np.inf)
    before = np.where(where > overlap, best, np.inf)
    come = np.full((count, longest), -1)
    targets, rows = where + overlap - even, np.arange(count)
    for j in range(1, longest):
        low = max(0, j - width)
        sizes = targets[:, j : j + 1] - where[:, low:j]
        grid = before[:, low:j] + weight * sizes * sizes
        grid[where[:, low:j] < where[:, j : j + 1] - step] = np.inf
        k = grid.argmin(axis=1)
        total = grid[rows, k] + 1 + penalty[:, j]
        better = (total < best[:, j]) & (where[:, j] > overlap)
        best[better, j] = before[better, j] = total[better]
        come[better, j] = low + k[better]
    out = []
    for row, (w, _, _) in enumerate(problems):
        cuts, j = [], len(w) - 1
        while j >= 0:
            cuts.append(int(w[j]))
            j = come[row, j]
        out.append(cuts[::-1])
    return out


def _cheapest(where: np.ndarray, penalty: np.ndarray, limit: int, overlap: int, even: float) -> tuple[float, list[int]]:
    """The least cost of cuts at the given positions that end with the last of them, and those cuts."""
    count = len(where)
    best = np.full(count, np.inf)
    come = np.full(count, -1)
    weight = IMBALANCE / limit**2
    first = where <= limit
    best[first] = 1 + penalty[first] + weight * (where[first] - even) ** 2
    lows = np.searchsorted(where, where - (limit - overlap)).tolist()
    # A cut at or before the overlap would repeat a piece whole, so nothing follows on it.
    before = np.where(where > overlap, best, np.inf)
    targets = (where + overlap - even).tolist()
    for j in range(int(np.searchsorted(where, overlap, "right")), count):
        low = lows[j]
        if low == j:
            continue
        sizes = targets[j] - where[low:j]
        grid = before[low:j] + weight * sizes * sizes
        k = int(grid.argmin())
        total = grid[k] + 1 + penalty[j]
        if total < best[j]:
            best[j] = before[j] = total
            come[j] = low + k
    if best[-1] == np.inf:
        return np.inf, []
    cuts, j = [], count - 1
    while j >= 0:
        cuts.append(int(where[j]))
        j = come[j]
    return float(best[-1]), cuts[::-1]


def pieces(df: DataFrame, limits: DataFrame, key: str, kind: str, text: str, keep: list[str]) -> DataFrame:
    """(key, *keep, oversized, piece_no, start, end, piece) of each row of df with a text.

    oversized: whether the text came out in more than one piece. limits: (element_type, max_chars, overlap_chars), one
    row for each type. keep: further columns to hand on, such as
    the heading path.
    """
    plain = lambda c: F.lower(F.btrim(F.col(c), F.lit(" \t")))
    rule = limits.select(plain("element_type").alias("__kind"), "max_chars", "overlap_chars")
    rule = rule.groupBy("__kind").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("__rule"))
    rows = df.filter(F.col(text).isNotNull()).select(
        F.col(key), *(F.col(c) for c in keep), F.col(text).alias("__text"), plain(kind).alias("__kind")
    )
    rows = rows.join(rule, "__kind", "left")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            at, several, number, starts, ends, parts = [], [], [], [], [], []
            texts, ruled = pdf["__text"].tolist(), pdf[["limit", "overlap"]].dropna()
            cuts = [[(0, len(t))] for t in texts]
            for (limit, overlap), mine in ruled[ruled["limit"] > 0].groupby(["limit", "overlap"]):
                rows = [pdf.index.get_loc(i) for i in mine.index]
                for row, found in zip(rows, split_all([texts[r] for r in rows], int(limit), int(overlap))):
                    cuts[row] = found
            for row, (whole, found) in enumerate(zip(texts, cuts)):
                for k, (a, b) in enumerate(found):
                    at.append(row)
                    several.append(len(found) > 1)
                    number.append(k)
                    starts.append(a)
                    ends.append(b)
                    parts.append(whole[a:b])
            out = pdf.iloc[at][[key, *keep]].reset_index(drop=True)
            yield out.assign(oversized=several, piece_no=number, start=starts, end=ends, piece=parts)

    fields = [f for f in rows.schema.fields if f.name in (key, *keep)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    given = rows.select(
        key, *keep, "__text", F.col("__rule.max_chars").alias("limit"), F.col("__rule.overlap_chars").alias("overlap")
    )
    return given.mapInPandas(cut, f"{schema}, oversized boolean, piece_no int, start int, end int, piece string")
