"""Evaluation items whose passages stand, whole or in part, in documents.

All items go into one Aho-Corasick automaton. Texts are folded first: compatibility forms, case, accents, blanks, punctuation and
invisible characters don't count, and every folded character knows its place in the original. The patterns are the
windows of each passage that few passages share, as those tell passages written from the same phrases apart. One scan of a document finds the windows of every item in it. Then any of three comparisons decides:

* Windows that few passages share are chained in the passage's order over the whole document and extended as far as the
  texts agree. An item goes without this only where even all that its windows could be extended to would be too little.
* Where enough of those windows that hold a digit stand close together, or the first comparison shows a good part of the passage,
  short substrings of the passage that occur around them in its order are chained, and what these cover counts.
* So they are where the stretches between a passage's numbers follow each other without any number between them, as in
  passages whose numbers are masked or written out in words. Of several items that one place could be, those count that
  it holds most of. Other numbers in these places tell of another text written from the same phrases.

Defined results: null, empty and blank texts and passages reveal nothing. A document is reported once for each item;
copies of a document each count. Repeated rows of one document or item give one row. Queries, keywords and parts of
less than half of a passage aren't reported.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a window, in scripts written with letters and in Han script.
WINDOW, HAN_WINDOW = 14, 7
#: Characters of the substrings that are chained, in the same scripts.
STEP, HAN_STEP = 8, 4
#: Passages that may share a window that still tells of each of them; of a passage with few such windows, those are
#: taken that the fewest passages share, up to half of all.
RARE = 3
#: Windows' lengths, or else this share of the passage, from which a run tells of a passage without a digit in a rare window.
LONG, LONG_SHARE = 4, 0.45
#: Windows' lengths from which a run counts wherever it stands; shorter ones do within the passage's length of another run.
SOLE = 2
#: Least share of an item's windows with a digit that a document must hold close together for short substrings to count,
#: or else of the passage that must stand there in runs with a rare window. Phrases that passages and documents have in
#: common hold few of them.
OWN, RUNS = 0.45, 0.45
#: Least length of a stretch between numbers that is looked for, in the same scripts, and least share of an item's
#: stretches that must follow each other without numbers.
STRETCH, HAN_STRETCH, STRETCHES = 8, 4, 0.45
#: What an item may fall short, as a share of its passage, of the item that the same place holds most of.
NEAR = 0.05
#: Least share of a passage that a document must hold in order.
LEAST = 0.5
#: A passage mixed with other text is looked for in so many times its own length.
SPREAD = 3
#: Items in one automaton; more are scanned for in several passes.
ITEMS = 20_000


class _Fold(dict):
    """What remains of each character, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        # Decomposed, so that accents in either form don't count.
        plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(code)).casefold())
        kept = "".join(c for c in plain if c.isalnum())
        self[code] = kept
        return kept


_FOLD = _Fold()
_BARE = re.compile(r"\D+")


def fold(text: str) -> str:
    return text.translate(_FOLD)


def places(text: str) -> list[int]:
    """The original position of each folded character, and the length of the text at the end."""
    out = [k for k, c in enumerate(text) for _ in range(len(_FOLD[ord(c)]))]
    return [*out, len(text)]


def _han(text: str) -> bool:
    return 5 * sum("㐀" <= c <= "鿿" for c in text) > len(text)


class Items:
    """The folded passages and their automaton."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        # Equal passages are looked for once.
        self.items: dict[int, list[int]] = {}
        self.passage: dict[int, str] = {}
        self.places: dict[int, list[int]] = {}
        first: dict[str, int] = {}
        for i, p in rows:
            plain = fold(p) if p else ""
            if not plain:
                continue
            if plain in first:
                self.items[first[plain]].append(i)
                continue
            first[plain] = i
            self.items[i], self.passage[i], self.places[i] = [i], plain, places(p.strip())
        self.han = {i: _han(p) for i, p in self.passage.items()}
        self.size = {i: min(HAN_WINDOW if self.han[i] else WINDOW, (len(p) + 1) // 2) for i, p in self.passage.items()}
        sharing: dict[str, set[int]] = defaultdict(set)
        for i, p in self.passage.items():
            for w in self._windows(i):
                sharing[w].add(i)
        #: Rare windows of each item, those of them that hold a digit, and how far a run of each could reach. Each has a
        #: number, in order of items and of places in them.
        patterns: dict[str, list[int]] = defaultdict(list)
        self.own: dict[int, set[int]] = {}
        self.digits: dict[int, set[int]] = {}
        self.order = list(self.passage)
        lows, highs, digit, owner, place = [], [], [], [], []
        for n, (i, p) in enumerate(self.passage.items()):
            size, windows = self.size[i], self._windows(i)
            shared = [len(sharing[w]) for w in windows]
            rare = max(RARE, sorted(shared)[(len(shared) - 1) // 2])
            own = [k for k, m in enumerate(shared) if m <= rare]
            self.own[i] = set(own)
            self.digits[i] = {k for k in own if any(c.isdigit() for c in windows[k])}
            for k in own:
                patterns[windows[k]].append(len(owner))
                owner.append(n)
                place.append(k)
                digit.append(k in self.digits[i])
            lows += [0, *(k + 1 for k in own[:-1])]
            highs += [*(k + size - 1 for k in own[1:]), len(p)]
        self.low, self.high, self.digit, self.owner, self.place = map(np.array, (lows, highs, digit, owner, place))
        self.least = np.array([self._least(i) for i in self.order])
        self.telling = np.array([OWN * len(self.digits[i]) or np.inf for i in self.order])
        #: The numbers of each pattern's windows, one pattern after the other.
        self.windows = np.array([w for where in patterns.values() for w in where], np.int64)
        self.first = np.cumsum([0, *map(len, patterns.values())])
        self.automaton = _automaton({w: n for n, w in enumerate(patterns)})
        #: How many stretches without digits each item has that holds digits.
        self.bare: dict[int, int] = {}
        parts: dict[int, list[tuple[str, int]]] = {}
        for i, p in self.passage.items():
            least = HAN_STRETCH if self.han[i] else STRETCH
            found = [m for m in _BARE.finditer(p) if m.end() - m.start() >= least]
            if len(found) > 1 and self.digits[i]:
                self.bare[i] = len(found)
                # The middle of the stretch, as what masks a number adds to its ends.
                middle = [(m.start() + m.end() - min(self.size[i], m.end() - m.start())) // 2 for m in found]
                parts[i] = [(p[k : k + min(self.size[i], m.end() - m.start())], k) for m, k in zip(found, middle)]
        # A part of a text without digits is too short for LEAST of most passages: shorter parts have automata of their own.
        lengths = sorted(int(self._least(i)) for i in parts)
        self.stretch = re.compile(r"\D{%d,}" % lengths[0]) if lengths else None
        self.stretches: list[tuple[float, ahocorasick.Automaton]] = []
        reach: float = lengths[0] if lengths else 0
        while lengths:
            reach = 1.5 * reach if reach < lengths[-1] else float("inf")
            held: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
            for i, found in parts.items():
                if self._least(i) <= reach:
                    for w, k in found:
                        held[w].append((len(w), i, k))
            self.stretches.append((reach, _automaton(held)))
            if reach == float("inf"):
                break
        self.steps: dict[int, dict[str, list[int]]] = {}

    def _windows(self, item: int) -> list[str]:
        p, size = self.passage[item], self.size[item]
        return [p[k : k + size] for k in range(len(p) - size + 1)]

    def _share(self, item: int, parts: list[tuple[int, int]]) -> float:
        """The share of the passage as it was written in rising parts of the folded one, with the blanks around them."""
        at, hidden, reach = self.places[item], 0, 0
        for a, b in parts:
            a, b = max(reach, at[a - 1] + 1 if a else 0), at[b]
            hidden += max(0, b - a)
            reach = max(reach, b)
        return hidden / at[-1]

    def _least(self, item: int) -> float:
        """Folded characters that runs must hold at least; a tenth less, as the blanks around them count as well."""
        return 0.9 * RUNS * len(self.passage[item])

    def _hits(self, plain: str) -> Iterator[tuple[int, list[tuple[int, int]], bool, bool]]:
        """(item, (place in the text, place in the passage) of its windows, whether runs and whether digits could do).

        Runs could if those with the windows found could make up RUNS of the passage, where a rare window that isn't
        found ends a run; digits if enough windows with a digit are there at all.
        """
        found = list(self.automaton.iter(plain)) if self.automaton else ()
        if not found:
            return
        ends, kinds = np.array(found).T
        counts = self.first[kinds + 1] - self.first[kinds]
        at = np.repeat(np.arange(len(kinds)), counts)
        number = self.windows[np.repeat(self.first[kinds] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        once = np.unique(number)
        owner, high = self.owner[once], self.high[once]
        before = np.where(owner[1:] == owner[:-1], high[:-1], 0)
        widths = high - np.maximum(self.low[once], np.concatenate([[0], before]))
        items = len(self.order)
        runs = np.bincount(owner, np.maximum(widths, 0), items) >= np.maximum(self.least, 1)
        digits = np.bincount(owner, self.digit[once], items) >= self.telling
        owners = self.owner[number]
        for n in np.flatnonzero(runs | digits):
            mine = owners == n
            i = self.order[n]
            places = (ends[at[mine]] - self.size[i] + 1).tolist()
            yield i, list(zip(places, self.place[number[mine]].tolist())), bool(runs[n]), bool(digits[n])

    def runs(self, item: int, plain: str, found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, start in the text) of each part of the passage that the text holds with a rare window, in order."""
        p, size = self.passage[item], self.size[item]
        out: list[tuple[int, int, int]] = []
        done = at_done = 0
        for k, at in _rising([(k, at) for at, k in found]):
            if out and at - k == out[-1][2] - out[-1][0] and k + size <= done:
                continue
            a, b = k, k + size
            while a > done and at - (k - a) > at_done and p[a - 1] == plain[at - (k - a) - 1]:
                a -= 1
            while b < len(p) and at + b - k < len(plain) and p[b] == plain[at + b - k]:
                b += 1
            out.append((a, b, at - (k - a)))
            done, at_done = b, at + b - k
        # Long texts hold many short phrases of any passage.
        long, telling = min(LONG * size, LONG_SHARE * len(p)), self.digits[item]
        out = [r for r in out if r[1] - r[0] >= long or any(k in telling for k in _whole_numbers(p, plain, *r, size))]
        gaps = [len(plain), *(n[2] - (r[2] + r[1] - r[0]) for r, n in zip(out, out[1:])), len(plain)]
        return [r for r, *gap in zip(out, gaps, gaps[1:]) if r[1] - r[0] >= SOLE * size or min(gap) <= len(p)]

    def substrings(self, item: int) -> tuple[int, dict[str, list[int]]]:
        size = HAN_STEP if self.han[item] else STEP
        if item not in self.steps:
            p, found = self.passage[item], defaultdict(list)
            for k in range(len(p) - size, -1, -1):
                found[p[k : k + size]].append(k)
            self.steps[item] = found
        return size, self.steps[item]

    def covered(self, item: int, region: str) -> tuple[float, int, int]:
        """The share of the passage that substrings in the passage's order cover, and where they begin and end."""
        size, at = self.substrings(item)
        # Of one place in the region the later positions come first, so that it takes part once.
        chain = _rising([(i, j) for j in range(len(region) - size + 1) for i in at.get(region[j : j + size], ())])
        if not chain:
            return 0.0, 0, 0
        return self._share(item, [(i, i + size) for i, _ in chain]), chain[0][1], chain[-1][1] + size

    def in_text(self, text: str) -> Iterator[tuple[int, float, int, int]]:
        """(item, share, start, end) of each item of which the text holds enough, with original offsets."""
        plain = fold(text)
        shown: dict[int, tuple[float, int, int]] = {}
        for i, found, runs, digits in self._hits(plain):
            hit = (runs and self._by_runs(i, plain, found)) or (digits and self._by_digits(i, plain, found))
            if hit:
                shown[i] = hit
        for m in self.stretch.finditer(plain) if self.stretch else ():
            for i, hit in self._by_stretches(plain, *m.span()):
                shown.setdefault(i, hit)
        if shown:
            origin = places(text)
            for i, (share, a, b) in shown.items():
                for item in self.items[i]:
                    yield item, share, origin[a], origin[b - 1] + 1

    def _by_stretches(self, plain: str, begin: int, stop: int) -> list[tuple[int, tuple[float, int, int]]]:
        """Items whose stretches between numbers follow each other in a part of the text without numbers."""
        automaton = next(a for reach, a in self.stretches if stop - begin <= reach)
        hits = list(automaton.iter(plain, begin, stop))
        if len(hits) < 2:
            return []
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, where in hits:
            for size, i, k in where:
                found[i].append((k, end - size + 1))
        out = []
        for i, pairs in found.items():
            least = max(2, STRETCHES * self.bare[i])
            if len(pairs) < least:
                continue
            chain = _rising(pairs)
            if len(chain) < least:
                continue
            low = max(0, chain[0][1] - 2 * chain[0][0] - self.size[i])
            high = chain[-1][1] + 2 * (len(self.passage[i]) - chain[-1][0])
            share, a, b = self.covered(i, plain[low:high])
            if share >= LEAST:
                out.append((share, i, low + a, low + b))
        out.sort(reverse=True)
        kept: list[tuple[float, int, int, int]] = []
        for share, i, a, b in out:
            if all(share >= s - NEAR or b <= c or d <= a for s, _, c, d in kept):
                kept.append((share, i, a, b))
        return [(i, (share, a, b)) for share, i, a, b in kept]

    def _by_runs(self, i: int, plain: str, found: list[tuple[int, int]]) -> tuple[float, int, int] | None:
        runs = self.runs(i, plain, found)
        share = self._share(i, [(a, b) for a, b, _ in runs])
        if share >= LEAST:
            return share, runs[0][2], runs[-1][2] + runs[-1][1] - runs[-1][0]
        if share < RUNS:
            return None
        # The text around the runs, as far as the passage up to the runs before and after, and a window more, would reach.
        near: list[list[int]] = []
        before = [0, *(b for _, b, _ in runs[:-1])]
        after = [*(a for a, _, _ in runs[1:]), len(self.passage[i])]
        for (a, b, at), c, d in zip(runs, before, after):
            low, high = max(0, at - (a - c) - self.size[i]), min(len(plain), at + (b - a) + (d - b) + self.size[i])
            if near and low <= near[-1][1]:
                near[-1][1] = max(high, near[-1][1])
            else:
                near.append([low, high])
        spots = [k for low, high in near for k in range(low, high)]
        share, a, b = self.covered(i, "".join(plain[low:high] for low, high in near))
        return (share, spots[a], spots[b - 1] + 1) if share >= LEAST else None

    def _by_digits(self, i: int, plain: str, found: list[tuple[int, int]]) -> tuple[float, int, int] | None:
        least, length = OWN * len(self.digits[i]), len(self.passage[i])
        found = [(at, k) for at, k in found if k in self.digits[i]]
        if len(found) < least:
            return None
        count, low, high = _densest(found, SPREAD * length)
        if count < least:
            return None
        # As far around as the rest of the passage would reach.
        low, high = max(0, low - length), high + length
        share, a, b = self.covered(i, plain[low:high])
        return (share, low + a, low + b) if share >= LEAST else None


def _automaton(patterns: dict) -> ahocorasick.Automaton | None:
    if not patterns:
        return None
    out = ahocorasick.Automaton()
    for w, value in patterns.items():
        out.add_word(w, value)
    out.make_automaton()
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (place in the passage, place in the text), given by place in the text, that rises in both."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (i, _) in enumerate(pairs):
        k = bisect_left(tops, i)
        before.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(i)
            ends.append(n)
        else:
            tops[k] = i
            ends[k] = n
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    chain.reverse()
    return chain


def _whole_numbers(p: str, plain: str, a: int, b: int, at: int, size: int) -> range:
    """Places of the windows of a run that lie between numbers which only begin or end alike in passage and text."""
    end = at + b - a
    if p[a].isdigit() and (p[a - 1 : a].isdigit() or plain[at - 1 : at].isdigit()):
        while a < b and p[a].isdigit():
            a += 1
    if p[b - 1].isdigit() and (p[b : b + 1].isdigit() or plain[end : end + 1].isdigit()):
        while a < b and p[b - 1].isdigit():
            b -= 1
    return range(a, b - size + 1)


def _densest(found: list[tuple[int, int]], reach: int) -> tuple[int, int, int]:
    """The most different windows that begin within ``reach`` characters of a text, and where these begin and end."""
    best, inside, first = (0, 0, 0), Counter(), 0
    for at, k in found:
        inside[k] += 1
        while found[first][0] < at - reach:
            left = found[first][1]
            inside[left] -= 1
            if not inside[left]:
                del inside[left]
            first += 1
        if len(inside) > best[0]:
            best = len(inside), found[first][0], at
    return best


@lru_cache(2)
def _items(rows: tuple[tuple[int, str], ...]) -> Items:
    """The items of a block, made once in each worker."""
    return Items(list(rows))


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, share, start, end) of each document and each item that it reveals."""
    given = items.select("item_id", "passage").filter(F.col("passage").isNotNull()).distinct()
    rows = sorted((r.item_id, r.passage) for r in given.toLocalIterator())
    blocks = [rows[k : k + ITEMS] for k in range(0, len(rows), ITEMS)] or [[]]
    docs = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    out = None
    for block in blocks:

        def scan(frames: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            known = _items(tuple(block))
            for pdf in frames:
                found = [
                    (d, *hit)
                    for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist())
                    for hit in known.in_text(t)
                ]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "share", "start", "end"])

        part = docs.mapInPandas(scan, "doc_id bigint, item_id bigint, share double, start int, end int")
        out = part if out is None else out.unionByName(part)
    return out
