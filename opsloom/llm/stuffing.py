"""Pages of repeated keywords, links or product tags in place of sentences.

Two signals are measured and weighed together. The first is how much of a page repeated maximal substrings cover. The
second is clause structure, told from the shape of the text and from no list of words: sentences of any language go on
to new words, so that most of the words in a stretch of running text differ, while keywords come back. Characters count
as stuffing that stand in a run of text without clause structure and are covered by a repeated maximal substring or by
a link; a page of which they are more than half comes out. Tables, logs and closed code blocks are never stuffing.

Coverage is measured on every page first. Each character that a repeated maximal substring of at least m characters
covers is covered by a repeated substring of exactly m, and the other way round, so this coverage, which is the suffix
automaton's, is found by comparing all substrings of m characters in one array: exact, and in proportion to the page.
No more than it can be stuffing, so a page of which it is at most half is done. Of the others the runs without clause
structure are put into a suffix automaton, whose repeated maximal substrings decide.

Defined results: null, empty and blank texts, and texts of one repeated character, have no stuffing. Shares count the
characters that aren't blanks; digits count as alike. Copies of a page, and repeated rows, are each judged alike. Pages of any length are
judged whole; a run of text too long for an automaton in memory is measured by the comparison of substrings, which
gives the same coverage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a page above which stuffing makes it come out.
LEAST = 0.5
#: Least characters of a repeated substring that counts: in Han script (from this share of a page on), and otherwise.
HAN_SUBSTRING, SUBSTRING, HAN_SHARE = 4, 8, 0.2
#: Words of running text around a unit, and the share of different ones among them up to which it has no clause structure.
AROUND, DIFFERENT = 40, 0.6
#: A sentence has at least so many words and a stop; more than so many of them differ; and so many stand between two commas.
SENTENCE, OWN_DIFFERENT, BETWEEN = 8, 0.7, 3
#: Characters of a long word in Han script, and words that two neighbours of it stand for.
HAN_WORD, HAN_NEIGHBOURS = 4, 0.6
#: Most characters in one automaton.
BLOCK = 200_000

_FENCE = re.compile(r"^\s*(```|~~~)")
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_RULE = re.compile(r"^\s*\|(?:\s*:?-{2,}:?\s*\|)+\s*$")
_CELL = re.compile(r"[^\W\d_㐀-鿿]{3,}|[㐀-鿿]{2,}")
_STAMP = re.compile(r"\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d|[A-Z][a-z]{2} [ \d]\d \d\d:\d\d|\d\d/[A-Z][a-z]{2}/\d{4}:\d\d")
_LEVEL = re.compile(r"^\W*(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|FATAL)\b")
_FIELD = re.compile(r"\b(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|FATAL)\b|\b[\w.]+=\S|\w\[\d+\]:|\"(?:GET|PUT|POST|HEAD|DELETE) ")
_CUT = re.compile(r"(?<=[.!?。！？；])(?=\s|[㐀-鿿]|$)|(?<=[.!?])\s+")
_URL = re.compile(r"(?:https?://|www\.)[^\s)\]>\"']+|</?[a-zA-Z][^>]*>")
_WORD = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+(?:['’][^\W\d_㐀-鿿]+)*")
# The same in ASCII letters, all small.
_ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")
_STOP = re.compile(r"[.!?。！？][\"'”’»)\]」』）]*\s*$")
_COMMA = re.compile(r"[,，、;；|/»·]")
_HAN = re.compile(r"[㐀-鿿]")


def han(text: str) -> bool:
    return len(_HAN.findall(text)) > HAN_SHARE * len(text)


def blocks(lines: list[str]) -> list[bool]:
    """Which lines belong to a closed code block, a table or a log."""
    out = [False] * len(lines)
    fences = [k for k, line in enumerate(lines) if _FENCE.match(line)]
    for a, b in zip(fences[::2], fences[1::2]):
        out[a : b + 1] = [True] * (b + 1 - a)
    # An opening fence that nothing closes is a line like others.
    k = 0
    while k < len(lines):
        if out[k] or not _ROW.match(lines[k]):
            out[k] = out[k] or _is_log(lines[k])
            k += 1
            continue
        n = k
        while n < len(lines) and not out[n] and _ROW.match(lines[n]):
            n += 1
        out[k:n] = [_is_table(lines[k:n])] * (n - k)
        k = n
    return out


def _is_log(line: str) -> bool:
    return bool(_LEVEL.match(line)) or bool(_STAMP.search(line, 0, 60) and _FIELD.search(line))


def _is_table(rows: list[str]) -> bool:
    """Whether rows of cells have a rule below their head, or figures and codes in a good part of the cells."""
    if any(_RULE.match(r) for r in rows):
        return True
    cells = [c for r in rows for c in r.strip().strip("|").split("|")]
    return 3 * sum(not _CELL.search(c) for c in cells) >= len(cells)


def units(text: str) -> list[tuple[bool, int, int]]:
    """(whether it is in a block, start, end) of each sentence or other run of text in a line."""
    out, at = [], 0
    lines = text.splitlines(keepends=True)
    for line, block in zip(lines, blocks(lines)):
        if block:
            out.append((True, at, at + len(line)))
        elif not line.isspace():
            ends = [m.end() for m in _CUT.finditer(line) if 0 < m.end() < len(line)]
            out += [(False, at + a, at + b) for a, b in zip([0, *ends], [*ends, len(line)])]
        at += len(line)
    return out


def words(unit: str) -> list[str]:
    """The words of a unit without its links. Han script has no blanks: a run longer than a word gives every two neighbours."""
    plain = _URL.sub(" ", unit) if "/" in unit or "<" in unit or "www." in unit else unit
    if plain.isascii():
        return _ASCII_WORD.findall(plain.lower())
    if not _HAN.search(plain):
        return [w.lower() for w in _WORD.findall(plain)]
    out = []
    for w in _WORD.findall(plain):
        if "㐀" <= w[0] <= "鿿":
            out += [w[k : k + 2] for k in range(len(w) - 1)] if len(w) > HAN_WORD else [w]
        else:
            out.append(w.lower())
    return out


def is_sentence(unit: str, own: list[str]) -> bool:
    """Whether a unit is a sentence by itself, even if the next one differs from it in a few words only."""
    # Two neighbours in Han script are a little over half a word.
    size = HAN_NEIGHBOURS * len(own) if _HAN.search(unit) else len(own)
    return (
        size >= SENTENCE
        and bool(_STOP.search(unit))
        and len(set(own)) > OWN_DIFFERENT * len(own)
        and size >= BETWEEN * (1 + len(_COMMA.findall(unit)))
    )


def bare_units(text: str) -> list[tuple[int, int]]:
    """Start and end of each unit without clause structure."""
    found = [(a, b, words(text[a:b])) for block, a, b in units(text) if not block]
    running = [w for *_, own in found for w in own]
    out, at = [], 0
    for a, b, own in found:
        size = max(AROUND, len(own))
        low = max(0, min(at + len(own) // 2 - size // 2, len(running) - size))
        near = running[low : low + size]
        # Without words, only links tell.
        if len(set(near)) <= DIFFERENT * len(near) and not is_sentence(text[a:b], own) if own else _URL.search(text, a, b):
            out.append((a, b))
        at += len(own)
    return out


def code_points(text: str) -> np.ndarray:
    """The characters of a text as numbers."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def repeated(codes: np.ndarray, least: int) -> np.ndarray:
    """Which characters are covered by substrings of at least ``least`` (4 or 8) characters that occur again."""
    if len(codes) <= least:
        return np.zeros(len(codes), bool)
    if least == 8 and codes.max() < 256:
        names = _packed(codes.astype(np.uint8))
    else:
        # Numbers for the characters of the page, then for its substrings of four, then for pairs of these.
        if codes.max() >= 1 << 16:
            codes = np.unique(codes, return_inverse=True)[1]
        names = _packed(codes.astype(np.uint16)) if codes.max() < 1 << 16 else _pairs(_pairs(codes, 1), 2)
        if least == 8:
            names = _pairs(np.unique(names, return_inverse=True)[1], 4)
    order = np.argsort(names)
    ranked = names[order]
    again = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(names), bool)
    twice[order[1:]] = again
    twice[order[:-1]] |= again
    change = np.zeros(len(codes) + 1, np.int32)
    change[: len(names)] += twice
    change[least : least + len(names)] -= twice
    return np.cumsum(change[:-1]) > 0


def _packed(codes: np.ndarray) -> np.ndarray:
    """All substrings of as many codes as fit 64 bits, each as one number."""
    size = 8 // codes.itemsize
    return np.ndarray((len(codes) - size + 1,), "<u8", codes.tobytes(), strides=(codes.itemsize,)).copy()


def _pairs(names: np.ndarray, apart: int) -> np.ndarray:
    """Numbers for the pairs of substrings that follow each other, from numbers for these."""
    both = names[:-apart].astype(np.uint64) << np.uint64(32) | names[apart:].astype(np.uint64)
    return np.unique(both, return_inverse=True)[1]


def repeats(text: str) -> list[int]:
    """For each position, the length of the longest substring ending there that occurs elsewhere in the text too."""
    # The suffix automaton: of each state the length of its longest substring, its link, and where it leads.
    length, link, leads = [0], [-1], [{}]
    last, states, ends = 0, 1, []
    for c in text:
        new = states
        states += 1
        reach = length[last] + 1
        length.append(reach)
        leads.append({})
        at = last
        while at >= 0:
            on = leads[at]
            if c in on:
                break
            on[c] = new
            at = link[at]
        if at < 0:
            link.append(0)
        else:
            to = on[c]
            reach = length[at] + 1
            if reach == length[to]:
                link.append(to)
            else:
                copy = states
                states += 1
                link.append(copy)
                length.append(reach)
                link.append(link[to])
                leads.append(leads[to].copy())
                while on.get(c) == to:
                    on[c] = copy
                    at = link[at]
                    if at < 0:
                        break
                    on = leads[at]
                link[to] = copy
        last = new
        ends.append(new)
    # The substrings of a state occur again if another state links to it; and those of a link always do.
    again = bytearray(states)
    for s in link[1:]:
        again[s] = 1
    return [length[s] if again[s] else length[link[s]] for s in ends]


def covered(text: str, least: int) -> np.ndarray:
    """Which characters repeated maximal substrings of at least ``least`` characters cover, by the suffix automaton."""
    if len(text) > BLOCK:
        return repeated(code_points(text), least)
    found = np.array(repeats(text), np.int64)
    ends = np.flatnonzero(found >= least)
    change = np.bincount(ends - found[ends] + 1, minlength=len(text) + 1) - np.bincount(ends + 1, minlength=len(text) + 1)
    return np.cumsum(change[:-1]) > 0


def stuffed(text: str | None) -> tuple[float, float]:
    """(share of the page that repeats and links cover, share of it that is stuffing)."""
    if not text or text.isspace():
        return 0.0, 0.0
    codes = code_points(text)
    shown = codes > 32
    if codes.max() >= 0x80:
        shown &= _SHOWN[np.minimum(codes, len(_SHOWN) - 1)]
    whole = int(shown.sum())
    if not whole or (codes[shown] == codes[shown][0]).all():
        return 0.0, 0.0
    least = HAN_SUBSTRING if han(text) else SUBSTRING
    marks = repeated(np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes), least)
    links = np.zeros(len(codes), bool)
    if "://" in text or "www." in text or "</" in text:
        for m in _URL.finditer(text):
            links[m.start() : m.end()] = True
    reach = float(((marks | links) & shown).sum() / whole)
    if reach <= LEAST:
        return reach, 0.0
    bare = bare_units(text)
    if sum(int(shown[a:b].sum()) for a, b in bare) <= LEAST * whole:
        return reach, 0.0
    spots = np.concatenate([np.arange(a, b) for a, b in bare])
    hits = covered("".join(text[a:b] for a, b in bare).translate(_DIGITS), least) | links[spots]
    return reach, float((hits & shown[spots]).sum() / whole)


# Prices and numbers of products are alike.
_DIGITS = str.maketrans("123456789", "0" * 9)
# The blanks beyond ASCII.
_BLANKS = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_SHOWN = np.ones(_BLANKS.max() + 2, bool)
_SHOWN[_BLANKS] = False


def judged(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, covered_share, stuffed_share) of each row of df."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            shares = [stuffed(t) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "bare": [b for b, _ in shares], "share": [s for _, s in shares]})

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    found = rows.mapInPandas(judge, "key bigint, bare double, share double")
    return found.select(F.col("key").alias(key), F.col("bare").alias("covered_share"), F.col("share").alias("stuffed_share"))
