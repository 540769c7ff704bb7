"""Cutting documents into chunks for retrieval: fixed, by headings, by separators, parent and child.

The order-dependent packing runs in Arrow batches of whole documents; a document is never split over tasks, and tasks
hold one batch of documents at a time. Null and blank texts give no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ["\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ", " ", ""]
HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
NUMBERED = re.compile(r"^(?:#{1,6}|\d+[.)])[^\S\n]+(.+)$", re.M)
# What lines of Markdown have, and how much it counts.
MARKS = [(2, re.compile(r"^#{1,6}\s+")), (2, re.compile(r"^```")), (1, re.compile(r"\[.*?\]\(.*?\)")), (1, re.compile(r"^[-*+]\s+")), (1, re.compile("^>"))]


def chunked(df: DataFrame, key: str, text: str, cut: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """(key, chunk_no, path, chunk) with the chunks that ``cut`` gives as (path, chunk)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(k, n, path, chunk) for k, t in zip(pdf["key"], pdf["text"]) for n, (path, chunk) in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=["key", "chunk_no", "path", "chunk"])

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL AND trim(text) <> ''")
    return rows.mapInPandas(run, f"key {kind}, chunk_no int, path string, chunk string").withColumnRenamed("key", key)


def fixed(text: str, size: int = 500, overlap: int = 50, separator: str = "\n\n") -> list[tuple[str, str]]:
    """Paragraphs packed up to ``size``; the next chunk begins with the tail of the last. Long paragraphs are sliced.

    Every chunk is a slice of the paragraphs joined: a run of neighbours, reaching back by the overlap into the run
    before unless a sliced paragraph lies between.
    """
    parts = [p.strip() for p in text.split(separator) if p.strip()]
    joined = separator.join(parts)
    ends = list(accumulate(parts, lambda end, p: end + len(separator) + len(p), initial=-len(separator)))[1:]
    spans: list[tuple[int, int]] = []
    grows = False
    for end, length in zip(ends, map(len, parts)):
        begin = end - length
        if length > size:
            spans += [(k, min(k + size, end)) for k in range(begin, end, max(1, size - overlap))]
            grows = False
            continue
        if grows and spans[-1][1] - spans[-1][0] + length + 1 <= size:
            spans[-1] = spans[-1][0], end
            continue
        last = spans[-1] if grows else (0, 0)
        spans.append((last[1] - overlap if 0 < overlap < last[1] - last[0] else begin, end))
        grows = True
    return [("", joined[a:b]) for a, b in spans]


def smart(text: str, size: int = 500, overlap: int = 50, least: int = 100) -> list[tuple[str, str]]:
    """Paragraphs packed within each part below a Markdown or numbered heading, small chunks joined with a neighbour,
    and each begun with the tail of the one before and dots."""
    heads = [(m.start(), m[1].strip()) for m in NUMBERED.finditer(text)]
    begins = [0, *(at for at, _ in heads)]
    named = zip(["", *(h for _, h in heads)], begins, [*begins[1:], len(text)])
    packed: list[tuple[str, str]] = []
    for head, a, b in named:
        for p in filter(None, (p.strip() for p in text[a:b].split("\n\n"))):
            room = bool(packed) and packed[-1][0] == (head, a) and len(p) <= size and len(packed[-1][1]) + len(p) + 2 <= size
            if room:
                packed[-1] = packed[-1][0], f"{packed[-1][1]}\n\n{p}"
            else:
                packed += [((head, a) if len(p) <= size else (head, a, k), p[k : k + size]) for k in range(0, len(p), size)]
    joined: list[tuple[str, str]] = []
    for (head, *_), chunk in packed:
        if joined and min(len(joined[-1][1]), len(chunk)) < least and len(joined[-1][1]) + 2 + len(chunk) <= size:
            # The heading is that of the larger part.
            kept = joined[-1][0] if len(joined[-1][1]) >= least else head
            joined[-1] = kept, f"{joined[-1][1]}\n\n{chunk}"
        else:
            joined.append((head, chunk))
    out: list[tuple[str, str]] = []
    for head, chunk in joined:
        out.append((head, f"{out[-1][1][-overlap:]}...{chunk}" if out and overlap > 0 else chunk))
    return out


def recursive(text: str, size: int = 500, overlap: int = 50, separators: list[str] | None = None) -> list[str]:
    """Split by the coarsest separator that occurs, and parts that are still too long by the next; then packed."""
    rest = SEPARATORS if separators is None else separators
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in rest if s and s in text), "")
    if not sep:
        return [text[k : k + size] for k in range(0, len(text), max(1, size - overlap))]
    parts = [p + sep for p in text.split(sep)]
    parts[-1] = parts[-1][: -len(sep)]
    out, held = [], ""
    for p in filter(None, parts):
        if len(p) > size:
            if held.strip():
                out.append(held)
            held = ""
            out += recursive(p, size, overlap, rest[rest.index(sep) + 1 :])
        elif len(held) + len(p) > size:
            out.append(held)
            tail = held[-overlap:] if overlap and len(p) + overlap <= size else ""
            held = tail + p
        else:
            held += p
    return [*out, *([held] if held.strip() else [])]


def sections(text: str, depth: int = 4) -> list[tuple[list[str], str]]:
    """(heading path, body) of each part between headings down to ``depth``; headings in code fences don't count."""
    out: list[tuple[list[str], list[str]]] = [([], [])]
    path: list[str] = []
    fenced = False
    for line in text.splitlines():
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else HEADING.match(line)
        if m and len(m[1]) <= depth:
            path = [*path[: len(m[1]) - 1], m[2].strip()]
            out.append((path, []))
        else:
            out[-1][1].append(line)
    return [(p, "\n".join(b).strip()) for p, b in out if "\n".join(b).strip()]


def by_headings(text: str, size: int = 500, overlap: int = 50, depth: int = 4) -> list[tuple[str, str]]:
    """Sections between headings, with their path; long ones are cut further."""
    return [(" > ".join(p), c) for p, body in sections(text, depth) for c in recursive(body, size, overlap)]


def auto(text: str) -> list[tuple[str, str]]:
    """By headings where the first lines look like Markdown, else by separators. The score is ``text.markdown_score``."""
    lines = [x.strip() for x in text.split("\n")[:50]]
    score = sum(n for x in lines for n, found in MARKS if found.search(x))
    return by_headings(text) if score >= 3 else [("", c) for c in recursive(text)]


BLOCK = re.compile(r"```[\s\S]*?(?:```|$)|(?:^\|.*\|[ \t]*$\n?)+", re.M)


def parent_child(text: str, parent: int = 1500, child: int = 300, overlap: int = 50) -> list[tuple[str, str]]:
    """Children as (parent number and kind, text): sections at heading depth 2 are parents, tables and code own children."""
    out = []
    number = -1
    for path, body in sections(text, 2):
        for part in recursive(body, parent, 0):
            number += 1
            prefix = " > ".join(path)
            at = 0
            for m in BLOCK.finditer(part):
                out += [(f"p{number}:text", c) for c in recursive(part[at : m.start()], child, overlap)]
                kind = "code" if m[0].startswith("```") else "table"
                out.append((f"p{number}:{kind}", f"{prefix}\n{m[0].strip()}" if prefix else m[0].strip()))
                at = m.end()
            out += [(f"p{number}:text", c) for c in recursive(part[at:], child, overlap)]
    return out
