"""Files as rows of elements: decoding, Markdown, plain text, front matter; logs and label sets.

A file's elements keep their order in ``pos``. Empty files have none. Undecodable bytes are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ["utf-8", "gbk", "gb2312", "gb18030", "latin-1"]
ELEMENT = "pos int, element_type string, text string, heading_path array<string>"
_LIST = re.compile(r"^\s*(?:[-*+•]|\d+[.)、])\s+")
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_RULE = re.compile(r"^\|[\s:|-]+\|?$")


def decoded(content: bytes) -> str:
    """The text of a file, by the first encoding that fits."""
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "ignore")


def markdown_elements(text: str) -> Iterator[tuple[str, str, list[str]]]:
    """(type, text, heading path) of each element: fences, headings, tables, list items, one paragraph per line."""
    path: list[str] = []
    lines = text.splitlines()
    at = 0
    while at < len(lines):
        line = lines[at].strip()
        at += 1
        if line.startswith("```"):
            body = []
            while at < len(lines) and not lines[at].strip().startswith("```"):
                body.append(lines[at])
                at += 1
            at += 1
            code = "\n".join(body)
            if code.strip():
                language = line[3:].strip()
                yield "code", f"# language: {language}\n{code}" if language else code, path
        elif m := _HEADING.match(line):
            path = [*path[: len(m[1]) - 1], m[2].strip()]
            yield "heading", line, path
        elif line.startswith("|") and at < len(lines) and "---" in lines[at] and _RULE.match(lines[at].strip()):
            rows = [line]
            while at < len(lines) and lines[at].strip().startswith("|"):
                rows.append(lines[at].strip())
                at += 1
            yield "table", "\n".join(rows), path
        elif line:
            yield ("list" if _LIST.match(line) else "paragraph"), line, path


def plain_elements(text: str) -> Iterator[tuple[str, str, list[str]]]:
    """Paragraphs between empty lines; one that holds a list item becomes one list element per line."""
    for part in re.split(r"\n\s*\n", text):
        lines = [x.strip() for x in part.splitlines() if x.strip()]
        if any(_LIST.match(x) for x in lines):
            yield from (("list", x, []) for x in lines)
        elif lines:
            yield "paragraph", "\n".join(lines), []


#: The parser of each file extension; further ones can be put in.
PARSERS = {"md": markdown_elements, "markdown": markdown_elements, "txt": plain_elements, "log": plain_elements}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, element_type, text, heading_path) of the files under a path. Files without a parser are refused."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return elements_of(files.select("path", "content"), "path", "content")


def parser_of(name: str):
    """The parser of a file by its extension."""
    ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ending not in PARSERS:
        raise ValueError(f"no parser for {name!r}; there are ones for {', '.join(sorted(PARSERS))}")
    return PARSERS[ending]


def elements_of(df: DataFrame, name: str, content: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for n, c in zip(pdf["name"], pdf["content"]):
                text = c if isinstance(c, str) else decoded(bytes(c))
                parser = parser_of(n)
                rows += [(n, k, kind, part, list(path)) for k, (kind, part, path) in enumerate(parser(text))]
            yield pd.DataFrame(rows, columns=["path", "pos", "element_type", "text", "heading_path"])

    rows = df.select(F.col(name).alias("name"), F.col(content).alias("content")).dropna()
    return rows.mapInPandas(run, f"path string, {ELEMENT}")


def front_matter(text: Column) -> Column:
    """The ``key: value`` lines between ``---`` marks at the head of a text, as a map."""
    head = F.regexp_extract(text, r"^---\s*\n([\s\S]*?)\n---\s*(?:\n|$)", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*:\s*\S"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.regexp_extract(x, r"^\s*([\w-]+)\s*:", 1).alias("k"), F.regexp_extract(x, r"^\s*[\w-]+\s*:\s*[\"']?(.*?)[\"']?\s*$", 1).alias("v")
        ),
    )
    return F.map_from_entries(pairs)


# Fields of front matter that documents are known by.
BUSINESS_FIELDS = ["doc_type", "service", "severity", "incident_id", "root_cause", "resolution", "occurred_at", "tags", "source", "valid_until", "effective_date"]


def business_fields(matter: Column) -> Column:
    """Those of a map's entries that are known fields with a value."""
    return F.map_filter(matter, lambda k, v: k.isin(BUSINESS_FIELDS) & (F.trim(v) != ""))


# How pages are numbered.
PAGE_NUMBER = r"^(?:\d+|第\s*\d+\s*页|Page\s+\d+|-\s*\d+\s*-|\d+\s*/\s*\d+|第\s*\d+\s*页\s*共\s*\d+\s*页)$"


def furniture(blocks: DataFrame) -> DataFrame:
    """blocks (file_id, pos, text, page_number) with ``reason``: page number, repeated on at least half of the pages of
    its file and twice, or body."""
    text = F.trim("text")
    pages = blocks.groupBy("file_id").agg(F.count_distinct("page_number").alias("__pages"))
    times = blocks.groupBy("file_id", text.alias("__t")).agg(F.count("*").alias("__n"))
    joined = blocks.withColumn("__t", text).join(pages, "file_id").join(times, ["file_id", "__t"])
    often = F.col("__n") >= F.greatest(F.lit(2), F.floor(F.col("__pages") / 2))
    return joined.withColumn("reason", F.when(F.col("__t").rlike(PAGE_NUMBER), "page number").when(often, "repeated").otherwise("body")).drop("__t", "__n", "__pages")


_STARTS = r"^(?:\d+[.)]|[一二三四五六七八九十]+[、.]|第[一二三四五六七八九十\d]+[章节部分]|[A-Z]|[•·▪]|[-*+]\s)"


def goes_on(before: Column, now: Column, at_top: Column) -> Column:
    """Whether a block continues the paragraph of the block before it on the page before: it isn't at the top of the body,
    the one before doesn't end like a sentence, and it doesn't begin like a paragraph."""
    open_ = ~F.rtrim(before).rlike(r"[。！？.!?：:\"”）)]\z")
    return F.coalesce(~at_top & open_ & (F.trim(now) != "") & ~F.trim(now).rlike(_STARTS), F.lit(False))


# Words that tell a document's type, in order; the first six count in the body too.
TYPE_RULES = [
    ("postmortem", "postmortem"), ("复盘", "postmortem"), ("incident", "incident"), ("inc-", "incident"), ("事故", "incident"),
    ("sop", "sop"), ("预案", "sop"), ("runbook", "sop"), ("manual", "manual"), ("手册", "manual"), ("运维", "manual"),
    ("架构", "manual"), ("api", "manual"), ("部署", "manual"),
]
SERVICE = r"(?:^|[^a-zA-Z0-9_])([a-z][a-z0-9-]{2,30}-(?:service|api|gateway|db|mysql|redis|worker|job))(?:$|[^a-zA-Z0-9_])"


def inferred_type(title: Column, body: Column, head: int = 2000) -> Column:
    """A document's type by words of its title, else by the strong ones at the head of its body; null if none occurs."""
    name, start = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.substring(F.coalesce(body, F.lit("")), 1, head))
    out = F.lit(None).cast("string")
    for word, kind in reversed(TYPE_RULES[:6]):
        out = F.when(F.contains(start, F.lit(word)), kind).otherwise(out)
    for word, kind in reversed(TYPE_RULES):
        out = F.when(F.contains(name, F.lit(word)), kind).otherwise(out)
    return out


def inferred_service(title: Column, body: Column, head: int = 2000) -> Column:
    """The first service name in the title, else at the head of the body; null if there is none."""
    first = lambda c: F.nullif(F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), SERVICE, 1), F.lit(""))
    return F.coalesce(first(title), first(F.substring(body, 1, head)))


def table_html(text: Column) -> Column:
    """A pipe table as HTML; its second row, the separator, is left out."""
    cells = lambda row: F.split(F.regexp_replace(row, r"^\s*\||\|\s*$", ""), r"\|")
    one = lambda tag: lambda c: F.concat(F.lit(f"<{tag}>"), F.trim(c), F.lit(f"</{tag}>"))
    rows = F.split(F.trim(text), "\n")
    line = lambda row, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells(row), one(tag)), ""), F.lit("</tr>"))
    body = F.transform(F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(0))), lambda r: line(r, "td"))
    return F.concat(F.lit("<table>"), line(F.element_at(rows, 1), "th"), F.array_join(body, ""), F.lit("</table>"))


def flat_alerts(deliveries: DataFrame) -> DataFrame:
    """Alert items with their labels and annotations as columns, status and fingerprint in normal form."""
    plain = lambda c: F.nullif(F.lower(F.btrim(F.col(c), F.lit(" \t"))), F.lit(""))
    label = lambda name: F.try_element_at("labels", F.lit(name)).alias(name)
    return deliveries.select(
        "delivery_id", plain("status").alias("status"), plain("fingerprint").alias("fingerprint"), *map(label, ("service", "severity", "alertname", "instance")),
        F.try_element_at("annotations", F.lit("summary")).alias("summary"),
    )


def severity_rank(severity: Column) -> Column:
    """0 for critical, 1 for warning, 2 for info, 3 for anything else."""
    return F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(3)


def alert_key(fingerprint: Column, alertname: Column, instance: Column) -> Column:
    """What an alert is known by: its fingerprint, or its name and instance where it has none."""
    named = F.concat(F.coalesce(alertname, F.lit("")), F.lit(":"), F.coalesce(instance, F.lit("")))
    return F.when(fingerprint.isNotNull(), F.concat(F.lit("fp:"), fingerprint)).otherwise(named)


LEVEL = "(ERROR|WARNING|WARN|INFO|DEBUG|TRACE)"


def log_level(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, LEVEL, 1), F.lit(""))


def log_filter(line: Column, query: str) -> Column:
    """The line filters of a log query, ``|= "x" != "y" |~ "re" !~ "re"``, as a column; a null line passes none."""
    out = line.isNotNull()
    for op, value in re.findall(r'(\|=|!=|\|~|!~)\s*"((?:[^"\\]|\\.)*)"', query):
        found = line.rlike(value) if "~" in op else F.contains(line, F.lit(value))
        out = out & (~found if op[0] == "!" else found)
    return out
