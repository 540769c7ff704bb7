"""Chunks of parsed files: elements in order, with type, heading path and page, to parents and children.

Filters, table merging and sections are windows over each file's elements. Packing depends on what was packed before,
so it runs over each file's elements as a sorted stream that holds one chunk at a time; no file is gathered.

Elements are rows (file_id, pos, element_type, text, heading_path, page_number); types are compared without case and
surrounding blanks. Null texts count as empty; empty tables give empty results. Repeated rows of one place count once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Titles of tables of contents, marks of copyright and page numbers, words of decorative images, and
# types of images with content.
CONTENTS = ["目录", "目錕", "contents", "table of contents", "索引"]
NOISE = ["(?i)版权所有|copyright|all\\s+rights\\s+reserved|保留所有权利", "^第\\s*\\d+\\s*页$|^[Pp]age\\s+\\d+$|^\\d+\\s*/\\s*\\d+$"]
DECORATION = ["logo", "品牌标识", "品牌标志", "商标", "图标", "水印", "品牌", "icon", "brand", "徽标", "标识图"]
CONTENT_IMAGES = ["diagram", "screenshot", "chart", "table", "formula", "code"]
HEADINGS = ["heading", "title"]
ALONE = ["table", "code", "formula"]
PATH = " > "


def plain(elements: DataFrame) -> DataFrame:
    """One row of each place of a file, with its type in normal form as ``kind`` and no null in text and path."""
    by = W.partitionBy("file_id", "pos").orderBy(*(F.col(c).asc_nulls_first() for c in ("element_type", "text", "heading_path", "page_number")))
    kind = F.lower(F.btrim(F.coalesce("element_type", F.lit("")), F.lit(" \t")))
    path = F.coalesce("heading_path", F.array().cast("array<string>"))
    one = elements.withColumn("__n", F.row_number().over(by)).filter("__n = 1")
    return one.select("file_id", "pos", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), path.alias("heading_path"), "page_number")


def without_noise(elements: DataFrame) -> DataFrame:
    """Elements that aren't copyright lines, page numbers or in a table of contents, up to the next other heading."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    heading = F.col("kind").isin(HEADINGS) & (text != "")
    contents = F.lower(F.trim(F.regexp_replace(text, r"^#+\s*", ""))).isin(CONTENTS)
    order = W.partitionBy("file_id").orderBy("pos")
    inside = F.coalesce(F.last(F.when(heading, contents), ignorenulls=True).over(order), F.lit(False))
    noise = text.rlike(NOISE[0]) | text.rlike(NOISE[1])
    return elements.withColumn("__out", (text != "") & (inside | noise)).filter("NOT __out").drop("__out")


def decorative(kind: Column, image_type: Column, caption: Column) -> Column:
    """Whether an image carries no content: a logo, watermark or icon by its caption, unless its type has content."""
    content = F.lower(F.trim(F.coalesce(image_type, F.lit("")))).isin(CONTENT_IMAGES)
    low = F.lower(F.coalesce(caption, F.lit("")))
    found = F.exists(F.array(*map(F.lit, DECORATION)), lambda w: F.contains(low, w))
    return (kind == "image") & ~content & found


def table_columns(text: Column) -> Column:
    """How many columns the first row of a pipe table has."""
    bars = F.regexp_count(F.substring_index(text, "\n", 1), F.lit(r"\|"))
    return F.greatest(bars - 1, F.lit(0))


def table_rows(text: Column) -> Column:
    """How many rows a pipe table has below its head and the rule."""
    return F.greatest(F.size(F.split(F.trim(text), "\n")) - 2, F.lit(0))


def merged_tables(elements: DataFrame) -> DataFrame:
    """Tables that run on over pages as one: neighbours with as many columns whose pages follow each other.

    A page that isn't known fits any. Each table is compared with the one right before it.
    """
    order = W.partitionBy("file_id").orderBy("pos")
    columns = F.when(F.col("kind") == "table", table_columns(F.col("text"))).otherwise(0)
    page = F.coalesce("page_number", F.lit(0))
    before = lambda c: F.lag(c, 1, 0).over(order)
    marked = elements.withColumn("__c", columns).withColumn("__p", page)
    near = (F.col("__p") == 0) | (before("__p") == 0) | (F.col("__p") - before("__p") <= 1)
    fresh = F.when((F.col("__c") > 0) & (F.col("__c") == before("__c")) & near, 0).otherwise(1)
    runs = marked.withColumn("__run", F.sum(fresh).over(order.rowsBetween(W.unboundedPreceding, 0)))
    # Only tables of more than one part are put together; the others stay where they are.
    size = F.count("*").over(W.partitionBy("file_id", "__run"))
    sized = runs.withColumn("__size", size).drop("__c", "__p")
    alone = sized.filter("__size = 1").drop("__run", "__size")
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    first = [F.min_by(c, "pos").alias(c) for c in ("kind", "heading_path", "page_number")]
    whole = sized.filter("__size > 1").groupBy("file_id", "__run").agg(F.min("pos").alias("pos"), parts.alias("__t"), *first)
    joined = F.array_join(F.transform("__t", lambda t: t["text"]), "\n").alias("text")
    return alone.unionByName(whole.select("file_id", "pos", "kind", joined, "heading_path", "page_number"))


def in_sections(elements: DataFrame, depth: int = 2) -> DataFrame:
    """elements with ``section``: each heading of the given depth begins one; what comes before the first is part of it."""
    begins = F.when((F.col("kind") == "heading") & (F.size("heading_path") == depth), 1).otherwise(0)
    order = W.partitionBy("file_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return elements.withColumn("section", F.greatest(F.sum(begins).over(order), F.lit(1)).cast("int"))


def table_description(text: Column) -> Column:
    """``[表格]`` with the number of columns and rows and the names of the columns."""
    head = F.regexp_replace(F.substring_index(F.trim(text), "\n", 1), r"^\|+|\|+$", "")
    names = F.filter(F.transform(F.split(head, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    names = F.when(F.contains(F.substring_index(F.trim(text), "\n", 1), F.lit("|")), names).otherwise(F.array().cast("array<string>"))
    rows, listed = table_rows(text), F.array_join(names, "/")
    both = F.concat(F.lit("[表格] 这是一个"), F.size(names), F.lit("列"), rows, F.lit("行的表格，列名："), listed, F.lit("。"))
    return F.when(F.size(names) == 0, "[表格]").when(rows > 0, both).otherwise(F.concat(F.lit("[表格] 列名："), listed, F.lit("。")))


def code_description(text: Column) -> Column:
    """``[代码]`` with the language, the name of what is defined first, and the first line that describes it."""
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    language = F.nullif(F.trim(F.regexp_extract(text, r"^# language:([^\n]*)", 1)), F.lit(""))
    name = F.coalesce(*map(found, (r"(?m)^def\s+(\w+)", r"(?m)^class\s+(\w+)", r"(?m)^function\s+(\w+)", r"(?m)^public\s+(?:static\s+)?(?:void|class)\s+(\w+)")))
    said = F.coalesce(F.nullif(F.regexp_extract(text, '"""([\\s\\S]+?)"""', 1), F.lit("")), F.nullif(F.regexp_extract(text, "'''([\\s\\S]+?)'''", 1), F.lit("")))
    noted = F.regexp_extract(text, r"(?m)^#[^\S\n]*([^\n]+)$", 1)
    noted = F.when((noted != "") & ~F.startswith(noted, F.lit("language:")), F.trim(noted))
    line = F.substring(F.coalesce(F.substring_index(F.regexp_replace(said, r"^\s+|\s+$", ""), "\n", 1), noted), 1, 60)
    label = F.coalesce(F.concat(F.lit("["), F.initcap(language), F.lit("代码]")), F.lit("[代码]"))
    return F.when(F.trim(text) == "", "[代码]").otherwise(F.concat_ws(" ", label, name, F.concat(F.lit("："), line)))


def described(elements: DataFrame) -> DataFrame:
    """elements with ``shown``: tables, code and formulas behind their description, images as what is said of them."""
    text, kind = F.col("text"), F.col("kind")
    prefix = F.when(kind == "table", table_description(text)).when(kind == "code", code_description(text)).when(kind == "formula", "[公式]")
    shown = F.when(prefix.isNotNull() & (F.trim(text) != ""), F.concat(prefix, F.lit("\n"), text))
    return elements.withColumn("shown", shown.when((kind == "image") & (F.trim(text) == ""), "[图片]").otherwise(text))


_SENTENCE = re.compile(r"[^\n。！？]*?(?:\n|[。！？]|[.!?] )|[^\n。！？]+?$")


def sentences(text: str) -> list[str]:
    """The sentences and lines of a text without blanks around them."""
    return [s for s in (m[0].strip() for m in _SENTENCE.finditer(text)) if s]


def by_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Sentences packed up to ``size``, each piece beginning with the tail of the one before; longer ones are sliced."""
    out: list[str] = []
    held = ""
    for s in sentences(text):
        if held and len(held) + len(s) + 1 <= size or not held and len(s) + 1 <= size:
            held = f"{held}\n{s}" if held else s
            continue
        if held:
            out.append(held)
        held = f"{held[-overlap:]}\n{s}".strip() if held and overlap > 0 else s
        if len(held) > size:
            out += [held[k : k + size] for k in range(0, len(held), max(1, size - overlap))]
            held = ""
    return [*out, *([held] if held else [])]


Packer = Callable[[], tuple[Callable, Callable]]


def streamed(df: DataFrame, keys: list[str], order: list[str], columns: list[str], packer: Packer, out: str) -> DataFrame:
    """(*keys, out…) of what ``packer`` makes of each group's rows in order.

    packer() gives ``add(row)`` and ``end()``, both of which yield rows of ``out``. Groups are sorted by Spark and seen as
    a stream.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [*keys, *(part.split()[0] for part in out.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, add, end = None, None, None
        for pdf in frames:
            rows: list[tuple] = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != now:
                    if end:
                        rows += [(*now, *r) for r in end()]
                    now = key
                    add, end = packer()
                rows += [(*now, *r) for r in add(row)]
            yield pd.DataFrame(rows, columns=names)
        if end:
            yield pd.DataFrame([(*now, *r) for r in end()], columns=names)

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *order, *columns)
    return placed.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), out]))


def structure_chunks(elements: DataFrame, size: int = 500) -> DataFrame:
    """(file_id, chunk_no, kind, path, chunk): text packed below its heading; tables, code and formulas alone, behind
    their path; long text by sentences."""

    def packer():
        path: list[str] = []
        held: list[str] = []
        count = number = 0

        def made(kind: str, text: str) -> tuple:
            nonlocal number
            number += 1
            return number - 1, kind, PATH.join(path), text

        def led(text: str) -> str:
            return f"{PATH.join(path)}\n{text}" if path else text

        def flush() -> list[tuple]:
            nonlocal held, count
            out = [made("text", led("\n".join(held)))] if held else []
            held, count = [], 0
            return out

        def add(row) -> list[tuple]:
            nonlocal path, held, count
            if row.kind in HEADINGS:
                out = flush()
                path, held, count = list(row.heading_path), [row.text], len(row.text)
                return out
            if row.kind in ALONE:
                return [*flush(), made(row.kind, led(row.text))]
            if len(row.text) > size:
                parts = [s for s in (p.strip() for p in re.split(r"(?<=[。！？])|\n", row.text)) if s]
                return [*flush(), *(made("text", s[k : k + size]) for s in parts for k in range(0, len(s), size))]
            out = flush() if row.text and count + len(row.text) + 1 > size else []
            if row.text:
                count += len(row.text) + (1 if held or not out else 0)
                held.append(row.text)
            return out

        return add, flush

    return streamed(elements, ["file_id"], ["pos"], ["kind", "text", "heading_path"], packer, "chunk_no int, kind string, path string, chunk string")


def parents(elements: DataFrame, size: int = 1500) -> DataFrame:
    """(file_id, section, part, pos, kind, text, shown, heading_path): elements of sections cut into parts of bounded
    length, each part led by the headings of its section so far; an element that is longer alone is sliced."""

    def packer():
        context: list[tuple] = []
        length = part = 0
        filled = False

        def lead() -> list[tuple]:
            return [(part, *c) for c in context]

        def turn() -> list[tuple]:
            nonlocal part, length, filled
            if not filled:
                return []
            part, filled, length = part + 1, False, sum(len(c[2]) for c in context)
            return lead()

        def add(row) -> list[tuple]:
            nonlocal length, filled
            item = (row.pos, row.kind, row.text, row.shown, list(row.heading_path))
            if len(row.text) > size:
                out = turn()
                for k in range(0, len(row.text), size):
                    piece = row.text[k : k + size]
                    out.append((part, row.pos, row.kind, piece, piece, list(row.heading_path)))
                    filled = True
                    out += turn() if k + size < len(row.text) else []
                return out
            out = turn() if length + len(row.text) > size else []
            length += len(row.text)
            if row.kind in HEADINGS:
                context.append(item)
            else:
                filled = True
            return [*out, (part, *item)]

        return add, list

    out = "part int, pos int, kind string, text string, shown string, heading_path array<string>"
    return streamed(described(elements), ["file_id", "section"], ["pos"], ["kind", "text", "shown", "heading_path"], packer, out)


def children(parts: DataFrame, size: int = 300, overlap: int = 50) -> DataFrame:
    """(file_id, section, part, child_no, kind, chunk) of parents: short texts packed, long ones by sentences with an
    overlap; tables, code, formulas and images apart. Headings are in the parent only."""

    def packer():
        held: list[str] = []
        count = number = 0

        def made(kind: str, text: str) -> list[tuple]:
            nonlocal number
            if not text.strip():
                return []
            number += 1
            return [(number - 1, kind, text.strip())]

        def flush() -> list[tuple]:
            nonlocal held, count
            out = made("text", "\n".join(held)) if held else []
            held, count = [], 0
            return out

        def add(row) -> list[tuple]:
            nonlocal count
            if row.kind in HEADINGS or not row.shown.strip():
                return []
            apart = row.kind in (*ALONE, "image")
            if apart or len(row.shown) > size:
                pieces = by_sentences(row.shown, size, overlap) if len(row.shown) > size else [row.shown]
                return [*flush(), *(m for p in pieces for m in made(row.kind, p))]
            out = flush() if count + len(row.shown) + 1 > size else []
            held.append(row.shown)
            count += len(row.shown) + 1
            return out

        return add, flush

    return streamed(parts, ["file_id", "section", "part"], ["pos"], ["kind", "shown"], packer, "child_no int, kind string, chunk string")


def prepared(elements: DataFrame, depth: int = 2) -> DataFrame:
    """Elements without noise and decoration, tables merged, in sections."""
    kept = without_noise(plain(elements)).filter(~decorative(F.col("kind"), F.lit(None).cast("string"), F.col("text")))
    return in_sections(merged_tables(kept), depth)
