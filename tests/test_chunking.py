from __future__ import annotations

import random

import pytest
from conftest import SMALL

from opsloom.operators import chunking, structure
from opsloom.plans import structure_queries
from opsloom.sources.tables import table


def packed_by_hand(text, size, overlap, sep):
    """Fixed chunks as strings, without offsets."""
    chunks, last_packed = [], False
    for p in [p.strip() for p in text.split(sep) if p.strip()]:
        if len(p) > size:
            step = max(1, size - overlap)
            chunks += [p[k : k + size] for k in range(0, len(p), step)]
            last_packed = False
        elif last_packed and len(chunks[-1]) + len(p) + 1 <= size:
            chunks[-1] += sep + p
        else:
            tail = chunks[-1][-overlap:] + sep if last_packed and 0 < overlap < len(chunks[-1]) else ""
            chunks.append(tail + p)
            last_packed = True
    return chunks


@pytest.mark.parametrize("seed", range(20))
def test_fixed_chunks_are_those_packed_by_hand(seed):
    rng = random.Random(seed)
    text = "\n\n".join("".join(rng.choice("ab c\n") for _ in range(rng.choice([0, 3, 9, 20, 70]))) for _ in range(rng.randint(0, 12)))
    for size, overlap in ((30, 0), (30, 5), (30, 29), (12, 40)):
        assert [c for _, c in chunking.fixed(text, size, overlap)] == packed_by_hand(text, size, overlap, "\n\n")


def test_smart_chunks():
    text = "# One\n\n" + "alpha " * 30 + "\n\nshort\n\n2. Two\n\n" + "beta " * 200
    got = chunking.smart(text, 300, 20, 40)
    assert got[0][0] == "One" and got[0][1].startswith("# One") and {h for h, _ in got} == {"One", "Two"}
    assert all(len(c) <= 300 + 23 for _, c in got) and all(b.startswith(a[-20:] + "...") for (_, a), (_, b) in zip(got, got[1:]))
    assert chunking.smart("", 300) == [] and chunking.smart("one", 300) == [("", "one")]


def test_auto_takes_headings_from_the_score_on():
    assert chunking.auto("# A\n\ntext\n\n## B\n\nmore")[0][0] == "A"
    assert chunking.auto("# A\n\ntext\n\nmore") == [("", "# A\n\ntext\n\nmore")]
    assert chunking.auto("- [x](y)\n- [z](w)\n\ntext")[0][0] == ""


def elements(spark, rows):
    return spark.createDataFrame(
        [(1, n, *r) for n, r in enumerate(rows)], "file_id long, pos int, element_type string, text string, heading_path array<string>, page_number int"
    )


ROWS = [
    ("Title", "Guide", ["Guide"], 1), ("heading", "目录", ["Guide", "目录"], 1), ("paragraph", "1 Start ... 3", None, 1), ("heading", "Start", ["Guide", "Start"], 2),
    ("paragraph", "Copyright 2026 Example", None, 2), ("paragraph", "第 3 页", None, 2), ("paragraph", "First words.", None, 2), (" table ", "| a | b |\n|---|---|\n| 1 | 2 |", None, 2),
    ("table", "| 3 | 4 |", None, 3), ("table", "| 5 | 6 | 7 |", None, 3), ("code", "# language: python\ndef run():\n    '''Runs it.\nMore.'''\n    pass", None, 3), ("image", "brand logo", None, 3),
    ("image", "a diagram of nodes", None, 3), ("formula", "x^2", None, 3), ("heading", "End", ["Guide", "End"], 4), ("paragraph", "Long sentence here. " * 60, None, 4), ("paragraph", None, None, 4), ("list", "", None, 4),
]


def test_noise_decoration_and_tables(spark):
    kept = structure.prepared(elements(spark, ROWS)).orderBy("pos").collect()
    texts = [r.text for r in kept]
    assert "目录" not in texts and not any(t.startswith(("1 Start", "Copyright", "第", "brand")) for t in texts)
    assert ROWS[7][1] + "\n" + ROWS[8][1] in texts and ROWS[9][1] in texts
    assert {r.text: r.section for r in kept}["Guide"] == 1 and {r.text: r.section for r in kept}["End"] == 2


def test_descriptions(spark):
    shown = {r.kind: r.shown for r in structure.described(structure.plain(elements(spark, [ROWS[7], ROWS[10], ROWS[13]]))).collect()}
    assert shown["table"].startswith("[表格] 这是一个2列1行的表格，列名：a/b。\n| a") and shown["code"].startswith("[Python代码] run ：Runs it.\n#") and shown["formula"] == "[公式]\nx^2"


def test_parents_and_children(spark):
    parts = structure.parents(structure.prepared(elements(spark, ROWS)), 400)
    by_part = {}
    for r in parts.orderBy("pos").collect():
        by_part.setdefault((r.section, r.part), []).append(r)
    sliced = "".join(r.text for k in sorted(by_part) for r in by_part[k] if r.kind == "paragraph" and k[0] == 2)
    assert sliced == ROWS[15][1]
    assert all(sum(len(r.text) for r in rows if r.kind not in structure.HEADINGS) <= 400 for rows in by_part.values())
    assert all(any(r.text == "End" for r in rows) for k, rows in by_part.items() if k[0] == 2)
    kids = structure.children(parts, 120, 20).collect()
    assert all(len(r.chunk) <= 120 for r in kids) and {"table", "code", "formula", "image", "paragraph", "text"} >= {r.kind for r in kids}
    assert not any(r.chunk in ("Guide", "Start", "End") for r in kids)
    assert {r.chunk for r in kids if r.kind == "image"} == {"a diagram of nodes"} and sum(r.kind == "table" for r in kids) == 2
    assert structure.children(parts.limit(0)).count() == 0


def test_structure_chunks(spark):
    got = structure.structure_chunks(structure.plain(elements(spark, ROWS)), 100).orderBy("chunk_no").collect()
    assert [r.chunk_no for r in got] == list(range(len(got)))
    alone = [r for r in got if r.kind != "text"]
    assert all(r.chunk.startswith("Guide > Start\n") for r in alone) and [r.kind for r in alone] == ["table", "table", "table", "code", "formula"]
    assert all(len(r.chunk) <= 100 + len(r.path) + 1 for r in got if r.kind == "text")


def test_sentences_by_hand():
    assert structure.sentences("One. Two! 三。四？\nFive") == ["One.", "Two!", "三。", "四？", "Five"]
    assert structure.by_sentences("a" * 25, 10, 3) == ["a" * 10, "a" * 10, "a" * 10, "a" * 4]


def test_children_of_the_tables_hold_every_paragraph(spark):
    elements_ = structure.prepared(table(spark, SMALL, "elements")).filter("kind = 'paragraph' AND length(text) BETWEEN 1 AND 200").collect()
    kids = {}
    for r in structure.children(structure.parents(structure.prepared(table(spark, SMALL, "elements")))).collect():
        kids.setdefault(r.file_id, []).append(r.chunk)
    assert elements_ and all(any(e.text.strip() in c for c in kids[e.file_id]) for e in elements_ if e.text.strip())


@pytest.mark.parametrize("name", sorted(structure_queries.QUERIES))
def test_structure_queries_on_empty_and_null_tables(spark, empty_tables, null_tables, name):
    assert structure_queries.QUERIES[name](spark, empty_tables).count() == 0
    structure_queries.QUERIES[name](spark, null_tables).collect()
