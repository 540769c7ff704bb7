from __future__ import annotations

import random
import re
import unicodedata
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"

pii = pytest.importorskip("opsloom.llm.pii")
from opsloom.llm import leakage, queries, splitting, stuffing, tokens  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_empty_and_null_tables(spark, empty_tables, null_tables, name):
    per_row = {"p6_ids": (0, 1), "p4_masked": (0, 2)}
    for folder, want in zip((empty_tables, null_tables), per_row.get(name, (0, 0))):
        assert queries.QUERIES[name](spark, folder).count() == want


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, duck, name):
    want = sorted(map(str, duck.execute(queries.SQL[name]).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, SMALL).collect()) == want and want


# --- splitting


def cost_of(text, limit, overlap, cuts):
    where, penalty = splitting.boundaries(text, limit - overlap)
    price = dict(zip(where.tolist(), penalty.tolist()))
    pieces = 1 + -(-(len(text) - limit) // (limit - overlap))
    even = (len(text) + (pieces - 1) * overlap) / pieces
    total, before = 0.0, 0
    for c in cuts:
        size = c - before + (overlap if before else 0)
        total += 1 + price[c] + splitting.IMBALANCE * ((size - even) / limit) ** 2
        before = c
    return total


@pytest.mark.parametrize("seed", range(16))
def test_split_costs_least(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "bc", "d. ", ", ", " ", "\n"]) for _ in range(24))
    limit, overlap = rng.choice([(12, 0), (14, 3), (20, 5), (12, 8), (16, 15)])
    if len(text) <= limit:
        return
    found = [b for _, b in splitting.split(text, limit, overlap)]
    where = splitting.boundaries(text, limit - overlap)[0].tolist()

    def least(at, cuts):
        """Over every sequence of cuts, one after the other."""
        if cuts and cuts[-1] == len(text):
            return cost_of(text, limit, overlap, cuts)
        if cuts and cuts[-1] <= overlap:
            return float("inf")
        reach = [w for w in where if at < w <= (at - overlap if cuts else 0) + limit]
        return min((least(w, [*cuts, w]) for w in reach), default=float("inf"))

    best = least(0, [])
    assert abs(cost_of(text, limit, overlap, found) - best) < 1e-9


@pytest.mark.parametrize("limit,overlap", [(300, 50), (120, 0), (100, 60), (40, 39), (5, 9), (1, 0)])
@pytest.mark.parametrize("text", ["x" * 2000, "短句。" * 400, "word " * 300, "👩‍🔧" * 200, "é" * 300, "a\r\n" * 300, "no end", "", "é"])
def test_pieces_cover_and_overlap(text, limit, overlap):
    parts = splitting.split(text, limit, overlap)
    o = max(0, min(overlap, limit - 1))
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(b - a <= limit for a, b in parts)
    assert all(b - a2 == o for (_, b), (a2, _) in zip(parts, parts[1:]))
    if limit == 300:
        assert not any(splitting._glued(text, b) for _, b in parts[:-1])


@pytest.mark.parametrize("limit,overlap", [(60, 0), (60, 15), (40, 39), (25, 20)])
def test_texts_side_by_side_are_cut_as_alone(limit, overlap):
    rng = random.Random(limit + overlap)
    words = ["a", "bc", "word", "longerword", "x" * 30, "end.", "so,", "中文句子。", "\n", "\n\n"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ""]) for _ in range(rng.choice([0, 5, 40, 60, 60, 60, 400]))) for _ in range(60)]
    together = splitting.split_all(texts, limit, overlap)
    step = limit - overlap
    for text, pieces in zip(texts, together):
        assert pieces == splitting.split(text, limit, overlap)
        n = len(text)
        if n > limit:
            fewest = 1 + -(-(n - limit) // step)
            price, cuts = splitting._cheapest(*splitting.boundaries(text, step), limit, overlap, (n + (fewest - 1) * overlap) / fewest)
            assert abs(cost_of(text, limit, overlap, [b for _, b in pieces]) - price) < 1e-9


def test_every_end_of_a_word_takes_part():
    text = "one two, three four five, six seven eight nine ten"
    where, penalty = splitting.boundaries(text, 20)
    words = {k + 1 for k, c in enumerate(text) if c == " "} | {len(text)}
    assert set(where.tolist()) == words and set(penalty.tolist()) == {0.0, splitting.CLAUSE, splitting.WORD}


def test_pieces_of_the_tables(spark):
    limits = {r.element_type: r for r in spark.read.parquet(f"{SMALL}/split_limits.parquet").collect()}
    items = {r.element_id: r for r in spark.read.parquet(f"{SMALL}/elements.parquet").collect()}
    by_item = {}
    for r in queries.p1_pieces(spark, SMALL).collect():
        by_item.setdefault(r.element_id, []).append(r)
    assert by_item
    for k, parts in by_item.items():
        parts.sort(key=lambda r: r.piece_no)
        item, rule = items[k], limits[items[k].element_type.strip(" \t").lower()]
        where = set(splitting.boundaries(item.text, rule.max_chars - rule.overlap_chars)[0].tolist())
        assert [p.piece_no for p in parts] == list(range(len(parts))) and len(parts) > 1
        assert all(0 < len(p.piece) <= rule.max_chars and item.text[p.start : p.end] == p.piece and p.end in where for p in parts)
        assert all(a.end - b.start == rule.overlap_chars for a, b in zip(parts, parts[1:]))
        assert parts[0].start == 0 and parts[-1].end == len(item.text) and all(p.heading_path == item.heading_path for p in parts)


def test_pieces_table(spark):
    rows = [(1, " Paragraph", "One. " * 100, ["h"], "x"), (1, " Paragraph", "One. " * 100, ["h"], "x"), (2, None, "y" * 999, None, "x"), (3, "list", None, [], "x"), (4, "other", "z" * 999, [], "x")]
    df = spark.createDataFrame(rows, "element_id long, kind string, text string, path array<string>, piece_no string")
    limits = spark.createDataFrame([("paragraph", 120, 20), ("list", 50, 0)], "element_type string, max_chars int, overlap_chars int")
    got = splitting.pieces(df.drop("piece_no"), limits, "element_id", "kind", "text", ["path"]).collect()
    big = [r for r in got if r.oversized]
    assert {r.element_id for r in big} == {1} and all(len(r.piece) <= 120 and list(r.path) == ["h"] and r.piece.endswith(("One. ", "One.")) for r in big)
    assert {r.element_id for r in got} == {1, 2, 4}


# --- personal data

NAMES = pii.Names([("Stenovar", "family"), ("Pelovar", "family"), ("Ardovar", "family"), ("Holovar", "family"), ("Mark", "given"), ("Wystan", "given"), ("韩", "family"), ("欧阳", "family")])
FOUND = [
    ("Please cc a.b+c@corp.example.com.", [("email", "a.b+c@corp.example.com")]),
    ("邮箱x_1 [at] mail [dot] example [dot] org收不到告警", [("email", "x_1 [at] mail [dot] example [dot] org")]),
    ("mail tamsin1615 at ops dot example dot test, thanks", [("email", "tamsin1615 at ops dot example dot test")]),
    ("ssh root@db-57 and log-kit@3.8.1 and app@sha256:68ab @oncall", []),
    ("Call me on +44 20 7946 0636 when it is back", [("phone", "+44 20 7946 0636")]),
    ("值班手机 (+86)15400005226 没人接", [("phone", "(+86)15400005226")]),
    ("tel +49 (0)30/23125419, now", [("phone", "+49 (0)30/23125419")]),
    ("订单12582738446卡住了 at epoch 1783797429919 it stopped, listen on 10.25.12.7:2260", []),
    ("332-64-69-87 is the build tag. trace 482019009477678867 looks odd", []),
    ("HR needs the number 968-04-0133 masked", [("id_number", "968-04-0133")]),
    ("national id QQ 81 17 74 D.", [("id_number", "QQ 81 17 74 D")]),
    ("Ship to Flat 31, 69 Quarry Lane, Stonemere, QX2 7ZZ please", [("address", "Flat 31, 69 Quarry Lane, Stonemere, QX2 7ZZ")]),
    ("Wohnhaft in Alte Gerberstraße 225, 00604 Altbrück.", [("address", "Alte Gerberstraße 225, 00604 Altbrück")]),
    ("备件请寄到云栖市临溪区望江路73号4幢1单元419。", [("address", "云栖市临溪区望江路73号4幢1单元419")]),
    ("rack 21, row A, hall 5. 5号机房2排机柜断电", []),
    ("I spoke with Wystan C. Pelovar about the rollback", [("name", "Wystan C. Pelovar")]),
    ("according to Stenovar, Wystan it was the cache", [("name", "Stenovar, Wystan")]),
    ("麻烦找欧阳远澄审批一下", [("name", "欧阳远澄")]), ("已经和沈川确认过，", [("name", "沈川")]),
    ("Chaos Monkey shows nothing. Mark the end.", []), ("高可用方案和白名单都检查过了", []), ("", []), ("  ", []),
]


@pytest.mark.parametrize("text,want", FOUND)
def test_entities(text, want):
    assert [(e.kind, text[e.start : e.end]) for e in pii.entities(text, NAMES)] == want


def test_skip_edges_carry_labels():
    alone = "Calixto Zorn came by."
    assert pii.entities(alone, NAMES) == []
    told = "I spoke with Calixto Zorn about the rollback. Later Calixto Zorn came by."
    assert len(pii.entities(told, NAMES)) >= 1
    nodes = [pii._Node("name", 0, 1, 3.0), pii._Node("name", 2, 3, -0.5), pii._Node("name", 4, 5, -0.5)]
    free, tied = pii.settle(nodes, []), pii.settle(nodes, [(0, 1, 1.2), (1, 2, 1.2)])
    assert free[1] < 0 < tied[1] and tied[2] > free[2]


def test_bare_repeats_follow_the_cued_mention():
    spans = lambda t: [t[e.start : e.end] for e in pii.entities(t, NAMES)]
    assert spans("I spoke with Calixto Zorn about the rollback. Later Calixto Zorn came by.") == ["Calixto Zorn"] * 2
    assert spans("I spoke with Calixto Zorn about the rollback. Later Zorn came by.") == ["Calixto Zorn", "Zorn"]
    assert spans("麻烦找沈川审批。后来沈川来了。") == ["沈川"] * 2
    assert spans("Calixto Zorn came by. Later Calixto Zorn left.") == []


GIVEN = ["磊", "雪", "志远", "思雨", "建国", "晓"]
FAMILY = ["韩", "孟", "苏", "程", "温", "陆", "顾", "欧阳"]
HAN_SENTENCES = ["昨天{}把磁盘换了", "{}今天重启了网关", "我们同事{}说网关挂了", "这台机器交给{}。", "网关是{}改的配置", "请{}看一下告警", "下午{}和运维组开会", "值班的是{}，有事打电话", "告警发给{}了", "{}已经回复"]
HAN_OTHERS = ["时钟漂移了三分钟", "线程池只按8个客户端设计", "进程空转，流程没走完", "室温过高，温度报警", "登陆失败，陆续恢复", "回顾会上没有提到顾客", "程序没有响应", "远程连接断开", "今天网关重启了"]
LATIN_SENTENCES = ["Yesterday {} replaced the disk.", "{} restarted the gateway this morning.", "The change was reviewed by {} before lunch.", "We waited for {}.", "Gestern hat {} die Platte getauscht.", "Der Zugang von {} ist gesperrt.", "Hier ist {} aus dem Rechenzentrum.", "Hier, {} a redémarré le serveur.", "Could {} look into it?"]


def test_names_in_sentences_of_other_wording():
    names = pii.Names([(f, "family") for f in FAMILY] + [(f, "family") for f in ("Stenovar", "Pelovar", "Ardovar", "Brandhorst")] + [("Wystan", "given"), ("Liora", "given")])
    spans = lambda t: [t[e.start : e.end] for e in pii.entities(t, names) if e.kind == "name"]
    want = [(s.format(f + g), f + g) for s in HAN_SENTENCES for f in FAMILY for g in GIVEN]
    found = [spans(t) == [n] for t, n in want]
    assert sum(found) >= 0.9 * len(want)
    assert [spans(t) for t in HAN_OTHERS] == [[] for _ in HAN_OTHERS]
    latin = [s.format(n) for s in LATIN_SENTENCES for n in ("Liora Stenovar", "Wystan Brandhorst", "L. Ardovar", "Pelovar")]
    assert sum(len(spans(t)) == 1 for t in latin) >= 0.9 * len(latin)


ADDRESSED = [
    ("Wir sind in der Hauptstraße 5 bei Regen.", "Hauptstraße 5"), ("Es ging an die Turmgasse 213b, danke", "Turmgasse 213b"), ("Am Markt 7 in Bonn steht der Rechner", "Am Markt 7 in Bonn"),
    ("Livrer au 12 rue de la Paix, 75002 Paris demain", "12 rue de la Paix, 75002 Paris"), ("Envíalo a Calle Mayor 5, 28013 Madrid por favor", "Calle Mayor 5, 28013 Madrid"), ("Im Schrank 12 in Halle 3 brennt eine Lampe", ""), ("Im Rack 5 ist Platz", ""),
]


@pytest.mark.parametrize("text,want", ADDRESSED)
def test_addresses_of_more_countries(text, want):
    found = pii.entities(text, NAMES)
    assert [text[e.start : e.end] for e in found if e.kind == "address"] == ([want] if want else [])
    assert pii.masked(text, [e for e in found if e.kind == "address"]) == (text.replace(want, "[ADDRESS]") if want else text)


@pytest.mark.parametrize("times", [1, 4, 40])
def test_one_telling_mention_reaches_all_others(times):
    spans = lambda t: [t[e.start : e.end] for e in pii.entities(t, NAMES)]
    bare = "Then Zorn came by. " * times
    assert spans("I spoke with Calixto Zorn about it. " + bare) == ["Calixto Zorn"] + ["Zorn"] * times
    assert spans(bare + "I spoke with Calixto Zorn about it.") == ["Zorn"] * times + ["Calixto Zorn"]
    assert spans(bare) == []


def test_the_rest_of_a_masked_text_is_unchanged(spark):
    texts = {r.rec_id: r.text for r in queries._messages(spark, SMALL).filter("src = 'turns'").collect() if r.text}
    masked = {r.rec_id: r.masked for r in queries.p4_masked(spark, SMALL).filter("src = 'turns'").collect()}
    parts = spark.read.parquet(f"{SMALL}/name_parts.parquet").dropna().collect()
    names = pii.Names(sorted({(r.name_part, r.part_kind) for r in parts}))
    changed = 0
    for k, text in texts.items():
        found = pii.entities(text, names)
        kept = [text[a:b] for a, b in zip([0, *(e.end for e in found)], [*(e.start for e in found), len(text)])]
        pattern = "".join(re.escape(part) + (re.escape(pii.PLACEHOLDER[found[n].kind]) if n < len(found) else "") for n, part in enumerate(kept))
        assert re.fullmatch(pattern, masked[k], re.S)
        changed += bool(found)
    assert changed


def test_messages_agree_with_enumeration():
    # On a tree, message passing is exact.
    nodes = [pii._Node("name", k, k + 1, o) for k, o in enumerate([1.0, -0.7, 0.2])]
    edges = [(0, 1, 0.9), (1, 2, 1.4)]
    odds = pii.settle(nodes, edges)
    for k in range(3):
        mass = {0: 0.0, 1: 0.0}
        for x in product([0, 1], repeat=3):
            mass[x[k]] += np.exp(sum(n.odds * v for n, v in zip(nodes, x)) + sum(w * (x[a] == x[b]) for a, b, w in edges))
        assert abs(np.log(mass[1] / mass[0]) - odds[k]) < 1e-6


def test_mask_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "cc a@example.com, now"), (2, None), (3, "")], "id int, t string")
    parts = spark.createDataFrame([("Mark", "given"), (None, None)], "name_part string, part_kind string")
    assert {r.id: r.m for r in pii.mask(df, "t", "m", parts).collect()} == {1: "cc [EMAIL], now", 2: None, 3: ""}


def test_keys_stay_exact_beside_a_null(spark):
    """Keys beyond 2^53 in one batch with a null key, the largest of all among them."""
    keys = [None, 2**53 + 1, 2**60 + 1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(k, f"Mail to a{n}@mail.example") for n, k in enumerate(keys)], "id long, t string").coalesce(1)
    parts = spark.createDataFrame([("Mark", "given")], "name_part string, part_kind string")
    found = pii.find(df, "t", ["id"], parts).select("id", "kind", "value").collect()
    assert sorted(map(tuple, found), key=lambda r: r[2]) == [(k, "email", f"a{n}@mail.example") for n, k in enumerate(keys)]


# --- tokens


def test_ids_are_those_of_the_library(spark):
    rng = random.Random(5)
    alphabet = list(" \t\n\r  ab12.,'\"\x00^\x1c\x85\xa0\u180e　é中。👩‍🔧½²Ⅷ") + ["<|endoftext|>", "'ll", "   ", " \x00^"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [None, "", "q \x00^x", "x" * 5000, "中" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("ids", F.lit("clash"))
    got = {r.k: r for r in tokens.with_offsets(df, "t").withColumn("back", tokens.text_of(F.col("ids"))).collect()}
    plain = {r.k: r.i for r in df.select("k", tokens.ids_of(F.col("t")).alias("i")).collect()}
    whole = tokens.tokenizer("byte_bpe_50k")
    for k, t in enumerate(texts):
        want = whole.encode(t or "", add_special_tokens=False).ids
        assert list(got[k].ids) == want == list(plain[k]) and got[k].back == (t or "")
        spans = list(zip(got[k].starts, got[k].ends))
        assert len(spans) == len(want) and (not spans or (spans[0][0] == 0 and spans[-1][1] == len(t)))
        assert all(a <= c <= b for (a, b), (c, _) in zip(spans, spans[1:]))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tokens.Encoder("word_bpe_49k", tokens.TOKENIZER_DIR)


def test_decoding_a_cut_character(spark):
    ids = tokens.tokenizer("byte_bpe_50k").encode("👩", add_special_tokens=False).ids
    df = spark.createDataFrame([(ids[:1],), ([],), (None,)], "i array<int>")
    got = [r.t for r in df.select(tokens.text_of(F.col("i")).alias("t")).collect()]
    assert "�" in got[0] and got[1:] == ["", None]


# --- leaked passages

PASSAGE = "When payment-service v5.25.23 leaked 55 handles per hour, alerts on open_files were muted for 54 minutes. Replication from node-f58 trailed by 84 seconds, so we capped retries at 39. user-service dropped 59 replicas because cache.ttl_s went from 19 to 753484."
HALF = PASSAGE[: len(PASSAGE) * 6 // 10]
OTHER = "When order-service v1.2.3 leaked 9 handles per hour, alerts on cpu_steal were muted for 7 minutes. Replication from node-a1 trailed by 3 seconds, so we capped retries at 8."
LEAKED = [PASSAGE, "x " * 500 + PASSAGE.upper() + " y" * 500, HALF, PASSAGE.replace(" ", "  ​"), PASSAGE.replace(". ", ".\n\nSome other words stand here now. "), PASSAGE.replace(".", "!"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in PASSAGE)]
CLEAN = [OTHER, PASSAGE[: len(PASSAGE) // 3], "What leaked 55 handles?", "", " ", None, OTHER * 20, "payment-service node-f58 cache.ttl_s"]


def test_leaks(spark):
    docs = spark.createDataFrame(list(enumerate(LEAKED + CLEAN)) + [(0, PASSAGE)], "doc_id long, text string").withColumn("share", F.lit(1))
    items = spark.createDataFrame([(7, PASSAGE), (7, PASSAGE), (8, None), (9, "")], "item_id long, passage string")
    rows = leakage.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(k, 7) for k in range(len(LEAKED))}
    hit = next(r for r in rows if r.doc_id == 1)
    assert LEAKED[1][hit.start : hit.end].rstrip(". ") == PASSAGE.upper().rstrip(". ")
    assert leakage.leaks(docs, items.limit(0)).count() == 0


PROSE = "The standby site lost its route to the archive while the network crew was moving racks. Nobody noticed the queue growing until the night shift saw stale prices. We then drained the old broker by hand and asked the billing team to replay what was missing."
LATE = "Nobody on the duty desk saw the warning because the pager had been silenced for the whole of the night shift before. Later 17 of 93 shards on node-k4 moved, INC-4471 was opened at 10:42, v3.8.1 was rolled back to v3.7.9 and port 9113 closed at 11:05."


def _half(text, last=False):
    n = -(-len(text) // 2)
    return text[-n:] if last else text[:n]


def _interleaved(text):
    return ("\n" + "Meanwhile other people wrote about lunch and weather. " * 30 + "\n").join(text.split(". "))


@pytest.mark.parametrize("passage", [PASSAGE, PROSE, LATE])
def test_halves_and_interleaved_passages_are_found(passage):
    known = leakage.Items([(1, passage), (2, OTHER), (3, passage), (4, "")])
    for part in (_half(passage), _half(passage, True), _interleaved(passage), "One. " * 90 + _half(passage, True) + " Two." * 90):
        assert {i for i, *_ in known.in_text(part)} == {1, 3}
    for part in (passage[: len(passage) // 3], passage[-len(passage) // 3 :], "Meanwhile other people wrote about lunch. " * 20):
        assert not list(known.in_text(part))


DIGITS = "zero one two three four five six seven eight nine".split()


def _sentences(text):
    return [s for s in re.split(r"(?<=[。！？])|(?<=[.!?])\s+", text) if s]


def _mixed(passage, times, others, rng):
    out = []
    for sentence in _sentences(passage):
        out.append(sentence)
        while sum(map(len, out)) < (times + 1) * passage.index(sentence) + len(sentence):
            out.append(rng.choice(others))
    return " ".join(out)


# What is done to a passage; whether the result still reveals it.
ALTERED = {
    "first 55 %": (lambda p, o, r: p[: int(len(p) * 0.55)], True),
    "middle 55 %": (lambda p, o, r: p[int(len(p) * 0.2) : int(len(p) * 0.75) + 1], True),
    "last 55 %": (lambda p, o, r: p[-int(len(p) * 0.55) :], True),
    "numbers masked": (lambda p, o, r: re.sub(r"\d+", "#", p), True),
    "digits crossed out": (lambda p, o, r: re.sub(r"\d", "X", p), True),
    "numbers in words": (lambda p, o, r: re.sub(r"\d", lambda m: f" {DIGITS[int(m[0])]} ", p), True),
    "one other sentence each": (lambda p, o, r: _mixed(p, 1, o, r), True),
    "four times other text": (lambda p, o, r: _mixed(p, 4, o, r), True),
    "eight times other text": (lambda p, o, r: _mixed(p, 8, o, r), True),
    "accents decomposed": (lambda p, o, r: unicodedata.normalize("NFD", p), True),
    "every tenth word changed": (lambda p, o, r: " ".join(r.choice(o).split()[0] if r.random() < 0.1 else w for w in p.split(" ")), True),
    "other numbers": (lambda p, o, r: re.sub(r"\d", lambda m: str((int(m[0]) + r.randint(1, 9)) % 10), p), False),
    "a third": (lambda p, o, r: p[: len(p) // 3], False),
}


@pytest.fixture(scope="module")
def passages():
    import pandas as pd

    items = pd.read_parquet(f"{SMALL}/eval_items.parquet")
    rows = list(zip(items.item_id.tolist(), items.passage.tolist()))
    known = leakage.Items(rows)
    texts = [t for t in pd.read_parquet(f"{SMALL}/documents.parquet").text.dropna() if 300 < len(t) < 3000]
    texts = [t for t in texts if not list(known.in_text(t))]
    return rows, known, [s for t in texts for s in _sentences(t) if 10 < len(s) < 200]


@pytest.mark.parametrize("how", sorted(ALTERED))
def test_altered_passages(passages, how):
    rows, known, others = passages
    alter, reveals = ALTERED[how]
    rng = random.Random(len(how))
    found = wrong = 0
    for i, p in rows:
        around = [" ".join(rng.choice(others) for _ in range(12)) for _ in range(2)]
        got = {x for x, *_ in known.in_text(f"{around[0]}\n{alter(p, others, rng)}\n{around[1]}")}
        found += i in got
        wrong += len(got - {i})
    if reveals:
        assert found >= 0.9 * len(rows) and wrong <= 0.01 * found
    else:
        # A few passages are told apart by their words alone.
        assert found <= 0.05 * len(rows) and wrong == 0


def test_accents_in_either_form():
    passage = "Während der Störung wurde die Übergabe übersprungen, weil der Wächter für große Aufträge ausgefallen war und niemand die Rückmeldung prüfte."
    known = leakage.Items([(1, unicodedata.normalize("NFD", passage))])
    assert [i for i, *_ in known.in_text("x " + passage)] == [1]


def test_half_that_two_passages_share():
    shared = PROSE[:130]
    known = leakage.Items([(1, shared + LATE[:110]), (2, shared + PASSAGE[:110])])
    assert {i for i, *_ in known.in_text("x " * 50 + shared + " y" * 50)} == {1, 2}


def test_chain_matches_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        p, r = ("".join(rng.choice("ab1") for _ in range(n)) for n in (14, 18))
        known = leakage.Items([(1, p)])
        share, a, b = known.covered(1, r)
        assert 0 <= share <= 1 and (share == 0 or r[a : a + leakage.STEP] in p)
    same = leakage.Items([(1, "abcdefghij1234567890")])
    assert same.covered(1, "abcdefghij1234567890")[0] == 1.0


# --- stuffed pages


def brute_repeats(text):
    out = []
    for e in range(1, len(text) + 1):
        best = 0
        for n in range(1, e + 1):
            s = text[e - n : e]
            if sum(text.startswith(s, k) for k in range(len(text))) > 1:
                best = n
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(10))
def test_automaton_finds_longest_repeats(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("abc"[: 1 + seed % 3]) for _ in range(rng.randint(0, 40)))
    assert stuffing.repeats(text) == brute_repeats(text)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("least", [4, 8])
def test_comparing_substrings_covers_what_the_automaton_covers(seed, least):
    rng = random.Random(seed)
    letters = ["abc", "ab", "一二三", "a一😀", "".join(map(chr, range(300, 700))) + "ab"][seed % 5]
    base = "".join(rng.choice(letters) for _ in range(rng.randint(0, 400)))
    text = base + "".join(base[k : k + 11] for k in range(0, len(base), 37))
    automaton = stuffing.covered(text, least)
    assert (stuffing.repeated(stuffing.code_points(text), least) == automaton).all()
    want = brute_repeats(text[:150])
    covered = [any(want[e] >= least and e - want[e] < k <= e for e in range(len(want))) for k in range(len(want))]
    assert stuffing.covered(text[:150], least).tolist() == covered


KEYWORDS = ["disk cleaner", "vps offer", "log tool", "磁盘清理"]


def test_stuffed_pages(spark):
    rng = random.Random(1)
    pick = lambda n: [rng.choice(KEYWORDS) for _ in range(n)]
    sentences = " ".join(f"The rate limiter of service {k} was widened by {k * 7 % 90} percent because the queue was too long." for k in range(30))
    links = [f"https://shop.example.com/item/{rng.randint(100, 99999)}.html" for _ in range(60)]
    bad = [" ".join(pick(100)), ", ".join(pick(100)), " ".join("#" + k.replace(" ", "_") for k in pick(100)), "\n".join(links), "\n".join(f"- [{k}]({u})" for k, u in zip(pick(60), links)),
           "\n".join(f"{k} A{rng.randint(1, 999)} / {rng.randint(1, 999)}.99 / hot" for k in pick(60)), sentences[:400] + "\n" + " ".join(pick(120))]
    good = [sentences, sentences + "\n" + " ".join(pick(60)), "\n".join(f"- [{k}]({u}): The duty desk was told that it is slow, so we moved it to the other zone." for k, u in zip(pick(40), links)),
            "```\n" + "\n".join(pick(80)) + "\n```", "\n".join("| a | b |" for _ in range(80)), "\n".join(f"2026-01-01T10:00:0{k % 9}Z INFO disk ok" for k in range(80)), "", " \n", None, "0" * 300, "short"]
    df = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string").withColumn("covered_share", F.lit(1))
    got = {r.doc_id for r in stuffing.judged(df, "doc_id", "text").filter("stuffed_share > 0.5").collect()}
    assert got == set(range(len(bad)))


FRENCH = "La panne a commencé quand le commutateur du troisième étage a perdu son alimentation. Personne ne l'a remarqué avant le matin, parce que l'alerte avait été mise en sourdine par l'équipe de nuit. Nous avons ensuite déplacé les machines virtuelles vers l'autre salle et demandé au fournisseur de remplacer la carte. Les clients ont pu se reconnecter peu après midi, mais certaines commandes avaient été perdues."
RUSSIAN = "Авария началась, когда коммутатор на третьем этаже потерял питание. Никто этого не заметил до утра, потому что оповещение было отключено ночной сменой. Затем мы перенесли виртуальные машины в другой зал и попросили поставщика заменить плату. Клиенты смогли подключиться вскоре после полудня, но некоторые заказы были потеряны."
GERMAN = "Die Störung begann, als der Verteiler im dritten Stock keinen Strom mehr bekam. Bis zum Morgen fiel das niemandem auf, da der Alarm von der Nachtschicht stumm geschaltet worden war. Danach zogen die virtuellen Maschinen in den anderen Saal um, und der Lieferant tauschte die Karte aus."
KINDS = [
    ("and the server of the cheap host is the best host for the price " * 60, True),
    ("\n".join(["| best vps | cheap host | fast proxy |", "| cheap host | log tool | best vps |"] * 20), True),
    ("```\n" + "cheap vps best host fast proxy log tool\n" * 60, True),
    ("\n".join(f"2026-01-0{k % 9 + 1} 10:00 cheap vps best host log tool" for k in range(50)), True),
    ("\n".join(f"serveur pas cher, hébergement rapide, serveur rapide {k}" for k in range(40)), True),
    ("\n".join(f"https://shop{k}.example.org/p/{k * 7919}.html" for k in range(50)), True),
    ("最好备份最好备份!磁盘清理最好备份,磁盘清理 最好备份。" * 12, True),
    (FRENCH, False), (RUSSIAN, False), (GERMAN, False), ("\n".join([FRENCH] * 5), False), ("\n".join([RUSSIAN] * 3), False),
    ("| name | state |\n|---|---|\n" + "| disk | full |\n" * 60, False),
    ("\n".join(f"Nov 15 10:00:{k:02d} db-1 sshd[12]: session opened for user app" for k in range(60)), False),
    ("\n".join("12 7 2026 0.31 4" for _ in range(60)), False),
]


@pytest.mark.parametrize("text,bad", KINDS)
def test_pages_of_other_kinds_and_languages(text, bad):
    assert (stuffing.stuffed(text)[1] > stuffing.LEAST) == bad


def test_long_pages_are_judged_whole():
    page = "cheap vps, best host, log tool, fast proxy, disk cleaner\n" * (2 * stuffing.BLOCK // 50)
    assert len(page) > stuffing.BLOCK and stuffing.stuffed(page)[1] > 0.9


def test_quick_ways_of_page_judging_give_the_same():
    """ASCII words by their own pattern, covers from all ends at once, blanks by a table."""
    rng = random.Random(11)
    for _ in range(3000):
        unit = "".join(rng.choice("ab C'’-_1éßİK李王，. ") for _ in range(rng.randint(0, 30)))
        if not stuffing._HAN.search(unit):
            assert stuffing.words(unit) == [w.lower() for w in stuffing._WORD.findall(unit)]
        if unit.isascii():
            assert stuffing._ASCII_WORD.findall(unit.lower()) == stuffing.words(unit)
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 50)))
        want = np.zeros(len(text), bool)
        for end, n in enumerate(stuffing.repeats(text)):
            if n >= 4:
                want[end - n + 1 : end + 1] = True
        assert (stuffing.covered(text, 4) == want).all()
    assert [int(k) for k in np.flatnonzero(~stuffing._SHOWN)] == [int(k) for k in stuffing._BLANKS]
