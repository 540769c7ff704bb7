"""Personal data in free text: found, and replaced by a placeholder of its kind.

Patterns and word shapes propose candidates; a skip-chain conditional random field decides. Each candidate is a node
that either is what it was proposed as or nothing. Its own potential sums log-odds of features: what the value is
built like (dates and check digits that hold, known name parts and endings), and the words before and behind it.
Neighbouring parts of one name share a potential. All candidates of a text that are equal or alike (but for case,
accents and a possessive ending) share one too, through a node of their own, so that a mention with telling words around
it decides those without, however many there are. Loopy message passing settles all nodes of a text together.

The data hold no labelled rows, so the weights are stated below rather than fitted; each is a log-odds. The telling words
are ones of the languages (verbs, prepositions, particles, forms of address), not phrases of any source.

Defined results: null, empty and blank texts have no entities and stay as they are. Of overlapping entities the longer
counts, of equal ones that with the higher belief, but a name inside an e-mail address or a street address isn't a name.
Text between entities is kept to the character. Texts of any length are read whole. Repeated rows are read alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# Weights, as log-odds.
BIAS = {"email": 3.0, "phone": 1.0, "id_number": 0.5, "address": 1.0, "name": -2.5}
CUE, DECOY, CHECKED, UNCHECKED = 2.5, -5.0, 2.0, -4.0
FAMILY, GIVEN, ORDINARY, ENDING, CAPITAL, PARTNER = 3.5, 2.2, 0.6, 2.0, 0.3, 2.0
CHAIN, SKIP = 1.2, 2.4
#: What a further mention of a candidate's words has besides, so that it is about even and the skip edges decide.
REPEAT = 2.2
#: Of words of Han script: a listed family name, words before and behind that go with a person, an edge of a run of Han
#: script, a given name with a character that names rarely have.
HAN_FAMILY, HAN_BEFORE, HAN_BEHIND, HAN_EDGE, HAN_RARE = 2.0, 1.5, 1.5, 0.7, -3.0
#: Messages are passed until no belief changes by more than this, or so many times.
CLOSE, ROUNDS = 1e-3, 100


class Entity(NamedTuple):
    kind: str
    start: int
    end: int


class _Node(NamedTuple):
    kind: str
    start: int
    end: int
    odds: float


_A = re.ASCII
_AT = r"\s?[@＠]\s?|\s*(?:\[at\]|\(at\)|\{at\})\s*|\s+at\s+"
_DOT = r"[.．]|\s*(?:\[dot\]|\(dot\)|\{dot\})\s*|\s+dot\s+"
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:{_AT})(?:[A-Za-z0-9-]+(?:{_DOT}))+[A-Za-z]{{2,}}(?![A-Za-z0-9-])", _A
)
_EDGE, _STOP = r"(?<![A-Za-z0-9+.:/=_-])", r"(?![A-Za-z0-9_]|[-.:/]\d)"
PHONES = [
    re.compile(_EDGE + p + _STOP, _A)
    for p in (
        r"(?:\(\+\d{1,3}\)|\+\d{1,3}|00[1-9]\d)(?:[ .\-/]{0,2}\(?\d{1,11}\)?){1,6}",
        r"1[3-9]\d[ -]?\d{4}[ -]?\d{4}",
        r"\(0?\d{2,4}\)[ .\-/]?\d{3,5}[ .-]?\d{3,4}",
        r"\d{3}[.-]\d{3}[.-]\d{4}",
        r"\d{3} \d{3} \d{4}",
        r"0\d(?: \d{2}){4}",
        r"0\d{1,4}[ /-]\d{3,5}(?:[ -]?\d{3,5})?",
    )
]
IDS = [
    (name, re.compile(r"(?<![A-Za-z0-9-])" + p + r"(?![A-Za-z0-9]|-\d)", _A))
    for name, p in (
        ("resident", r"\d{6}[ -]?\d{8}[ -]?\d{3}[\dXx]"),
        ("social", r"\d{3}-\d{2}-\d{4}"),
        ("insurance", r"[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D]"),
        ("lettered", r"(?:[XYZ]-?)?\d{7,8}-?[A-Z]"),
    )
]
# What a text must hold for a phone or identity number to be in it: digits close together, but for dotted addresses.
_NUMBER = re.compile(r"\d(?:(?:[ ()/+-]{0,2}\d){6}|\d\d\.\d{3}\.\d{4}|\d[ -]?\d\d[ -]?\d\d[ -]?[A-D]|\d{6}-?[A-Z])", re.A)
_STREET = (
    r"(?:Lane|Close|Avenue|Court|Way|Street|Road|Drive|Square|Terrace|Crescent|Boulevard|Place|Row|Hill|Gardens|Walk|Mews|Park|Grove|Alley|Quay|St|Ave|Rd|Ln|Dr|Ct|Blvd)"
)
_CAPS = r"[A-ZÄÖÜ][\wäöüß'’-]*"
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite|Floor|Room|No)\.? ?#?\w+"
_SOME_DIGIT = re.compile(r"\d")
_SUFFIX = r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|markt|steig|graben|hof|pfad|stieg|berg|chaussee|wall)"
# A text must hold one of these for a pattern to be worth trying.
_STREETS = [" " + w for w in _STREET[3:-1].split("|")]
_STRASSE = [w.replace("\\", "") + " " for w in _SUFFIX[3:-1].split("|")]
_AM = ["Am ", "An de", "Im ", "Zum ", "Zur ", "Auf de", "Unter den "]
_RUE = ["rue ", "avenue ", "boulevard ", "place ", "chemin ", "allée ", "impasse ", "quai ", "route ", "cours "]
_CALLE = ["alle ", "venida ", "laza ", "aseo ", "amino ", "ia ", "iale ", "iazza ", "orso "]
_LU = ["号", "號", "弄"]
ADDRESSES = [
    (_STREETS, re.compile(rf"(?:{_UNIT}, ?)?\b\d{{1,5}}[A-Za-z]? (?:{_CAPS} ){{1,4}}{_STREET}\b(?:,? {_UNIT})?(?:,? {_CAPS}(?: {_CAPS}){{0,2}})?(?:,? (?:[A-Z]{{2}}\d{{1,2}} ?\d[A-Z]{{2}}|[A-Z]{{2}} \d{{5}}|\d{{5}}))?")),
    (_STREETS, re.compile(rf"(?:{_CAPS} ){{0,2}}{_CAPS}, (?:{_CAPS} ){{1,4}}{_STREET} \d{{1,5}}[A-Za-z]?\b")),
    (_STRASSE, re.compile(r"\b(?:[A-ZÄÖÜ][\wäöüß-]* |(?:Am|An|Im|Zum|Zur|Auf|Unter|In) (?:de[rmn] )?)?[A-ZÄÖÜ][\wäöüß-]*" + _SUFFIX + r" \d{1,4}(?: ?[a-z])?\b(?:, ?(?:D-)?\d{5} [A-ZÄÖÜ][\wäöüß-]+)?")),
    (_AM, re.compile(r"\b(?:Am|An der|An den|Im|Zum|Zur|Auf dem|Auf der|Unter den) (?!Rack|Schrank|Reihe|Halle|Raum|Port|Server|Saal|Stock|Etage|Knoten|Node)[A-ZÄÖÜ][\wäöüß-]+ \d{1,4}(?: ?[a-z])?\b(?:, ?(?:D-)?\d{5} [A-ZÄÖÜ][\wäöüß-]+| in (?!Rack|Schrank|Reihe|Halle|Raum|Saal)[A-ZÄÖÜ][a-zäöüß-]+)")),
    (_RUE, re.compile(rf"\b\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours) (?:(?:de|du|des|la|le|les) |[ld]['’])*{_CAPS}(?: {_CAPS})*(?:, ?\d{{5}} {_CAPS})?")),
    (_CALLE, re.compile(rf"\b(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo|[Cc]amino|[Vv]iale?|[Pp]iazza|[Cc]orso) (?:(?:de|del|della|la|las|los|el) )*{_CAPS}(?: {_CAPS}| de| la)*,? (?:n[º°o]\.? ?)?\d{{1,4}}\b(?:, ?\d{{5}} {_CAPS})?")),
    (_LU, re.compile(r"(?:(?:(?![到是在寄至往于从把给的])[㐀-鿿]){2,3}省)?(?:(?![到是在寄至往于从把给的])[㐀-鿿]){2,4}[市州][㐀-鿿]{1,5}[区區县縣][㐀-鿿]{1,8}?(?:路|街|道|巷|弄|胡同)\d{1,5}[号號弄](?:\d{1,4}[-\d]*(?:号楼|栋|棟|幢|座|楼))?(?:\d{1,2}单元)?(?:\d{1,5}(?:室|房|号)?)?")),
    (_LU, re.compile(r"(?<![㐀-鿿])[㐀-鿿]{2,6}(?:路|街|大道|巷|弄|胡同)\d{1,5}[号號](?:\d{1,4}(?:号楼|栋|棟|幢|座))(?:\d{1,2}单元)?(?:\d{1,5}室?)?")),
]

# Words before or behind a value that tell what it is, and ones that tell that it isn't.
_PHONE_CUE = re.compile(r"(?:phone|call|tel|sms|reach|fax|mobile|rückruf|ruf|handy|电话|手机|联系|短信|拨打|热线)\W{0,3}[^.!?。！？\n]{0,24}$", re.I)
_THINGS = r"(?:order|auftrag|订单|trace|链路号|流水|epoch|时间戳|port|端口|build|version|release|tag|hash|checksum|ticket|工单号|单号|uid|offset)"
_NUMBER_DECOY = re.compile(_THINGS + r"\W{0,3}$", re.I)
_NUMBER_DECOY_AFTER = re.compile(rf"^\s*(?:(?:is|was|ist|war|als) (?:the |a |an |our |der |die |das )?{_THINGS}\b|ms\b|bytes|rows|handles|records|毫秒|条|次|个)", re.I)
_ID_CUE = re.compile(r"(?:\bid|ident\w*|number|ausweis\w*|passport|social|insurance|national|证件|身份证|证件号|号码)\W{0,4}(?:号|nummer|number|id)?\W{0,3}$", re.I)
_ID_CUE_AFTER = re.compile(r"^\s*(?:这个|是)?(?:身份证|证件)")
_NAME_CUE = re.compile(
    r"(?:\b(?:sp[eo]a?ke?n? (?:with|to)|talk(?:ed|s)? (?:to|with)|(?:asked|told|tell|met|meet|paged|called|emailed|pinged|contact(?:ed)?|thank|ask|cc|dear|hi|hello) |according to|assigned to|(?:approved|reported|signed|written|opened|handled|owned|sent|raised|fixed) by|on behalf of|belongs to|"
    r"thanks,|regards,|cheers,|sincerely,|owner|assignee|contact|name|user|customer|colleague|engineer|manager|laut|danke,|gruß,|grüße,|kolleg(?:e|in)|benutzer(?:in)?|kund(?:e|in)|herrn?|frau|selon|señora?|(?-i:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?|M\.|Mme))\s*[:：]?|"
    r"(?:我是|我叫|本人|麻烦|请|找|问|问过|联系|通知|告诉|谢谢|感谢|和|跟|与|由|让|同事|同学|老师|经理|主管|组长|[人员者长师][:：]|是)|--\s*\n)\s*$", re.I
)
_NAME_CUE_AFTER = re.compile(
    r"^(?:['’]s\b|\s*(?:[a-z]{3,}ed|said|says|wrote|writes|found|saw|told|took|sent|got|made|knows?|thinks?|can(?:not|'t)?|could|will|would|has|had|is|was|does|did|for [a-z]+|about|it was|hat|habe|war|ist|wurde|lag|sagte?|meldete?|schrieb|kann|meint[e]?|a [a-z]+é|est|était|dit)\b|"
    r"\s*[/,]?\s*\n?\s*(?:[A-Z]{2,4}\b|运维|研发|测试|开发|产品)|\s*<[^>\s]*|"
    r"\s*(?:审批|提的|提出|确认|批准|反馈|处理|说|表示|认为|负责|先生|女士|老师|经理|同学|这边|的工单|的账号|，))"
)
_NAME_DECOY_AFTER = re.compile(r"^\s*(?:shows? (?:nothing|no)|dashboard|release|service|cluster|version)\b", re.I)
# Words that begin sentences or come before names, and aren't parts of names.
_PLAIN = set(
    "thanks hello hi hallo morning guten tag please regards danke laut user according assigned we the when until since if "
    "about note it an a in on at to with by for and or how why what which that this there here is are was were my no not "
    "from clients errors load lag our i you he she they tel call sms id ask der die das ein eine wir um weil nachdem bitte "
    "yesterday today tomorrow later earlier then now once could can will would should did does has have hat gestern heute dann danach hier dort ici demain "
    "im auf mit von sre noc dba hr checked urgent quick likely befund auftrag schrank reihe".split()
)
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’-][A-Za-zÀ-ɏ]+)*")
_HAN = re.compile(r"[㐀-鿿]{1,4}")
# What introduces a person; what such words may be followed by when a name ends.
_HAN_CUE = re.compile(r"(?=[我本麻请找联通告谢感问和跟由让给工同老经主组人员者长师])(?:我是|我叫|本人|麻烦找|请找|找到|找|请|联系|通知|告诉|谢谢|感谢|问过|和|跟|由|让|给|工单是|同事|同学|老师|经理|主管|组长|[人员者长师][:：])")
_HAN_STRONG = re.compile(r"(?:我是|我叫|本人|找|联系|通知|告诉|谢谢|感谢|问过|已经和|已经跟|工单是|同事|同学|老师|经理|主管|组长|[人员者长师][:：]) ?$")
_HAN_END = re.compile(r"审批|提的|提出|确认|批准|反馈|处理|说|表示|认为|负责|先生|女士|这边|[，。！？；、,!?;\s]|$")
# Characters that verbs, particles and adverbs behind a name begin with, and ones before a name.
_HAN_VERBS = set("把被说在今昨明已刚去来给对和跟与也都又还要会能就将从向让的是有没不请反提确审批处负发重改换查看修关开上下打做写回报问认表先女")
_HAN_BEFORES = set("和跟与由让给找请问叫是被把对向同约天午才前后事学师理")
# Characters that given names rarely have, and what common words a family name is part of.
_HAN_NO_GIVEN = set("的了在把被从于是由因到不没有后之与也就都已而以及但如果其这那还并让对为将时只按个共约每我你他她它们什么吗呢吧啊很再又号次条台件种")
_HAN_WORDS = re.compile(r"[时分秒闹]钟|钟[内后前头点表漂]|[进线流工课日远编过路行单全]程|程[序度式]|[升低高体室降气水恒]温|温度|[登大着]陆|陆[续地军]|[回照不兼只]顾|顾[客问虑]|[日南]韩|江苏|苏打|祝贺|贺[卡岁]|[孟]加拉|阮[咸]|邮[件箱]|褚[衣]")


def _date(text: str) -> bool:
    y, m, d = int(text[:4]), int(text[4:6]), int(text[6:8])
    return 1900 <= y <= 2035 and 1 <= m <= 12 and 1 <= d <= 31


def _check_digit(digits: str) -> bool:
    """The check character of a resident identity number, by its public rule."""
    total = sum(int(c) * (pow(2, 17 - k, 11)) for k, c in enumerate(digits[:17]))
    return "10X98765432"[total % 11] == digits[17].upper()


class Names:
    """What a list of name parts tells: the parts themselves, and the endings that families have in common."""

    def __init__(self, parts: list[tuple[str, str]]) -> None:
        self.family = {p.lower() for p, kind in parts if kind == "family" and p.isascii()}
        self.given = {p.lower() for p, kind in parts if kind == "given" and p.isascii()}
        self.han = {p for p, kind in parts if kind == "family" and not p.isascii()}
        self.surname = re.compile("|".join(sorted(map(re.escape, self.han), key=lambda p: -len(p)))) if self.han else None
        ends = Counter(p[-n:] for p in self.family for n in (4, 5, 6) if len(p) > n + 1)
        self.endings = {e for e, n in ends.items() if n >= 4}
        self.seen: dict[str, float] = {}

    def odds(self, word: str) -> float:
        """The log-odds that a word's looks give; below zero if it is no candidate at all."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            found = self.seen[word] = self._odds(word)
        return found

    def _odds(self, word: str) -> float:
        low = word.lower()
        if len(word) == 1:
            return 0.0 if word.isupper() else -1.0
        if low in _PLAIN:
            return -1.0
        score = 0.0
        for part in low.split("-"):
            if part in self.family:
                score += FAMILY
            elif part in self.given:
                # Short parts are often ordinary words too.
                score += GIVEN if len(part) > 5 else ORDINARY
            elif any(part[-n:] in self.endings and len(part) > n + 1 for n in (4, 5, 6)):
                score += ENDING
        if not score and not word[0].isupper():
            return -1.0
        return min(score, FAMILY + 1) + (CAPITAL if word[0].isupper() and len(word) > 1 else 0.0)


def _patterned(text: str) -> list[_Node]:
    out = []
    if "@" in text or "＠" in text or " at " in text or "at]" in text or "at)" in text:
        out += [_Node("email", m.start(), m.end(), BIAS["email"]) for m in EMAIL.finditer(text)]
    if not _SOME_DIGIT.search(text):
        return out
    for hints, pattern in ADDRESSES:
        if any(w in text for w in hints):
            out += [_Node("address", m.start(), m.end(), BIAS["address"]) for m in pattern.finditer(text)]
    if not _NUMBER.search(text):
        return out
    for name, pattern in IDS:
        for m in pattern.finditer(text):
            value, before, behind = m[0], text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 30]
            odds = BIAS["id_number"]
            if name == "resident":
                digits = re.sub(r"[ -]", "", value)
                odds += CHECKED if _date(digits[6:14]) else 2 * UNCHECKED
                odds += CHECKED if _check_digit(digits) else -CHECKED / 2
            elif name == "lettered":
                odds -= 1.0
            odds += CUE if _ID_CUE.search(before) or _ID_CUE_AFTER.search(behind) else 0.0
            odds += DECOY if _NUMBER_DECOY.search(before) or _NUMBER_DECOY_AFTER.search(behind) else 0.0
            out.append(_Node("id_number", m.start(), m.end(), odds))
    for k, pattern in enumerate(PHONES):
        for m in pattern.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if not 7 <= digits <= 15:
                continue
            before, behind = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 30]
            odds = BIAS["phone"] - (1.0 if k >= 4 else 0.0)
            odds += CUE if _PHONE_CUE.search(before) else 0.0
            odds += DECOY if _NUMBER_DECOY.search(before) or _NUMBER_DECOY_AFTER.search(behind) else 0.0
            out.append(_Node("phone", m.start(), m.end(), odds))
    return out


def _latin_names(text: str, names: Names, taken: list[_Node]) -> list[list[_Node]]:
    """Runs of words that may be the parts of one name."""
    runs, run = [], []
    odds = names.odds
    for m in _LATIN.finditer(text):
        # I is a word, unless it is an initial.
        alone = m[0] == "I" and text[m.end() : m.end() + 1] != "."
        if alone or odds(m[0]) < 0 or any(t.start <= m.start() < t.end for t in taken):
            if run:
                runs.append(run)
                run = []
            continue
        if run:
            between = text[run[-1].end() : m.start()]
            # A comma joins a family name to the given name behind it, and nothing else.
            if not (between == " " or between == ". " and run[-1].end() - run[-1].start() == 1 or between == ", " and len(run) == 1):
                runs.append(run)
                run = []
        run.append(m)
    if run:
        runs.append(run)
    out, passed = [], []
    for r in runs:
        scores = [odds(m[0]) for m in r]
        before = text[max(0, r[0].start() - 30) : r[0].start()]
        behind = text[r[-1].end() : r[-1].end() + 40]
        cue, end = bool(_NAME_CUE.search(before)), bool(_NAME_CUE_AFTER.search(behind))
        if max(scores) < ORDINARY and not (cue and end) and not (len(r) >= 2 and (cue or end)):
            passed.append(r)
            continue
        more = (CUE if cue else 0.0) + (CUE if end else 0.0) + (DECOY if _NAME_DECOY_AFTER.search(behind) else 0.0)
        if len(r) == 1 and not (cue or end):
            more -= 1.0
        # A capital or an initial right before a family name is most likely a given name.
        family = [s >= FAMILY for s in scores[1:]] + [False]
        pairs = [PARTNER if f and m[0][0].isupper() else 0.0 for m, f in zip(r, family)]
        out.append([_Node("name", m.start(), m.end(), BIAS["name"] + s + more + p) for m, s, p in zip(r, scores, pairs)])
    # Further mentions of the same words, without words that tell.
    known = {text[n.start : n.end] for run in out for n in run if n.end - n.start > 1}
    for r in passed:
        again = [_Node("name", m.start(), m.end(), BIAS["name"] + odds(m[0]) + REPEAT) for m in r if m[0] in known]
        if again and not _NAME_DECOY_AFTER.search(text[r[-1].end() : r[-1].end() + 40]):
            out.append(again)
    return out


def _han_names(text: str, names: Names) -> list[_Node]:
    """Words of Han script that may be names: behind what introduces a person, or from a listed family name on."""
    found: dict[tuple[int, int], float] = {}
    if text.isascii():
        return []
    for cue in _HAN_CUE.finditer(text):
        at = cue.end() + (text[cue.end() : cue.end() + 1] == " ")
        m = _HAN.match(text, at)
        if not m or len(m[0]) < 2 or not _HAN_STRONG.search(text, 0, cue.end()):
            continue
        for size in range(2, len(m[0]) + 1):
            if _HAN_END.match(text, at + size):
                if not _HAN_NO_GIVEN & set(text[at : at + size]):
                    surname = text[at : at + 2] in names.han or text[at] in names.han
                    found[at, at + size] = BIAS["name"] + 2 * CUE + (CHECKED if surname else 0.0)
                break
    for m in names.surname.finditer(text) if names.surname else ():
        at, end = m.span()
        if any(w.start() < end and w.end() > at for w in _HAN_WORDS.finditer(text, max(0, at - 1), end + 1)):
            continue
        best = None
        for size in (1, 2):
            given = text[end : end + size]
            if len(given) < size or not all("㐀" <= c <= "鿿" for c in given):
                break
            odds = _han_odds(text, at, end + size, given)
            # Of two lengths the likelier; of equally likely ones the longer.
            if best is None or odds >= best[0]:
                best = odds, end + size
        if best and not any(a < best[1] and b > at for a, b in found):
            found[at, best[1]] = best[0]
    out = [_Node("name", a, b, odds) for (a, b), odds in found.items() if odds > BIAS["name"]]
    # Mentions of the same names elsewhere, without words that tell.
    for value in {text[n.start : n.end] for n in out if n.odds > 0}:
        for m in re.finditer(re.escape(value), text):
            if not any(n.start < m.end() and n.end > m.start() for n in out):
                out.append(_Node("name", m.start(), m.end(), BIAS["name"] + (CHECKED + 1.0 if value[0] in names.han else REPEAT)))
    return out


def _han_odds(text: str, start: int, end: int, given: str) -> float:
    """The log-odds of a listed family name with so many further characters, by them and by what stands around."""
    odds = BIAS["name"] + HAN_FAMILY
    before, behind = text[start - 1 : start], text[end : end + 1]
    if not "㐀" <= before <= "鿿":
        odds += HAN_EDGE
    elif before in _HAN_BEFORES:
        odds += HAN_BEFORE
    if _HAN_STRONG.search(text, max(0, start - 6), start):
        odds += HAN_BEFORE
    if not "㐀" <= behind <= "鿿":
        odds += HAN_EDGE
    elif behind in _HAN_VERBS:
        odds += HAN_BEHIND
    if len(given) > 1 and given[-1] in _HAN_VERBS:
        odds -= HAN_BEHIND
    return odds + HAN_RARE * len(_HAN_NO_GIVEN & set(given))


def settle(nodes: list[_Node], edges: list[tuple[int, int, float]]) -> list[float]:
    """The log-odds of each node after loopy message passing over attracting edges."""
    near: list[list[tuple[int, float]]] = [[] for _ in nodes]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    sent = {(a, b): 0.0 for a, list_ in enumerate(near) for b, _ in list_}
    belief = [n.odds for n in nodes]
    for _ in range(ROUNDS):
        fresh = {}
        for a, list_ in enumerate(near):
            for b, w in list_:
                rest = max(-50.0, min(50.0, belief[a] - sent[b, a]))
                # Log-odds of b from a alone, where agreeing weighs w more than differing.
                fresh[a, b] = math.log((math.exp(rest + w) + 1) / (math.exp(rest) + math.exp(w)))
        change = max((abs(m - sent[e]) for e, m in fresh.items()), default=0.0)
        sent = fresh
        belief = [n.odds + sum(sent[b, a] for b, _ in near[a]) for a, n in enumerate(nodes)]
        if change < CLOSE:
            break
    return belief


def _alike(word: str) -> str:
    """What a word has in common with words that are alike: case, accents and a possessive ending don't count."""
    low = word.lower()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return low[:-2] if low.endswith(("'s", "’s")) else low


def entities(text: str | None, names: Names) -> list[Entity]:
    """The entities of a text in order, none overlapping another."""
    if not text or text.isspace():
        return []
    nodes = _patterned(text)
    taken = [n for n in nodes if n.kind in ("email", "address")]
    edges: list[tuple[int, int, float]] = []
    runs = _latin_names(text, names, taken)
    for run in runs:
        for k, n in enumerate(run):
            if k:
                edges.append((len(nodes) - 1, len(nodes), CHAIN))
            nodes.append(n)
    nodes += _han_names(text, names)
    if not nodes:
        return []
    alike: dict[tuple[str, str], list[int]] = {}
    for k, n in enumerate(nodes):
        if n.end - n.start > 1:
            alike.setdefault((n.kind, _alike(text[n.start : n.end])), []).append(k)
    for (kind, _), mentions in alike.items():
        if len(mentions) > 1:
            # One node that all mentions share, so that each reaches every other in two steps. What speaks against
            # mentions without telling words is that the word is rarely a name, which counts once for all of them.
            edges += [(k, len(nodes), SKIP) for k in mentions]
            against = [k for k in mentions if nodes[k].odds < 0]
            for k in against:
                nodes[k] = nodes[k]._replace(odds=nodes[k].odds / len(against))
            nodes.append(_Node(kind, -1, -1, 0.0))
    odds = settle(nodes, edges) if edges else [n.odds for n in nodes]
    kept = sorted(((n.start - n.end, n.start, -o, n) for n, o in zip(nodes, odds) if o > 0 and n.end > 0), key=lambda k: k[:3])
    out: list[_Node] = []
    for *_, n in kept:
        if all(n.end <= o.start or n.start >= o.end for o in out):
            out.append(n)
    out.sort(key=lambda n: n.start)
    # Parts of one name are one entity.
    joined: list[Entity] = []
    for n in out:
        last = joined[-1] if joined else None
        if last and n.kind == last.kind == "name" and re.fullmatch(r"[., ]{1,2}", text[last.end : n.start]):
            joined[-1] = Entity("name", last.start, n.end)
        else:
            joined.append(Entity(n.kind, n.start, n.end))
    return joined


def masked(text: str, found: list[Entity]) -> str:
    """The text with each entity replaced by the placeholder of its kind."""
    out, at = [], 0
    for e in found:
        out += [text[at : e.start], PLACEHOLDER[e.kind]]
        at = e.end
    return "".join([*out, text[at:]])


def _known_names(name_parts: DataFrame) -> list[tuple[str, str]]:
    """The list of name parts. It is fixed and small; a longer one than could be broadcast safely is refused."""
    rows = name_parts.select("name_part", "part_kind").dropna().distinct().limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} name parts")
    return sorted((r.name_part, r.part_kind) for r in rows)


#: Name parts that are held by every worker.
MOST_PARTS = 200_000


def find(df: DataFrame, text: str, keep: list[str], name_parts: DataFrame) -> DataFrame:
    """(*keep, kind, start, end, value) of each entity in the column ``text`` of df."""
    known = _known_names(name_parts)

    # In Arrow, as pandas makes floats of whole numbers beside a null, which changes large keys or can't be turned back.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(known)
        for batch in batches:
            at, kinds, starts, ends, values = [], [], [], [], []
            for row, value in enumerate(batch.column("__text").to_pylist()):
                for e in entities(value, names):
                    at.append(row)
                    kinds.append(e.kind)
                    starts.append(e.start)
                    ends.append(e.end)
                    values.append(value[e.start : e.end])
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in keep]
            found = [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[*keep, "kind", "start", "end", "value"])

    rows = df.select(*keep, F.col(text).alias("__text")).filter(F.col("__text").isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return rows.mapInArrow(run, f"{schema}, kind string, start int, end int, value string")


def mask(df: DataFrame, text: str, out: str, name_parts: DataFrame) -> DataFrame:
    """df with ``out``, the column ``text`` with every entity replaced by a placeholder; null stays null."""
    known = _known_names(name_parts)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = Names(known)
        for s in parts:
            yield s.map(lambda t: t if t is None else masked(t, entities(t, names)))

    return df.withColumn(out, run(F.col(text)))
