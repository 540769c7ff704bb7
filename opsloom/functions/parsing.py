"""Structure out of written answers: report sections, action items, lists of variants, JSON inside prose.

Texts without the structure looked for give empty arrays or null; null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section titles of a report and the fields they stand for, and words for how sure it is.
SECTIONS = {"现象": "symptom", "证据": "evidence", "根因": "root_cause", "解决方案": "solution", "置信度": "confidence"}
SURENESS = {"高": "high", "中": "medium", "低": "low"}


def section(text: Column, title: str) -> Column:
    """The body under ``### title`` up to the next heading of that depth, without blanks around it."""
    body = F.regexp_extract(text, rf"(?:^|\n)###\s+{title}[^\n]*\n([\s\S]*?)(?=\n###\s|$)", 1)
    return F.nullif(F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit(""))


def report(text: Column) -> Column:
    """A report as a struct of its sections, with its sureness told by the first ten characters of that section."""
    fields = [section(text, title).alias(name) for title, name in SECTIONS.items()]
    head = F.substring(section(text, "置信度"), 1, 10)
    sure = F.lit(None).cast("string")
    for word, level in reversed(SURENESS.items()):
        sure = F.when(F.contains(head, F.lit(word)), level).otherwise(sure)
    return F.struct(*fields, sure.alias("confidence_level"))


def action_items(text: Column) -> Column:
    """The bullets of the section on action items as structs of category, text, owner and deadline."""
    part = F.regexp_extract(text, r"(?:^|\n)#{2,4}\s*行动项[^\n]*\n([\s\S]*?)(?=\n#{2,4}\s|$)", 1)
    bullets = F.filter(F.split(part, "\n"), lambda x: x.rlike(r"^\s*(?:[-*+]|\d+[.)、])\s+\S"))

    def item(line: Column) -> Column:
        plain = F.regexp_replace(line, r"^\s*(?:[-*+]|\d+[.)、])\s+", "")
        found = lambda p: F.nullif(F.regexp_extract(plain, p, 1), F.lit(""))
        return F.struct(
            F.coalesce(found(r"【([^】]+)】"), F.lit("其他")).alias("category"),
            F.regexp_replace(F.regexp_replace(plain, r"【[^】]+】", ""), r"^\s+|\s+$", "").alias("text"),
            found(r"(?:负责人|owner)[:：]\s*([^,，;；。)）\s]+)").alias("owner"),
            found(r"(?:截止|期限|deadline)[^:：]{0,4}[:：]\s*([^,，;；。)）\s]+)").alias("deadline"),
        )

    return F.transform(bullets, item)


def variants(text: Column) -> Column:
    """The lines of a list without numbering, bullets and quotes; empty lines and repeats are dropped."""
    plain = F.transform(
        F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*(?:\d+[.)、:]|[-*+•])\s*", ""), "^[\\s\"'“”‘’]+|[\\s\"'“”‘’]+$", "")
    )
    return F.array_distinct(F.filter(plain, lambda x: x != ""))


def json_part(text: Column, kind: str = "object") -> Column:
    """The first JSON object or list inside prose or a code fence, as a variant; null if there is none that is valid."""
    pattern = r"(\{[\s\S]*\})" if kind == "object" else r"(\[[\s\S]*\])"
    return F.try_parse_json(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))


def closed(synonyms: dict[str, list[str]]) -> dict[str, set[str]]:
    """Every term with all terms that share an entry with it."""
    out: dict[str, set[str]] = {}
    for term, others in synonyms.items():
        group = {term.lower(), *(o.lower() for o in others)}
        for t in group:
            out.setdefault(t, set()).update(group - {t})
    return out


def expansions(text: Column, synonyms: dict[str, list[str]]) -> Column:
    """The sorted synonyms of the terms in a text that it doesn't hold itself, in both directions.

    Terms of ASCII letters count as whole words, others anywhere. synonyms is closed first: terms that share an entry are
    synonyms of each other.
    """
    every = closed(synonyms)
    low = F.lower(text)

    def holds(term: str) -> Column:
        if term.isascii():
            literal = "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)
            return low.rlike(rf"(?:^|[^a-z0-9_]){literal}(?:$|[^a-z0-9_])")
        return F.contains(low, F.lit(term))

    parts = [F.when(holds(t) & ~holds(s), F.lit(s)) for t in sorted(every) for s in sorted(every[t])]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))) if parts else F.array().cast("array<string>")
