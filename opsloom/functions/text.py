"""Text functions as column expressions: tokenizers, cleaning, language, sizes, hashes.

All of them give null for null. Regular expressions name their character classes, as Java and other engines differ in
what ``\\w`` and ``\\b`` cover.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "一-鿿"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _replaced(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script, in order."""
    return _all(F.lower(text), r"[\p{L}\p{N}_]+")


# Words that carry nothing.
STOP_WORDS = ["的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这"]


def mixed_tokens(text: Column) -> Column:
    """Lower-case ASCII words, then runs of other letters and digits of two characters and more that carry something."""
    low = F.lower(text)
    rest = _all(F.regexp_replace(low, "[a-z]+", " "), r"[\p{L}\p{N}_]+")
    return F.concat(_all(low, "[a-z]+"), F.filter(rest, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)))


def eval_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits, underscores and Han characters, in order."""
    return _all(text, "[a-zA-Z0-9_一-龥]+")


def tfidf_tokens(text: Column) -> Column:
    """Lower-case ASCII words, then each Han character, then each pair of neighbours among the Han characters."""
    han = _all(text, f"[{HAN}]")
    more = F.greatest(F.size(han) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(han, 1, more), F.slice(han, 2, more), lambda a, b: F.concat(a, b))
    return F.concat(_all(F.lower(text), "[a-z]+"), han, pairs)


# The steps from Markdown to plain text, in their order.
MARKDOWN_STEPS = (
    (r"```[\s\S]*?```", ""), (r"`[^`]+`", ""), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"),
    (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"(?m)^>\s+", ""), (r"(?m)^[-*_]{3,}\s*$", ""), (r"<[^>]+>", ""),
    (r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (r"^\s+|\s+$", ""),
)


def clean_markdown(text: Column) -> Column:
    """Plain text of Markdown. The order of the steps matters: links lose their marks before images are looked for."""
    return _replaced(text, *MARKDOWN_STEPS)


def clean_heading(text: Column) -> Column:
    """A heading without link marks, tags, repeated blanks and a colon at its end."""
    return _replaced(
        text, (r"\[¶\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", ""), (r"\s+", " "), (r"^ | $", ""), ("[：:]+$", "")
    )


def clean_page_text(text: Column) -> Column:
    """Text of a page layout: at most one empty line, single blanks, no control characters, one kind of line end."""
    return _replaced(
        text, (r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), (r"\r\n?", "\n"), (r"^\s+|\s+$", "")
    )


def paragraphs(text: Column, longest: int = 1000) -> Column:
    """Paragraphs between empty lines; ones beyond ``longest`` are cut behind sentence marks of Chinese."""
    trimmed = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    cut = lambda p: F.when(F.length(p) > longest, _all(p, "[^。！？；]*[。！？；]|[^。！？；]+$")).otherwise(F.array(p))
    whole = F.transform(F.split(text, r"\n\s*\n"), trimmed)
    return F.filter(F.transform(F.flatten(F.transform(whole, cut)), trimmed), lambda p: p != "")


def language(text: Column) -> Column:
    """zh or en by which has more characters, mixed if neither has."""
    zh, en = F.regexp_count(text, F.lit(f"[{HAN}]")), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.when(zh > en, "zh").when(en > zh, "en").when(text.isNotNull(), "mixed")


def markdown_score(text: Column, lines: int = 50) -> Column:
    """How much the first lines look like Markdown: headings and fences count 2, links, lists and quotes 1."""
    first = F.transform(F.slice(F.split(text, "\n"), 1, lines), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    one = lambda found, n: F.when(found, n).otherwise(0)

    def score(x: Column) -> Column:
        return (
            one(x.rlike(r"^#{1,6}\s+"), 2) + one(x.startswith("```"), 2) + one(x.rlike(r"\[.*?\]\(.*?\)"), 1)
            + one(x.rlike(r"^[-*+]\s+"), 1) + one(x.startswith(">"), 1)
        )

    return F.aggregate(F.transform(first, score), F.lit(0), lambda a, b: a + b)


def single_blanks(text: Column) -> Column:
    return _replaced(text, (r"\s+", " "), (r"^ | $", ""))


def token_estimate(text: Column) -> Column:
    """1.5 tokens for each Han character and a quarter for any other, cut to a whole number."""
    han = F.regexp_count(text, F.lit(f"[{HAN}]"))
    return (han * 1.5 + (F.length(text) - han) / 4).cast("int")


def content_id(text: Column) -> Column:
    """First 16 hexadecimal digits of the MD5."""
    return F.substring(F.md5(text), 1, 16)


def duration_seconds(text: Column, low: int = 60, high: int = 7200) -> Column:
    """Seconds of ``5m`` or ``2h``, held between low and high; null for anything else."""
    n = F.regexp_extract(text, r"^\s*(\d+)\s*([smhd])\s*$", 1).try_cast("int")
    unit = F.regexp_extract(text, r"^\s*(\d+)\s*([smhd])\s*$", 2)
    factor = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when((n * factor).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), n * factor)))


#: The windows that the reference takes of a text at most.
REFERENCE_MOST = 8


def sliding_chunks(text: Column, size: int = 400, overlap: int = 100, most: int | None = REFERENCE_MOST) -> Column:
    """Overlapping windows over a text. Where they would be more than ``most``, the stride is widened so that they reach
    from its beginning to its end; from ``most * size`` characters on the text between them is then in none. None: all."""
    n = F.length(text)
    stride = F.lit(max(1, size - overlap))
    count = lambda s: F.floor((n - size + s - 1) / s) + 1
    step = stride
    if most is not None:
        wide = F.greatest(F.lit(1), F.floor((n - size + max(1, most - 1) - 1) / max(1, most - 1)))
        step = F.when(count(stride) > most, wide).otherwise(stride).cast("int")
    many = F.transform(
        F.sequence(F.lit(0), (F.greatest(count(step), F.lit(1)) - 1).cast("int")),
        lambda k: F.substring(text, k * step + 1, F.lit(size)),
    )
    return F.when(n <= size, F.array(text)).when(n > size, many)


def metadata_union(base: Column, more: Column) -> Column:
    """Two string maps as one, the second winning, without empty values."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(more, k))
    return F.map_filter(F.map_concat(kept, more), lambda k, v: v.isNotNull() & ~v.isin("", "[]"))


def series_key(name: Column, labels: Column) -> Column:
    """``name{k=v,…}`` with sorted labels; characters that a metric name can't have become underscores."""
    safe = F.regexp_replace(name, "[^a-zA-Z0-9_:]", "_")
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.concat(safe, F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def safe_file_name(name: Column, most: int = 128, stem: int = 60) -> Column:
    """The last part of a path with underscores for control characters. Of one beyond ``most`` bytes the first ``stem``
    characters of its stem and its extension are kept; one without a name is ``unnamed``."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[\x00-\x1f\x7f]", "_")
    ext = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    cut = F.concat(F.substring(base, F.lit(1), F.least(F.lit(stem), F.length(base) - F.length(ext))), ext)
    return F.when(F.trim(base) == "", "unnamed").when(F.octet_length(base) <= most, base).otherwise(cut)
