"""Masking of credentials and personal numbers by rule, and tests for injected instructions.

Nulls stay null, and no rule matches an empty text. Masking is idempotent but for card numbers, whose mask keeps groups
of four digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules in their order. Each is a pattern and what stands in its place.
CREDENTIAL_RULES = [
    (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", "-----REDACTED PRIVATE KEY-----"),
    (r"(?<![a-zA-Z0-9])((?:sk|ak|token|key)-)([a-zA-Z0-9]{20,})(?![a-zA-Z0-9])", None),
    (r"(?<![a-zA-Z0-9])(AKIA[0-9A-Z]{4})[0-9A-Z]{12}(?![a-zA-Z0-9])", "$1****************"),
]
TEXT_RULES = [
    (r"(?<!\d)([1-9]\d{5})(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(\d{3}[\dXx])(?!\d)", "$1********$2"),
    (r"(?<!\d)(6[0-9]{3})[0-9]{8,11}([0-9]{4})(?!\d)", "$1 **** **** $2"),
    (r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)", "$1****$2"),
    (r"(?<![a-zA-Z0-9])([a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]*?@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})(?![a-zA-Z0-9])", "$1***@$2"),
    (r"(?<!\d)(10\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d{1,3}\.\d{1,3}(?!\d)", "$1.***.***"),
]
# Of each prefix, how many characters behind it stay so that eight are shown in all.
KEY_PREFIXES = {"sk-": 5, "ak-": 5, "token-": 2, "key-": 4}
CODE_SPAN = r"```[\s\S]*?```|`[^`]+`"


def _key_rule(text: Column) -> Column:
    for prefix, shown in KEY_PREFIXES.items():
        pattern = rf"(?<![a-zA-Z0-9])({prefix}[a-zA-Z0-9]{{{shown}}})(?=[a-zA-Z0-9]{{{20 - shown},}}(?![a-zA-Z0-9]))[a-zA-Z0-9]*([a-zA-Z0-9]{{4}})(?![a-zA-Z0-9])"
        text = F.regexp_replace(text, pattern, "$1***$2")
    return text


def mask_credentials(text: Column) -> Column:
    text = F.regexp_replace(text, CREDENTIAL_RULES[0][0], CREDENTIAL_RULES[0][1])
    return F.regexp_replace(_key_rule(text), CREDENTIAL_RULES[2][0], CREDENTIAL_RULES[2][1])


def mask(text: Column) -> Column:
    """All rules, in order."""
    text = mask_credentials(text)
    for pattern, by in TEXT_RULES:
        text = F.regexp_replace(text, pattern, by)
    return text


def mask_outside_code(text: Column, strict: bool = True) -> Column:
    """All rules outside code spans; inside them only those for credentials, or with ``strict`` off none."""
    spans = F.regexp_extract_all(text, F.lit(CODE_SPAN), F.lit(0))
    kept = F.transform(spans, mask_credentials) if strict else spans
    parts = F.zip_with(F.transform(F.split(text, CODE_SPAN), mask), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.isNotNull(), F.array_join(parts, ""))


def has_sensitive(text: Column) -> Column:
    found = F.lit(False)
    for pattern, _ in CREDENTIAL_RULES + TEXT_RULES:
        found = found | text.rlike(pattern)
    return found


# What a text that tries to override its reader's instructions looks like, by risk.
INJECTION_RULES = {
    "high": [
        r"(?i)(忽略|无视|跳过|不要遵守|disregard|ignore)\s*(之前的?|上面的?|前面的?|所有|任何|prior|previous|above)?\s*(的)?\s*(指令|规则|提示|系统提示|约束|instruction|rule|prompt)",
        r"(?i)(你现在是|扮演|进入|act as|you are now|pretend to be)\s*(\S{0,4}\s)?(DAN|developer|无限制|越狱|jailbreak|无约束|不受限|evil|hacker)",
        r"(?i)(开发者模式|管理员模式|root\s*模式|debug\s*模式|developer\s*mode|admin\s*mode)\s*(已启用|开启|激活|enabled|activated)",
        r"(?i)(输出|显示|告诉我|打印|reveal|show|print).{0,15}?(系统提示|指令|规则|prompt|instruction|system\s*message|system\s*prompt|system\s*instruction)",
        r"(?i)(^|\n)\s*(---|###)\s*(系统|SYSTEM|助手|ASSISTANT|指令|INSTRUCTION)\s*[:：]",
    ],
    "medium": [
        r"(?i)(不要拒绝|不要说不|不要拒绝我| do not refuse | never refuse )",
        r"(?i)(直接执行|立即执行|不要解释|直接运行| execute directly | run without )",
    ],
    "low": [r"[A-Za-z0-9+/]{60,}={0,2}", r"\\u[0-9a-fA-F]{4}"],
}
SEPARATOR = r"(?i)(^|\n)\s*(---|###)\s*(系统|SYSTEM|助手|ASSISTANT|指令|INSTRUCTION)\s*[:：][^\n]*"


def injection_risk(text: Column) -> Column:
    """high, medium, low or none: the first group with a pattern that occurs."""
    out = F.lit("none")
    for level in reversed(INJECTION_RULES):
        for pattern in reversed(INJECTION_RULES[level]):
            out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), level).otherwise(out)
    return out


def verdict(text: Column) -> Column:
    """struct(block, reason, level): whether a text is refused, by the number of the first pattern that occurs."""
    said = lambda block, reason, level: F.struct(F.lit(block).alias("block"), F.lit(reason).alias("reason"), F.lit(level).alias("level"))
    value, out = F.coalesce(text, F.lit("")), said(False, "", "none")
    rules = [(level, n, p) for level, patterns in INJECTION_RULES.items() for n, p in enumerate(patterns, 1)]
    for level, n, pattern in reversed(rules):
        out = F.when(value.rlike(pattern), said(level == "high", f"{level} {n}", level)).otherwise(out)
    return out


def content_note(text: Column) -> Column:
    """What is noted beside retrieved content, which is never refused: high and medium risks only."""
    risk = injection_risk(text)
    return F.when(risk.isin("high", "medium"), F.concat(F.lit("risk: "), risk))


def without_separators(text: Column) -> Column:
    """The text without lines that pose as another speaker's."""
    return F.regexp_replace(text, SEPARATOR, "")
