"""Variants of a query, as arrays with the query itself first; and vectors of texts.

An empty or null query has no variants but itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom.functions import parsing, text

# Endings of questions, words that carry nothing, and synonyms of the domain.
SUFFIXES = ["怎么学", "怎么用", "是什么", "怎么理解", "如何", "为什么", "怎么办", "什么意思", "怎么实现"]
STOP_WORDS = ["的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "那", "吗", "呢", "吧", "啊", "请", "帮"]
SYNONYMS = {"docker": ["container", "容器化"], "git": ["version control", "版本控制"], "sql": ["database", "数据库"], "api": ["接口"], "jwt": ["token", "认证"], "镜像": ["image"], "分支": ["branch"], "提交": ["commit"], "lru": ["lru_cache"]}


def basic(query: Column) -> Column:
    """The query, the query without each ending that it has, and its words without those that carry nothing."""
    whole = F.trim(query)
    cut = [F.when(F.endswith(query, F.lit(s)) & (F.length(query) > len(s)), F.trim(F.left(query, F.length(query) - len(s)))) for s in SUFFIXES]
    terms = text.word_tokens(query)
    words = F.filter(terms, lambda t: ~t.isin(STOP_WORDS))
    fewer = F.when((F.size(terms) >= 2) & (F.size(words) > 0) & (F.size(words) < F.size(terms)), F.array_join(words, " "))
    return _distinct(query, F.array(whole, *cut, fewer))


def enhanced(query: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """The basic variants, the query with its synonyms, and its words each with their synonyms."""
    low = F.lower(F.trim(query))
    more = parsing.expansions(query, synonyms)
    expanded = F.when(F.size(more) > 0, F.concat_ws(" ", low, F.array_join(more, " ")))
    words = F.filter(text.word_tokens(low), lambda t: ~t.isin(STOP_WORDS))
    closed = parsing.closed(synonyms)
    table = F.create_map(*(x for t, others in sorted(closed.items()) for x in (F.lit(t), F.array(*map(F.lit, sorted(others))))))
    each = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>")))))
    keywords = F.nullif(F.array_join(F.array_distinct(each), " "), F.lit(""))
    return _distinct(query, F.concat(basic(query), F.array(expanded, keywords)))


def _distinct(query: Column, variants: Column) -> Column:
    blank = F.coalesce(F.trim(query), F.lit("")) == ""
    return F.when(blank, F.array(query)).otherwise(F.array_distinct(F.filter(variants, lambda v: v.isNotNull() & (v != ""))))


def similar_enough(variants: Column, vectors: Column, query: Column, cosine: Callable[[Column, Column], Column], least: float, most: int) -> Column:
    """Variants whose vector is near the query's, all of them if none is, and no more than ``most``."""
    near = F.filter(F.arrays_zip(variants.alias("t"), vectors.alias("v")), lambda x: cosine(x["v"], query) >= least)
    kept = F.transform(near, lambda x: x["t"])
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(variants), 1, most)


#: Dimensions of the default vectors.
DIMENSIONS = 128
_TOKEN = re.compile("[a-zA-Z0-9_一-龥]+")


def _hashed(token: str) -> tuple[int, int]:
    n = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
    return n % DIMENSIONS, 1 - 2 * (n // DIMENSIONS % 2)


def hashing(value: Column) -> Column:
    """A text's words counted with signs in hashed places: vectors without a model. Null gives null."""

    @F.pandas_udf("array<float>")
    def embed(values: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, int]] = {}
        out = []
        for t in values:
            if t is None:
                out.append(None)
                continue
            v = np.zeros(DIMENSIONS, np.float32)
            for token in _TOKEN.findall(t):
                if token not in known:
                    known[token] = _hashed(token)
                at, sign = known[token]
                v[at] += sign
            out.append(v)
        return pd.Series(out, dtype=object)

    return embed(F.lower(value))


#: Embedding models by name, each from a text column to a vector column; further ones can be put in.
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"hashing": hashing}
