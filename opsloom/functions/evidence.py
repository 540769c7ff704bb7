"""Evidence out of tools' answers in JSON, conflict rules of memories, questions that lean on others, texts for prompts.

What isn't valid JSON, or has none of the known shapes, gives null; null gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of questions that lean on what was said before, and how clear questions are put.
REFERENCE_WORDS = ["它", "它们", "这个", "那个", "这两个", "上面", "下面", "他", "她", "其", "此", "该", "刚才", "之前提到的", "前面提到", "上文", "之前的", "上面的", "it", "this", "that", "these", "those", "above", "below"]
CONTEXT_WORDS = ["继续", "再说", "详细", "具体", "比如", "举个例子", "进一步", "深入", "展开", "补充", "还有呢", "然后呢", "为什么", "怎么办", "怎么回事"]
CLEAR = "什么是.+|怎样.+|如何.+|怎么.+|为什么.+|哪些.+|列举.+|解释.+|描述.+|对比.+和.+|比较.+和.+|what\\s+is|how\\s+to|why|explain"
# Words and what is said for the contrary.
NEGATIONS = [("喜欢", "不喜欢"), ("喜欢", "讨厌"), ("喜欢", "不想"), ("擅长", "不擅长"), ("擅长", "不熟悉"), ("擅长", "弱"), ("了解", "不了解"), ("了解", "不熟悉"), ("是", "不是"), ("是", "并非"), ("会", "不会"), ("能", "不能"), ("需要", "不需要"), ("要", "不要"), ("好", "不好"), ("强", "弱"), ("多", "少"), ("高", "低")]
ATTRIBUTE = "([一-鿿]+)(\\d+|[一二三四五六七八九十百千万零]+)"
IMAGE_WORDS = ["图片", "截图", "架构图", "示意图", "image", "screenshot", "diagram"]


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def leans_on_history(text: Column, turns: Column, shortest: int = 10) -> Column:
    """Whether a question has to be rewritten: never without two turns before it; always with a word that refers or goes
    on; never when put clearly; else when it is short and holds no word of two letters or three Han characters."""
    low = F.lower(F.trim(text))
    noun = text.rlike("[A-Za-z]{2,}|[一-鿿]{3,}")
    asks = F.when(turns < 2, False).when(_any(low, REFERENCE_WORDS) | _any(low, CONTEXT_WORDS), True).when(low.rlike(CLEAR), False)
    return F.coalesce(asks.otherwise((F.length(text) < shortest) & ~noun), F.lit(False))


def is_image_chunk(content: Column, title: Column, metadata: Column, keys: tuple[str, ...] = ("image_path", "image_type")) -> Column:
    """Whether a chunk is about an image: by a key of its metadata, or a word of its content or title."""
    keyed = reduce(lambda a, b: a | b, (F.coalesce(F.map_contains_key(metadata, F.lit(k)), F.lit(False)) for k in keys))
    return keyed | _any(F.coalesce(content, F.lit("")), IMAGE_WORDS) | _any(F.coalesce(title, F.lit("")), IMAGE_WORDS)


def metric_evidence(json: Column) -> Column:
    """struct(shape, service, names, value): five shapes of a metric tool's answer; null for errors and other texts.

    The shapes are told in order: ``metrics`` without a service, ``metrics`` with one, ``values``, ``series``, ``value``.
    """
    v = F.try_parse_json(json)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    service = get("$.service", "string")
    listed = get("$.metrics", "array<struct<name:string,value:double>>")
    mapped = get("$.metrics", "map<string,double>")
    values = get("$.values", "array<double>")
    series = get("$.series", "array<struct<name:string,points:array<array<double>>>>")
    single = get("$.value", "double")
    named = lambda shape, names, value: F.struct(F.lit(shape).alias("shape"), service.alias("service"), names.alias("names"), value.alias("value"))
    last = F.try_element_at(F.try_element_at(series, F.lit(1))["points"], F.lit(-1))
    return F.when(
        get("$.error", "string").isNull(),
        F.when(mapped.isNotNull() & service.isNull(), named("map", F.array_join(F.array_sort(F.map_keys(mapped)), ","), F.array_max(F.map_values(mapped))))
        .when(listed.isNotNull(), named("list", F.array_join(F.transform(listed, lambda m: m["name"]), ","), F.array_max(F.transform(listed, lambda m: m["value"]))))
        .when(values.isNotNull(), named("values", F.lit(""), F.try_element_at(values, F.lit(-1))))
        .when(series.isNotNull(), named("series", F.array_join(F.transform(series, lambda s: s["name"]), ","), F.try_element_at(last, F.lit(2))))
        .when(single.isNotNull(), named("single", F.coalesce(get("$.metric", "string"), F.lit("")), single)),
    )


def log_evidence(json: Column, most: int = 5) -> Column:
    """struct(count, head): how many lines a log tool gave, as texts or as structs, and the first of them."""
    v = F.try_parse_json(json)
    plain = F.try_variant_get(v, "$.logs", "array<string>")
    structs = F.try_variant_get(v, "$.logs", "array<struct<container:string,line:string>>")
    lines = F.when(F.exists(structs, lambda x: x["line"].isNotNull()), F.transform(structs, lambda x: F.concat_ws(" ", F.concat(F.lit("["), x["container"], F.lit("]")), x["line"]))).otherwise(plain)
    return F.when(lines.isNotNull(), F.struct(F.size(lines).alias("count"), F.array_join(F.slice(lines, 1, most), "\n").alias("head")))


def words_of(text: Column) -> Column:
    """The parts of a text between punctuation and blanks that have more than one character."""
    return F.array_distinct(F.filter(F.split(text, r"[，。！？、\s]+"), lambda w: F.length(w) > 1))


def negates(a: Column, b: Column) -> Column:
    """Whether one text holds a word and the other its contrary."""
    has = lambda text, w: F.contains(text, F.lit(w))
    return reduce(lambda x, y: x | y, ((has(a, p) & has(b, n)) | (has(a, n) & has(b, p)) for p, n in NEGATIONS))


def attribute(text: Column, part: int) -> Column:
    """What a text says a number of (1), and the number (2): its first Han words with digits behind them."""
    return F.nullif(F.regexp_extract(text, ATTRIBUTE, part), F.lit(""))


def keyword_score(query: Column, content: Column, tags: Column) -> Column:
    """3 if a query stands in the content, and 1 for each tag that holds it."""
    q = F.lower(query)
    tagged = F.size(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), q)))
    return F.when(F.contains(F.lower(content), q), 3).otherwise(0) + tagged


def citation(number: Column, title: Column, content: Column, most: int = 600) -> Column:
    """``[i] title`` and the beginning of the content below it."""
    return F.concat(F.lit("["), number, F.lit("] "), F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(content, F.lit("")), 1, most))


def truncated(text: Column, tokens: int) -> Column:
    """A text cut to a budget of tokens: two characters for each."""
    return F.substring(text, 1, 2 * tokens)


def board(kinds: Column, summaries: Column) -> Column:
    """The lines of an evidence board: a number, the kind and the summary of each."""
    pairs = F.arrays_zip(kinds.alias("kind"), summaries.alias("summary"))
    return F.array_join(F.transform(pairs, lambda x, n: F.concat((n + 1).cast("string"), F.lit(". ["), x["kind"], F.lit("] "), x["summary"])), "\n")
