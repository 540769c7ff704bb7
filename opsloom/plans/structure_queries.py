"""Queries of the operators on parsed files' elements, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators import structure
from opsloom.sources.tables import table


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return structure.plain(table(spark, d, "elements"))


ELEMENTS = r"""
    p AS (SELECT file_id, pos, lower(trim(coalesce(element_type, ''), ' ' || chr(9))) AS kind, coalesce(text, '') AS text, coalesce(heading_path, []) AS heading_path, page_number,
      regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS bare FROM elements
      QUALIFY row_number() OVER (PARTITION BY file_id, pos ORDER BY element_type NULLS FIRST, text NULLS FIRST, heading_path NULLS FIRST, page_number NULLS FIRST) = 1)"""
_TITLES = ", ".join(f"'{w}'" for w in structure.CONTENTS)
KEPT = rf"""{ELEMENTS},
    c AS (SELECT *, CASE WHEN kind IN ('heading', 'title') AND bare <> '' THEN lower(trim(regexp_replace(bare, '^#+\s*', ''), ' ')) IN ({_TITLES}) END AS toc FROM p),
    k AS (SELECT * FROM c QUALIFY NOT (bare <> '' AND (coalesce(last_value(toc IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY pos), false)
      OR regexp_matches(bare, '{structure.NOISE[0]}') OR regexp_matches(bare, '{structure.NOISE[1]}'))))"""
MERGED = f"""{KEPT},
    t AS (SELECT *, CASE WHEN kind = 'table' THEN greatest(len(string_split(string_split(text, chr(10))[1], '|')) - 2, 0) ELSE 0 END AS cols, coalesce(page_number, 0) AS page FROM k),
    l AS (SELECT *, lag(cols, 1, 0) OVER w AS bc, lag(page, 1, 0) OVER w AS bp FROM t WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
    r AS (SELECT *, sum(CASE WHEN cols > 0 AND cols = bc AND (page = 0 OR bp = 0 OR page - bp <= 1) THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM l),
    m AS (SELECT file_id, min(pos) AS pos, arg_min(kind, pos) AS kind, string_agg(text, chr(10) ORDER BY pos) AS text, arg_min(heading_path, pos) AS heading_path, count(*) AS parts FROM r GROUP BY file_id, run)"""


def noise_filter(spark, d):
    """How many elements of each kind are left without noise."""
    kept = structure.without_noise(_elements(spark, d))
    return kept.groupBy("kind").agg(F.count("*").alias("elements"), F.count_distinct("file_id").alias("files"), F.sum(F.length("text")).alias("chars"))


NOISE_FILTER = f"WITH {KEPT} SELECT kind, count(*) AS elements, count(DISTINCT file_id) AS files, sum(length(text))::BIGINT AS chars FROM k GROUP BY 1"


def merged_tables(spark, d):
    """Tables after those that run on over pages were put together, with their shape."""
    t = structure.merged_tables(structure.without_noise(_elements(spark, d))).filter("kind = 'table'")
    return t.select("file_id", "pos", structure.table_columns(F.col("text")).alias("columns"), structure.table_rows(F.col("text")).alias("rows"), F.md5("text").alias("text"))


MERGED_TABLES = f"""WITH {MERGED} SELECT file_id, pos, greatest(len(string_split(string_split(text, chr(10))[1], '|')) - 2, 0)::INT AS columns,
    greatest(len(string_split(trim(text, ' '), chr(10))) - 2, 0)::INT AS rows, md5(text) AS text FROM m WHERE kind = 'table'"""


def file_sections(spark, d):
    """Sections of each file at the second depth of headings, with the headings' texts hashed in order."""
    e = structure.prepared(table(spark, d, "elements"))
    heads = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(structure.HEADINGS), F.struct("pos", "text")))), lambda h: h["text"]), "|")
    return e.groupBy("file_id", "section").agg(F.count("*").alias("elements"), F.sum(F.length("text")).alias("chars"), F.md5(heads).alias("headings"))


_DECORATED = " OR ".join(f"contains(lower(text), '{w}')" for w in structure.DECORATION)
FILE_SECTIONS = f"""WITH {MERGED.replace("FROM c QUALIFY NOT (", f"FROM c QUALIFY NOT (kind = 'image' AND ({_DECORATED})) AND NOT (")},
    s AS (SELECT *, greatest(sum(CASE WHEN kind = 'heading' AND len(heading_path) = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 1)::INT AS section FROM m)
    SELECT file_id, section, count(*) AS elements, sum(length(text))::BIGINT AS chars, md5(coalesce(string_agg(text, '|' ORDER BY pos) FILTER (kind IN ('heading', 'title')), '')) AS headings FROM s GROUP BY 1, 2"""


def decorative_images(spark, d):
    e = _elements(spark, d).filter("kind = 'image'")
    mark = structure.decorative(F.col("kind"), F.lit("photo"), F.col("text"))
    return e.groupBy(mark.alias("decorative")).agg(F.count("*").alias("images"), F.min("file_id").alias("first_file"))


DECORATIVE_IMAGES = f"WITH {ELEMENTS} SELECT ({_DECORATED}) AS decorative, count(*) AS images, min(file_id) AS first_file FROM p WHERE kind = 'image' GROUP BY 1"


def element_descriptions(spark, d):
    """What tables and code are described as, with what they describe hashed behind it."""
    e = structure.described(_elements(spark, d)).filter("kind IN ('table', 'code', 'formula') AND trim(text) <> ''")
    return e.select("file_id", "pos", "kind", F.substring_index("shown", "\n", 1).alias("description"), F.md5("shown").alias("shown"))


# Three quotation marks of either kind, as SQL writes them.
_DOUBLE, _SINGLE = '"' * 3, "''" * 3
ELEMENT_DESCRIPTIONS = rf"""WITH {ELEMENTS},
    a AS (SELECT *, regexp_replace(string_split(trim(text, ' '), chr(10))[1], '^\|+|\|+$', '', 'g') AS head, greatest(len(string_split(trim(text, ' '), chr(10))) - 2, 0) AS n,
      nullif(trim(regexp_extract(text, '^# language:([^\n]*)', 1), ' '), '') AS lang,
      coalesce(nullif(regexp_extract(text, '(?m)^def\s+(\w+)', 1), ''), nullif(regexp_extract(text, '(?m)^class\s+(\w+)', 1), ''), nullif(regexp_extract(text, '(?m)^function\s+(\w+)', 1), ''),
        nullif(regexp_extract(text, '(?m)^public\s+(?:static\s+)?(?:void|class)\s+(\w+)', 1), '')) AS name,
      coalesce(nullif(regexp_extract(text, '{_DOUBLE}([\s\S]+?){_DOUBLE}', 1), ''), nullif(regexp_extract(text, '{_SINGLE}([\s\S]+?){_SINGLE}', 1), '')) AS doc,
      regexp_extract(text, '(?m)^#[^\S\n]*([^\n]+)$', 1) AS note FROM p WHERE kind IN ('table', 'code', 'formula') AND trim(text, ' ') <> ''),
    b AS (SELECT *, CASE WHEN contains(string_split(trim(text, ' '), chr(10))[1], '|') THEN list_filter(list_transform(string_split(head, '|'), lambda x: trim(x, ' ')), lambda x: x <> '') ELSE [] END AS names,
      substr(coalesce(string_split(regexp_replace(doc, '^\s+|\s+$', '', 'g'), chr(10))[1], CASE WHEN note <> '' AND NOT starts_with(note, 'language:') THEN trim(note, ' ') END), 1, 60) AS line FROM a),
    s AS (SELECT file_id, pos, kind, text, CASE kind WHEN 'formula' THEN '[公式]'
      WHEN 'table' THEN CASE WHEN len(names) = 0 THEN '[表格]' WHEN n > 0 THEN '[表格] 这是一个' || len(names) || '列' || n || '行的表格，列名：' || array_to_string(names, '/') || '。' ELSE '[表格] 列名：' || array_to_string(names, '/') || '。' END
      ELSE concat_ws(' ', coalesce('[' || upper(lang[1]) || lower(lang[2:]) || '代码]', '[代码]'), name, '：' || line) END AS description FROM b)
    SELECT file_id, pos, kind, description, md5(description || chr(10) || text) AS shown FROM s"""


def chunk_structure(spark, d):
    c = structure.structure_chunks(_elements(spark, d))
    return c.select("file_id", "chunk_no", "kind", F.md5("chunk").alias("chunk"), F.length("chunk").alias("chars"))


def chunk_parents(spark, d):
    parts = structure.parents(structure.prepared(table(spark, d, "elements")))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), "\n")
    return parts.groupBy("file_id", "section", "part").agg(F.md5(texts).alias("text"), F.count("*").alias("elements"))


def chunk_children(spark, d):
    kids = structure.children(structure.parents(structure.prepared(table(spark, d, "elements"))))
    return kids.select("file_id", "section", "part", "child_no", "kind", F.md5("chunk").alias("chunk"), F.length("chunk").alias("chars"))


QUERIES = {
    "noise_filter": noise_filter, "merged_tables": merged_tables, "file_sections": file_sections, "decorative_images": decorative_images,
    "element_descriptions": element_descriptions, "chunk_structure": chunk_structure, "chunk_parents": chunk_parents, "chunk_children": chunk_children,
}
SQL = {
    "noise_filter": NOISE_FILTER, "merged_tables": MERGED_TABLES, "file_sections": FILE_SECTIONS, "decorative_images": DECORATIVE_IMAGES,
    "element_descriptions": ELEMENT_DESCRIPTIONS,
}
