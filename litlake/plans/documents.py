"""Queries over documents, visuals, reports, logs and topics, and their SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake import ports
from litlake.functions import text as t
from litlake.operators import facets, joblog, match, reports, sections, tables, topics, visuals
from litlake.plans.papers import _TEXT, _WS, _squeeze, _strip
from litlake.sources.tables import table
from litlake.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text")


# ---- sections and chunks ----------------------------------------------------------------------------

_ROWS = "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS l FROM documents WHERE text <> '')"
_PLAIN = "(?i)^(?:abstract|references|acknowledg(?:e)?ments?|appendix(?:\\s+[A-Z0-9.]+)?|[0-9]+(?:\\.[0-9]+)*\\.?\\s+[A-Z][^\\n]{0,120})$"
_SECTIONS = f"""WITH r AS ({_ROWS}),
f AS (SELECT *, sum(CASE WHEN starts_with({_strip('line')}, '```') THEN 1 ELSE 0 END) OVER w % 2 = 1 AS fenced,
 coalesce({_strip('lag(line) OVER (PARTITION BY doc_id ORDER BY line_no)')} = '', true) AS blank FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
h AS (SELECT *, NOT fenced AND (regexp_matches({_strip('line')}, '^#{{1,6}}\\s+\\S+') OR (blank AND length({_strip('line')}) <= 140 AND regexp_matches({_strip('line')}, '{_PLAIN}'))) AS heading FROM f)
SELECT doc_id, line_no, heading, CAST(sum(CASE WHEN heading OR line_no = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section_no, line FROM h"""


@query(f"SELECT doc_id, line_no, heading, section_no FROM ({_SECTIONS})")
def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.section_lines(_documents(spark, sf_dir), "doc_id").select("doc_id", "line_no", "heading", "section_no")


@query(
    f"""SELECT doc_id, section_no, section FROM (SELECT doc_id, section_no, {_strip('string_agg(line, chr(10) ORDER BY line_no)')} AS section,
 bool_or(heading AND regexp_replace(lower({_strip("regexp_replace(" + _strip('line') + ", '^#+', '')")}), '^[0-9]+(?:\\.[0-9]+)*\\.?\\s+', '') IN ('references', 'bibliography')) AS skipped
 FROM ({_SECTIONS}) GROUP BY doc_id, section_no) WHERE NOT skipped AND section <> ''"""
)
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(_documents(spark, sf_dir), "doc_id")


@query(
    f"SELECT doc_id, len(p) AS paragraphs, list_max(list_transform(p, lambda x: length(x))) AS longest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM documents WHERE text <> '')"
)
def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", sections.paragraphs(F.col("text")).alias("p"))
    return docs.select("doc_id", F.size("p").alias("paragraphs"), F.array_max(F.transform("p", lambda x: F.length(x))).alias("longest"))


@query(
    f"""WITH w AS (SELECT doc_id, text, unnest(range(CAST(greatest(0, ceil((length(text) - 1000) / 917.0)) AS BIGINT) + 1)) AS i FROM documents WHERE text <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, part FROM (SELECT doc_id, i, {_strip('substr(text, i * 917 + 1, 1000)')} AS part FROM w) WHERE part <> ''"""
)
def hard_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(sections.hard_split(F.col("text"), 1000)).alias("n", "part"))


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM documents WHERE text <> ''),
f AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: [x]), lambda s, x: CASE WHEN length(s[-1]) + length(x[1]) + 2 <= 800 THEN list_concat(s[1:len(s) - 1], [s[-1] || chr(10) || chr(10) || x[1]]) ELSE list_concat(s, x) END) AS c FROM p WHERE len(p) > 0)
SELECT doc_id, unnest(range(len(c))) AS n, unnest(c) AS chunk FROM f"""
)
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(sections.pack(sections.paragraphs(F.col("text")), 800)).alias("n", "chunk"))


_PARTED = _SECTIONS.replace("doc_id", "stem").replace("FROM documents WHERE text <> ''", "FROM (SELECT DISTINCT ON (stem) stem, full_text AS text FROM parsed_papers WHERE full_text <> '' ORDER BY stem, parsed_at)")
_FOLD = "list_reduce(ITEMS, lambda s, x: CASE WHEN NOT x[1].f AND length(s[len(s)].p) + length(x[1].p) + 2 <= SIZE THEN list_concat(s[1:len(s) - 1], [{'p': s[len(s)].p || chr(10) || chr(10) || x[1].p, 'f': true}]) ELSE list_concat(s, x) END)"
_ROOM = "(CASE WHEN n = 0 AND i = 1 THEN room ELSE later END)"
_WINDOWS = (
    """list_filter(list_transform(range(0, CAST(CASE WHEN length(p[i]) <= ROOM THEN 1 ELSE 2 + greatest(0, ceil((length(p[i]) - (ROOM - least(600, ROOM // 12)) - later) / CAST(later - least(600, later // 12) AS DOUBLE))) END AS BIGINT)), lambda k: {'p': """
    + _strip("substr(p[i], CASE WHEN k = 0 THEN 1 ELSE (ROOM - least(600, ROOM // 12)) + (k - 1) * (later - least(600, later // 12)) + 1 END, CASE WHEN k = 0 THEN ROOM ELSE later END)")
    + ", 'f': true}), lambda w: w.p <> '')"
).replace("ROOM", _ROOM)


def _chunk_sql(size: int) -> str:
    """Paragraph lists, running sums and two folds."""
    behind = _strip("substr(section, length(split_part(section, chr(10), 1)) + 1)")
    return f"""WITH sec AS (SELECT stem, section_no, section FROM (SELECT stem, section_no, {_strip('string_agg(line, chr(10) ORDER BY line_no)')} AS section,
 bool_or(heading AND regexp_replace(lower({_strip("regexp_replace(" + _strip('line') + ", '^#+', '')")}), '^[0-9]+(?:\\.[0-9]+)*\\.?\\s+', '') IN ('references', 'bibliography')) AS skipped FROM ({_PARTED}) GROUP BY stem, section_no) WHERE NOT skipped AND section <> ''),
top AS (SELECT *, {_strip("split_part(section, chr(10), 1)")} AS top FROM sec),
hd AS (SELECT *, CASE WHEN regexp_matches(top, '^#{{1,6}}\\s+\\S+') OR (length(top) <= 140 AND regexp_matches(top, '{_PLAIN}')) THEN top ELSE '' END AS head FROM top),
bd AS (SELECT *, CASE WHEN head <> '' AND {behind} <> '' THEN {behind} ELSE section END AS body,
 CASE WHEN head <> '' THEN head || chr(10) || chr(10) ELSE '' END AS lead, CASE WHEN head <> '' THEN head || chr(10) || chr(10) || '{sections.CONTINUED}' || chr(10) || chr(10) ELSE '' END AS again FROM hd),
pr AS (SELECT *, greatest(500, {size} - length(lead)) AS room, greatest(500, {size} - length(again)) AS later, list_filter(list_transform(string_split_regex(body, '\\n\\s*\\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM bd),
rc AS (SELECT *, len(list_filter(range(1, len(p) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + 2 * (i - 1) <= room)) AS n FROM pr),
it AS (SELECT *, flatten(list_transform(range(n + 1, len(p) + 1), lambda i: CASE WHEN length(p[i]) > {_ROOM} THEN {_WINDOWS} ELSE [{{'p': p[i], 'f': i = n + 1}}] END)) AS items FROM rc),
pk AS (SELECT *, CASE WHEN len(items) = 0 THEN [] ELSE list_transform({_FOLD.replace("ITEMS", "list_transform(items, lambda x: [x])").replace("SIZE", "later")}, lambda x: x.p) END AS packed FROM it),
ev AS (SELECT *, CASE WHEN n > 0 THEN list_concat([array_to_string(p[1:n], chr(10) || chr(10))], packed) ELSE packed END AS every FROM pk),
pt AS (SELECT stem, section_no, CASE WHEN length(section) <= {size} THEN [section] ELSE list_transform(range(1, len(every) + 1), lambda i: {_strip("(CASE WHEN i = 1 THEN lead ELSE again END || every[i])")}) END AS parts FROM ev),
fl AS (SELECT stem, flatten(list(parts ORDER BY section_no)) AS parts FROM pt GROUP BY stem),
ck AS (SELECT stem, list_transform({_FOLD.replace("ITEMS", "list_transform(parts, lambda x: [{'p': x, 'f': false}])").replace("SIZE", str(size))}, lambda x: x.p) AS c FROM fl WHERE len(parts) > 0)
SELECT stem, unnest(range(len(c))) AS n, unnest(c) AS chunk FROM ck"""


@query(_chunk_sql(12_000))
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = tables.keep_first(table(spark, sf_dir, "parsed_papers").where("full_text <> ''").select("stem", "parsed_at", "full_text"), ["stem"], "parsed_at")
    return sections.chunks(papers, "stem", "full_text")


@query(
    "SELECT DISTINCT stem, CASE WHEN length(coalesce(full_text, '')) <= 32000 THEN 'single' ELSE 'chunks' END AS plan FROM parsed_papers"
)
def call_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_papers").select("stem", sections.call_plan(F.col("full_text"), F.lit("")).alias("plan")).distinct()


@query()
def map_reduce_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ports.summarize(_documents(spark, sf_dir), "doc_id", "text", ports.HashCompleter(), 2000)


# ---- blocks and visuals ------------------------------------------------------------------------------


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.posexplode(sections.paragraphs(F.col("text"))).alias("pos", "text"))
    return docs.select("doc_id", "pos", F.lit("text").alias("type"), "text", F.when(F.col("text").startswith("## "), 1).alias("text_level"))


@query(
    f"""WITH b AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM documents WHERE text <> '')),
c AS (SELECT doc_id, pos, {_squeeze('text')} AS c, text FROM b),
d AS (SELECT *, CASE WHEN starts_with(text, '## ') OR regexp_matches(c, '^[0-9]+(?:\\.[0-9]+)*\\s+\\S+') THEN c END AS h FROM c)
SELECT doc_id, pos, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS section,
 coalesce(array_to_string(list(c) FILTER (length(c) >= 30) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)[-3:], ' '), '') AS before_text,
 coalesce(array_to_string(list(c) FILTER (length(c) >= 30) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)[1:3], ' '), '') AS after_text FROM d"""
)
def block_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visuals.with_context(_blocks(spark, sf_dir)).select("doc_id", "pos", "section", "before_text", "after_text")


def _visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "visual_items")


_VTEXT = "lower(concat_ws(' ', coalesce(caption,''), coalesce(before_text,''), coalesce(after_text,'')))"
_VSCORE = f"""CASE WHEN coalesce(caption,'') <> '' THEN 5 ELSE 0 END + CASE WHEN kind = 'table' THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches({_VTEXT}, '\\b(fig\\.|figure|table)\\s*[0-9]+') THEN 3 ELSE 0 END + CASE WHEN regexp_matches({_VTEXT}, '{visuals.SCORE_WORDS}') THEN 2 ELSE 0 END"""


@query(
    f"""SELECT source_stem, item_index, score, place FROM (SELECT *, row_number() OVER (PARTITION BY source_stem ORDER BY score DESC, coalesce(path,'') <> '' DESC, item_index) AS place
 FROM (SELECT DISTINCT *, {_VSCORE} AS score FROM visual_items)) WHERE place <= 8"""
)
def visual_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visuals.top_visuals(_visuals(spark, sf_dir), "source_stem", 8).select("source_stem", "item_index", "score", "place")


_STEXT = "lower(concat_ws(' ', coalesce(caption,''), coalesce(section,''), coalesce(before_text,''), coalesce(after_text,'')))"
_R = dict(visuals.SECTION_RULES)
_VSECTION = f"""CASE WHEN regexp_matches({_STEXT}, '{_R['局限与不足']}') THEN '局限与不足' WHEN kind = 'table' OR regexp_matches({_STEXT}, '{_R['关键实验与结果']}') THEN '关键实验与结果'
 WHEN regexp_matches({_STEXT}, '{_R['核心方法']}') THEN '核心方法' WHEN regexp_matches({_STEXT}, '{_R['研究问题']}') THEN '研究问题' ELSE '关键实验与结果' END"""


@query(f"SELECT DISTINCT source_stem, item_index, {_VSECTION} AS placed FROM visual_items")
def visual_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visuals(spark, sf_dir).select("source_stem", "item_index", visuals.visual_section().alias("placed")).distinct()


@query(
    """SELECT DISTINCT source_stem, item_index, CASE WHEN kind = 'table' THEN regexp_extract(caption, '(?i)\\btable\\s*([0-9]+)\\b', 1) ELSE regexp_extract(caption, '(?i)\\b(?:figure|fig\\.?)\\s*([0-9]+)\\b', 1) END AS number,
 list_distinct(list_transform(regexp_extract_all(caption, '(?i)\\b(?:table|figure|fig\\.?)\\s*[0-9]+\\b'), lambda x: CASE WHEN starts_with(lower(x), 'table') THEN 'table:' ELSE 'figure:' END || regexp_extract(x, '([0-9]+)$', 1))) AS refs FROM visual_items WHERE caption <> ''"""
)
def visual_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _visuals(spark, sf_dir).where("caption <> ''")
    caption = F.col("caption")
    return items.select("source_stem", "item_index", visuals.visual_number(caption, F.col("kind")).alias("number"), visuals.number_refs(caption).alias("refs")).distinct()


@query(
    "SELECT DISTINCT source_stem, item_index, trim("
    + reduce(
        lambda x, w: f"replace({x}, '{w[0]}', '{w[1]}')",
        visuals.CAPTION_WORDS,
        "regexp_replace(" + _squeeze("caption") + ", '(?i)^(table|figure|fig\\.?)\\s*[0-9]+\\s*[:.]\\s*', '')",
    )
    + ") AS rendered FROM visual_items WHERE caption <> ''"
)
def chinese_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visuals(spark, sf_dir).where("caption <> ''").select("source_stem", "item_index", visuals.chinese_caption(F.col("caption")).alias("rendered")).distinct()


def _cut_sql(x: str, size: int) -> str:
    q = _squeeze(x)
    return f"CASE WHEN length({q}) <= {size} THEN {q} ELSE rtrim(substr({q}, 1, {size - 3})) || '...' END"


def _part_sql(label: str, value: str) -> str:
    return f" || CASE WHEN coalesce({value}, '') <> '' THEN chr(10) || '- {label}：' || {value} ELSE '' END"


@query(
    f"""WITH v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_stem ORDER BY score DESC, coalesce(path,'') <> '' DESC, item_index) AS place FROM (SELECT DISTINCT *, {_VSCORE} AS score FROM visual_items)) WHERE place <= 6)
SELECT source_stem, string_agg('### ' || CASE WHEN kind = 'table' THEN 'Table' ELSE 'Figure' END || ' ' || item_index"""
    + _part_sql("类型", "kind")
    + _part_sql("页码", "CASE WHEN page > 0 THEN CAST(page AS VARCHAR) ELSE '未知' END")
    + _part_sql("Markdown 图片路径", "('`' || nullif(path, '') || '`')")
    + _part_sql("所在章节", "section")
    + _part_sql("Caption", "caption")
    + _part_sql("Footnote", "footnote")
    + _part_sql("前文上下文", f"({_cut_sql('before_text', 160)})")
    + _part_sql("后文上下文", f"({_cut_sql('after_text', 160)})")
    + _part_sql("表格内容摘录", f"({_cut_sql('table_body', 220)})")
    + ", chr(10) || chr(10) ORDER BY item_index) AS context FROM v GROUP BY source_stem"
)
def visual_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visuals.context_lines(_visuals(spark, sf_dir), "source_stem")


_HEADS = ("基本信息", "核心问题", "方法概述", "实验设置", "主要结果", "局限与风险")
_ITEM = _squeeze("lower(concat_ws(' ', coalesce(caption,''), coalesce(section,''), coalesce(before_text,''), coalesce(after_text,''), coalesce(table_body,''), coalesce(kind,'')))")


def _named_sql(key: str, name: str) -> bool:
    """Whether a heading goes by a section's name; both are known here."""
    return any(n in key or key in n for n in dict.fromkeys([*visuals.ALIASES.get(name, [name]), name]))


def _heading_score_sql(key: str) -> str:
    points = [f"CASE WHEN placed = '{name}' THEN 4 ELSE 0 END" for name in visuals.ALIASES if _named_sql(key, name)]
    terms = [w for w in re.findall(r"[a-zA-Z]{4,}|[一-鿿]{2,}", key)]
    listed = ", ".join(f"'{w}'" for w in terms)
    points.append(f"CASE WHEN list_has_any(section_terms, [{listed}]) THEN 5 ELSE 0 END")
    for name, words in visuals.HEADING_WORDS.items():
        if _named_sql(key, name):
            points.append("2 * least(" + " + ".join(f"CAST(contains(x, '{w.lower()}') AS INTEGER)" for w in words) + ", 5)")
    if _named_sql(key, "主要结果"):
        points.append("CASE WHEN kind = 'table' THEN 2 ELSE 0 END")
    points += [f"CASE WHEN regexp_matches(x, '{pattern}') THEN {n} ELSE 0 END" for name, n, pattern in visuals.BONUSES if _named_sql(key, name)]
    points.append("least(" + " + ".join(f"CAST(contains(x, '{w}') AS INTEGER)" for w in terms) + ", 3)")
    total = " + ".join(points)
    return f"({total}) - CASE WHEN ({total}) <= 2 THEN 2 ELSE 0 END" if key in ("基本信息", "可借鉴点") else total


_SCORED = " UNION ALL ".join(f"SELECT *, {n} AS pos, '{h}' AS heading, {_heading_score_sql(h)} AS score FROM i" for n, h in enumerate(_HEADS))


@query(
    f"""WITH i AS (SELECT *, {_VSECTION} AS placed, {_ITEM} AS x, regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(section, ''), '^[#\\s]+', ''), '^[0-9]+(?:\\.[0-9]+)*\\.?\\s*', ''), '[：:()\\[\\]【】\\-—_\\s]+', '', 'g')), '[a-zA-Z]{{4,}}|[一-鿿]{{2,}}') AS section_terms,
 coalesce(list_contains(list_transform(regexp_extract_all(caption, '(?i)\\b(?:table|figure|fig\\.?)\\s*[0-9]+\\b'), lambda c: CASE WHEN starts_with(lower(c), 'table') THEN 'table:' ELSE 'figure:' END || regexp_extract(c, '([0-9]+)$', 1)), 'figure:1'), false) AS first_figure
 FROM (SELECT DISTINCT * FROM visual_items)),
s AS ({_SCORED} UNION ALL SELECT *, 6, '图1', CASE WHEN first_figure THEN 1000 ELSE -1000 END FROM i),
b AS (SELECT source_stem, item_index, heading, score, row_number() OVER (PARTITION BY source_stem, item_index ORDER BY score DESC, pos) AS n FROM s)
SELECT source_stem, item_index, CASE WHEN score > 0 THEN heading END AS heading, CASE WHEN score > 0 THEN score END AS heading_score FROM b WHERE n = 1"""
)
def visual_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items placed in summaries that have the headings of a report's template and one for figure 1; the tables hold no summaries."""
    items = _visuals(spark, sf_dir).distinct()
    fixed = "".join(f"## {h}\n" for h in _HEADS) + "### 图1\n"
    summaries = items.select("source_stem").distinct().withColumn("summary", F.lit(fixed))
    return visuals.place_visuals(items, summaries, "source_stem", "summary").select("source_stem", "item_index", "heading", "heading_score")


_BLOCKS = """SELECT source_stem AS doc, b.* FROM (SELECT DISTINCT source_stem, item_index, kind, page, path, caption, section, before_text, after_text, table_body FROM visual_items) AS v,
 LATERAL (SELECT item_index * 4 AS pos, 'text' AS type, section AS text, true AS head, CAST(NULL AS INTEGER) AS page_idx, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS caption, CAST(NULL AS VARCHAR) AS table_body
  UNION ALL SELECT item_index * 4 + 1, 'text', before_text, false, NULL, NULL, NULL, NULL
  UNION ALL SELECT item_index * 4 + 2, CASE WHEN kind = 'table' THEN 'table' ELSE 'image' END, NULL, false, CASE WHEN page > 0 THEN page - 1 END, v.path, v.caption, v.table_body
  UNION ALL SELECT item_index * 4 + 3, 'text', after_text, false, NULL, NULL, NULL, NULL) AS b"""
_HTML = "regexp_replace(regexp_replace(regexp_replace(coalesce(table_body, ''), '(?i)<\\s*/\\s*(tr|p|div|table)\\s*>', chr(10), 'g'), '(?i)<\\s*/\\s*(td|th)\\s*>', ' | ', 'g'), '<[^>]+>', ' ', 'g')"


def _entities(x: str) -> str:
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{safe}', '{raw}')"
    return x


@query(
    f"""WITH c AS (SELECT *, {_squeeze(_entities("coalesce(text, '')"))} AS t FROM ({_BLOCKS})),
d AS (SELECT *, CASE WHEN type = 'text' AND (head OR regexp_matches(t, '^[0-9]+(?:\\.[0-9]+)*\\s+\\S+')) THEN t END AS h, CASE WHEN type = 'text' AND length(t) >= 30 THEN t END AS f FROM c),
w AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS section,
 coalesce(array_to_string((list(f) FILTER (f IS NOT NULL) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))[-3:], ' '), '') AS before_text,
 coalesce(array_to_string((list(f) FILTER (f IS NOT NULL) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))[1:3], ' '), '') AS after_text FROM d),
v AS (SELECT doc, pos, type, coalesce(page_idx + 1, 0) AS page, path, {_squeeze(_entities("coalesce(caption, '')"))} AS caption, CASE WHEN type = 'table' THEN {_cut_sql(_squeeze(_entities(_HTML)), 1200)} ELSE '' END AS table_body, section, before_text, after_text FROM w WHERE type <> 'text'),
k AS (SELECT * FROM v WHERE coalesce(path, '') <> '' OR caption <> '' OR table_body <> ''),
o AS (SELECT * FROM k QUALIFY coalesce(path, '') = '' OR row_number() OVER (PARTITION BY doc, lower(path) ORDER BY pos) = 1)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY pos) AS INTEGER) AS item_index, type, page, path, caption, table_body, section, before_text, after_text FROM o"""
)
def extracted_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual items of block lists in which each item stands under its section, between the texts before and after it."""
    items = _visuals(spark, sf_dir).select("source_stem", "item_index", "kind", "page", "path", "caption", "section", "before_text", "after_text", "table_body").distinct()
    none = F.lit(None).cast("string")

    def block(place: int, kind: Column, text: Column, level: int | None, page: Column, path: Column, caption: Column, body: Column) -> Column:
        return F.struct(
            (F.col("item_index") * 4 + place).alias("pos"), kind.alias("type"), text.alias("text"), F.lit(level).cast("int").alias("text_level"), page.cast("int").alias("page_idx"),
            path.alias("path"), caption.alias("caption"), body.alias("table_body"),
        )

    def text(place: int, value: Column, level: int | None = None) -> Column:
        return block(place, F.lit("text"), value, level, F.lit(None), none, none, none)

    kind = F.when(F.col("kind") == "table", "table").otherwise("image")
    visual = block(2, kind, none, None, F.when(F.col("page") > 0, F.col("page") - 1), F.col("path"), F.col("caption"), F.col("table_body"))
    parts = F.array(text(0, F.col("section"), 1), text(1, F.col("before_text")), visual, text(3, F.col("after_text")))
    blocks = items.select(F.col("source_stem").alias("doc"), F.inline(parts))
    return visuals.extract_visuals(blocks, "doc").select("doc", "item_index", "type", "page", "path", "caption", "table_body", "section", "before_text", "after_text")


@query("SELECT source_stem, lower(path) AS file, min(item_index) AS first_index, count(*) AS n FROM (SELECT DISTINCT source_stem, item_index, path FROM visual_items WHERE path <> '') GROUP BY 1, 2")
def visual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _visuals(spark, sf_dir).where("path <> ''").select("source_stem", "item_index", "path").distinct()
    return items.groupBy("source_stem", F.lower("path").alias("file")).agg(F.min("item_index").alias("first_index"), F.count("*").alias("n"))


@query(
    """WITH refs AS (SELECT DISTINCT source_stem AS doc, 'img/' || regexp_extract(path, '([^/]*)$', 1) AS ref FROM visual_items WHERE path <> ''), f AS (SELECT DISTINCT source_stem AS doc, path FROM visual_items WHERE path <> '')
SELECT doc, ref, coalesce((SELECT min(path) FROM f WHERE f.doc = refs.doc AND f.path = refs.ref), (SELECT min(path) FROM f WHERE f.doc = refs.doc AND regexp_extract(f.path, '([^/]*)$', 1) = regexp_extract(refs.ref, '([^/]*)$', 1))) AS path FROM refs"""
)
def asset_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _visuals(spark, sf_dir).where("path <> ''").select(F.col("source_stem").alias("doc"), "path").distinct()
    refs = files.select("doc", F.concat(F.lit("img/"), t.base_name(F.col("path"))).alias("ref")).distinct()
    return tables.resolve_assets(refs, files).select("doc", "ref", "path")


@query(
    f"""WITH n AS (SELECT DISTINCT source_stem, item_index, regexp_extract(path, '([^/\\\\]*)$', 1) AS name FROM visual_items WHERE path <> ''),
s AS (SELECT *, CASE WHEN contains(name, '.') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem, CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) ELSE '' END AS suffix FROM n),
b AS (SELECT *, coalesce(nullif(trim(substr(trim(regexp_replace(lower(trim(stem)), '[^A-Za-z0-9]+', '-', 'g'), '-'), 1, 80), '-'), ''), 'image') AS base FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY source_stem, base, suffix ORDER BY item_index) AS k FROM b)
SELECT source_stem, item_index, name, base || CASE WHEN k > 1 THEN '-' || k ELSE '' END || suffix AS unique_name FROM r"""
)
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _visuals(spark, sf_dir).where("path <> ''").select("source_stem", "item_index", t.base_name(F.col("path")).alias("name")).distinct()
    return tables.unique_names(items, "name", "item_index", "source_stem")


# ---- reports -----------------------------------------------------------------------------------------


def _report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = tables.keep_first(table(spark, sf_dir, "parsed_papers").select("stem", "pdf_path", "full_text", "venue", "year", "parsed_at"), ["stem"], "parsed_at")
    rows = tables.keep_first(
        table(spark, sf_dir, "filtered_papers").where("trim(pdf_path) <> ''").select(
            t.base_name(F.col("pdf_path")).alias("file"), "pos", "paper_id", "title", "keywords", "matched_keywords", "abstract"
        ),
        ["file"],
        "pos",
    )
    return parsed.join(rows, t.base_name(parsed["pdf_path"]) == rows["file"], "left").drop("file", "pos")


_MODAL = "list_filter(['video', 'audio', 'text', 'image'], lambda m: CASE m " + " ".join(
    f"WHEN '{name}' THEN " + " OR ".join(f"contains(x, '{w}')" for w in words) for name, words in reports.MODALITY_WORDS
) + " END)"


@query(
    f"SELECT pos, CASE WHEN len(m) > 1 THEN 'multimodal' WHEN len(m) = 1 THEN m[1] ELSE 'image' END AS modality FROM (SELECT pos, {_MODAL} AS m FROM (SELECT pos, lower(concat_ws(' ', title, abstract)) AS x FROM all_papers))"
)
def modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "all_papers").select("pos", reports.modality(none, F.concat_ws(" ", "title", "abstract")).alias("modality"))


def _re2(pattern: str) -> str:
    """A rule's pattern for DuckDB, whose word boundaries know ASCII letters only."""
    return re.sub(r"\\b$", r"(?:$|[^\\p{L}\\p{N}_])", re.sub(r"^\\b", r"(?:^|[^\\p{L}\\p{N}_])", pattern))


_RULES = "list_filter([" + ", ".join(f"'{n}'" for n, _ in reports.TAG_RULES) + "], lambda r: CASE r " + " ".join(
    f"WHEN '{n}' THEN regexp_matches(x, '{'|'.join(map(_re2, p))}')" for n, p in reports.TAG_RULES
) + " END)"


@query(f"SELECT pos, {_RULES} AS tags FROM (SELECT pos, {_TEXT} AS x FROM all_papers)")
def rule_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "all_papers")
    return papers.select("pos", reports.rule_tags(match.searched_text(papers, ["title", "abstract", "keywords"])).alias("tags"))


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest({_RULES}) AS tag FROM (SELECT pos, {_TEXT} AS x FROM all_papers)) GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.tag_counts(rule_tags(spark, sf_dir))


@query("SELECT lang AS value, min(doc_id) AS first_seen FROM documents WHERE lang <> '' GROUP BY lang")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_values(table(spark, sf_dir, "documents"), "lang", "doc_id")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "all_papers")
    source = t.source_of_file(F.col("source_file"))
    return papers.select(
        F.col("pos").cast("string").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("title", F.lit("")).alias("fullTitle"),
        F.coalesce("abstract", F.lit("")).alias("introduction"), source["conference"].alias("venue"), source["year"].try_cast("int").alias("year"),
        F.lit("text").alias("modality"), reports.rule_tags(match.searched_text(papers, ["title", "abstract", "keywords"])).alias("tags"),
    )


_REPORTS = f"""SELECT CAST(pos AS VARCHAR) AS id, coalesce(title,'') AS title, coalesce(abstract,'') AS introduction, upper(regexp_extract(source_file, '([A-Za-z]+)[_ -]?([0-9]{{4}})', 1)) AS venue,
 try_cast(regexp_extract(source_file, '([A-Za-z]+)[_ -]?([0-9]{{4}})', 2) AS INTEGER) AS year, 'text' AS modality, {_RULES} AS tags FROM (SELECT *, {_TEXT} AS x FROM all_papers)"""


@query(
    f"""SELECT id, year FROM ({_REPORTS}) WHERE contains(lower(concat_ws(' ', title, title, introduction, venue, modality, array_to_string(tags, ' '))), 'gaze') AND year = 2024 AND list_contains(tags, 'Emotion Recognition')"""
)
def faceted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.faceted_search(_reports(spark, sf_dir), "Gaze", year="2024", tag="Emotion Recognition").select("id", "year")


@query()
def recent_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 reports of the list sorted by recency: a top-k report."""
    return facets.top_rows(_reports(spark, sf_dir), 50, *facets.report_order("recent")).select("id", "year", "venue", "title")


def _text_list(words: object) -> str:
    return "[" + ", ".join("'" + str(w).replace("'", "''") + "'" for w in words) + "]"


def _map_sql(values: dict[str, str]) -> str:
    return f"MAP({_text_list(values)}, {_text_list(values.values())})"


_FORMAT = (
    "array_to_string(list_transform(string_split(" + _squeeze("regexp_replace({x}, '[_-]+', ' ', 'g')").replace("{a0}", "{{a0}}").replace("{3000}", "{{3000}}")
    + ", ' '), lambda w: CASE WHEN lower(w) = 'lora' THEN 'LoRA' WHEN list_contains(" + _text_list(reports.ACRONYMS)
    + ", lower(w)) THEN upper(w) WHEN length(w) > 1 AND regexp_matches(w, '\\p{Lu}') AND NOT regexp_matches(w, '\\p{Ll}') THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ')"
)
_EDGE = "[ \\t\\r\\n,;|/、，；]+"


def _format_sql(x: str) -> str:
    return _FORMAT.replace("{x}", x).replace("{{", "{").replace("}}", "}")


_KIND_TAGS = "CASE key " + " ".join(f"WHEN '{k}' THEN {_text_list(v)}" for k, v in reports.MODALITY_TAGS.items()) + " END"
_MARKS = "regexp_replace(coalesce(r, ''), '[`*_#]+', ' ', 'g')"
_TAG = f"regexp_replace({_squeeze(_MARKS)}, '^{_EDGE}|{_EDGE}$', '', 'g')"
_NORMAL = f"""CASE WHEN t.tag = '' THEN NULL WHEN {_map_sql(reports.TAG_ALIASES)}[t.key] IS NOT NULL THEN {_map_sql(reports.TAG_ALIASES)}[t.key]
 {' '.join(f"WHEN contains(t.tag, '{k}') THEN '{v}'" for k, v in reports.CHINESE_TAGS.items())} WHEN regexp_matches(t.tag, '[\\x{{3400}}-\\x{{9fff}}]') OR NOT regexp_matches(t.tag, '[A-Za-z]') THEN NULL ELSE {_format_sql('t.tag')} END"""


def _tags_sql(keys: str, own: list[str]) -> str:
    """CTEs from ``b`` (the keys, own lists, x the lower-cased text, kind) to ``tagged`` (the keys, tags)."""
    joined = f"list_concat(list_concat(['Emotion'], {_RULES}), coalesce({_KIND_TAGS}, [{_format_sql('kind')}]))"
    for o in own:
        joined = f"list_concat({joined}, coalesce(list_filter(list_transform(string_split_regex({o}, '[,;|/、，；]+'), lambda p: {_strip('p')}), lambda p: p <> ''), []))"
    return f"""k2 AS (SELECT *, trim(regexp_replace(lower(kind), '[^a-z0-9]+', ' ', 'g')) AS key FROM b),
r AS (SELECT {keys}, {joined} AS raw FROM k2),
t AS (SELECT {keys}, list_transform(list_transform(raw, lambda r: {_TAG}), lambda g: {{'tag': g, 'key': trim(regexp_replace(lower(g), '[^a-z0-9]+', ' ', 'g'))}}) AS l FROM r),
n AS (SELECT {keys}, list_filter(list_transform(l, lambda t: {_NORMAL}), lambda v: v IS NOT NULL) AS l FROM t),
tagged AS (SELECT {keys}, list_reduce(list_transform(l, lambda v: [v]), lambda s, v: CASE WHEN list_contains(list_transform(s, lambda q: lower(q)), lower(v[1])) THEN s ELSE list_concat(s, v) END)[1:5] AS tags FROM n)"""


_KIND = "CASE WHEN len(m) > 1 THEN 'multimodal' WHEN len(m) = 1 THEN m[1] ELSE 'image' END"


@query(
    f"""WITH b AS (SELECT *, {_KIND} AS kind FROM (SELECT *, {_MODAL} AS m FROM (SELECT pos, updated_at, matched_keywords, {_TEXT} AS x FROM filtered_papers))),
{_tags_sql("pos, updated_at", ["matched_keywords"])} SELECT pos, updated_at, tags FROM tagged"""
)
def normalized_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "filtered_papers")
    text = match.searched_text(papers, ["title", "abstract", "keywords"])
    kind = reports.modality(F.lit(None).cast("string"), text)
    return papers.select("pos", "updated_at", reports.report_tags(text, kind, F.col("matched_keywords")).alias("tags"))


def _first_filled_sql(*columns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({_strip(c)}, '')" for c in columns) + ", '')"


_LED = "replace(regexp_replace(whole, '^\\s*20[0-9][0-9][_\\s-]+[A-Za-z]+[_\\s-]+', ''), '_', ' ')"
_CLEAN_FULL = f"coalesce(nullif(regexp_replace(regexp_replace({_LED}, '{_WS}+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), whole)"


def _acronym_sql(x: str) -> str:
    word = f"trim(regexp_extract({x}, '^{_WS}*([A-Za-z][A-Za-z0-9-]{{1,20}}){_WS}*[:：-]{_WS}+', 1), '-')"
    return f"CASE WHEN regexp_matches({word}, '[A-Z]') OR length({word}) <= 8 THEN nullif({word}, '') END"


def _slug_sql(x: str) -> str:
    return f"trim(substr(trim(regexp_replace(lower({_strip(x)}), '[^A-Za-z0-9]+', '-', 'g'), '-'), 1, 80), '-')"


_STEM_PARTS = "'(?s)^(20[0-9][0-9])_([^_]+)_(.+)$'"
_BODY_LINES = "string_split_regex(text, '\\r\\n|\\r|\\n')"


@query(
    f"""WITH p AS (SELECT DISTINCT ON (stem) stem, regexp_extract(pdf_path, '([^/\\\\]*)$', 1) AS file, coalesce(full_text, '') AS text, venue, year FROM parsed_papers ORDER BY stem, parsed_at),
f AS (SELECT DISTINCT ON (file) regexp_extract(pdf_path, '([^/\\\\]*)$', 1) AS file, paper_id, title, keywords, matched_keywords, abstract FROM filtered_papers WHERE trim(pdf_path) <> '' ORDER BY file, pos, updated_at),
j AS (SELECT p.*, paper_id, title AS own, keywords, matched_keywords, abstract, CASE WHEN regexp_matches(stem, {_STEM_PARTS}) THEN regexp_extract(stem, {_STEM_PARTS}, 1) ELSE '' END AS stem_year, CASE WHEN regexp_matches(stem, {_STEM_PARTS}) THEN regexp_extract(stem, {_STEM_PARTS}, 2) ELSE '' END AS stem_venue,
 CASE WHEN regexp_matches(stem, {_STEM_PARTS}) THEN trim(replace(regexp_extract(stem, {_STEM_PARTS}, 3), '_', ': ')) ELSE stem END AS stem_title FROM p LEFT JOIN f USING (file)),
g AS (SELECT *, {_first_filled_sql('own', "regexp_replace(regexp_extract(text, '(?m)^[ ' || chr(9) || ']*(# [^' || chr(10) || chr(13) || ']*)', 1), '^#+', '')", 'stem_title')} AS whole FROM j),
h AS (SELECT *, lower(concat_ws(' ', {_first_filled_sql('own', 'keywords', 'abstract')}, substr(text, 1, 4000))) AS x0,
 lower(concat_ws(' ', whole, coalesce(own, ''), coalesce(keywords, ''), coalesce(abstract, ''), coalesce(matched_keywords, ''), substr(text, 1, 10000))) AS x FROM g),
b AS (SELECT *, {_KIND} AS kind FROM (SELECT *, {_MODAL.replace('contains(x,', 'contains(x0,')} AS m FROM h)),
{_tags_sql("stem", ["matched_keywords", "keywords"])},
l AS (SELECT stem, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT stem, {_BODY_LINES} AS l FROM p)),
a0 AS (SELECT stem, min(n) AS head_no FROM l WHERE lower({_strip("trim(" + _strip('line') + ", '#')")}) = 'abstract' GROUP BY stem),
a1 AS (SELECT l.stem, n, {_strip('line')} AS line, sum(CASE WHEN {_strip('line')} <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY l.stem ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS filled, starts_with(line, '#') AS head FROM l JOIN a0 ON l.stem = a0.stem AND n > head_no),
a2 AS (SELECT stem, min(n) AS stop FROM a1 WHERE head AND filled > 0 GROUP BY stem),
a3 AS (SELECT a1.stem, {_squeeze("string_agg(line, ' ' ORDER BY n)")} AS body FROM a1 LEFT JOIN a2 ON a1.stem = a2.stem WHERE line <> '' AND (stop IS NULL OR n < stop) GROUP BY a1.stem),
c AS (SELECT b.*, tags, {_CLEAN_FULL} AS clean, {_cut_sql('body', 500)} AS section FROM b JOIN tagged USING (stem) LEFT JOIN a3 USING (stem)),
d AS (SELECT *, {_acronym_sql('clean')} AS short_a, {_acronym_sql('stem')} AS short_b, regexp_extract_all(clean, '[A-Za-z0-9]+') AS ws, trim(regexp_replace({_strip("coalesce(paper_id, '')")}, '(?i)^/blog/', ''), '/') AS explicit FROM c)
SELECT coalesce(nullif({_slug_sql("CASE WHEN explicit = '' THEN coalesce(short_a, short_b, whole) ELSE explicit END")}, ''), {_slug_sql('stem')}) AS id,
 coalesce(short_a, short_b, CASE WHEN len(ws) BETWEEN 2 AND 5 THEN array_to_string(ws, ' ') WHEN len(ws) > 0 THEN array_to_string(ws[1:4], ' ') ELSE stem END) AS title, whole AS fullTitle,
 coalesce(try_cast(nullif(regexp_extract({_first_filled_sql('year', 'stem_year')}, '20[0-9][0-9]', 0), '') AS INTEGER), 2026) AS year, {_first_filled_sql('venue', 'stem_venue')} AS venue, kind AS modality, tags, {_first_filled_sql('abstract', 'section')} AS introduction FROM d"""
)
def report_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_metadata(_report_rows(spark, sf_dir))


# ---- logs --------------------------------------------------------------------------------------------


@query(
    """SELECT job_id, logged_at, stream, message, place FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY logged_at DESC NULLS LAST, stream NULLS FIRST, message NULLS FIRST) AS place FROM job_log) WHERE place <= 20"""
)
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joblog.log_tail(table(spark, sf_dir, "job_log"), 20).select("job_id", "logged_at", "stream", "message", "place")


@query(
    """SELECT job_id, coalesce(stage, 'none') AS stage, count(*) AS lines FROM (SELECT job_id, CASE WHEN regexp_matches(message, '(?i)summari[sz]|成功生成摘要') THEN 'summarizing'
 WHEN regexp_matches(message, '(?i)pars(e|ed|ing)|成功解析') THEN 'parsing' END AS stage FROM job_log) GROUP BY 1, 2"""
)
def log_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.coalesce(joblog.line_stage(F.col("message")), F.lit("none"))
    return table(spark, sf_dir, "job_log").groupBy("job_id", stage.alias("stage")).agg(F.count("*").alias("lines"))


@query(
    """WITH e AS (SELECT event_id, user_id, count(*) FILTER (event_type = 'purchase') OVER w AS done, CASE event_type WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'summarizing' ELSE 'queued' END AS phase FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, least(round((least(done, 30) + CASE phase WHEN 'queued' THEN 0.12 WHEN 'parsing' THEN 0.38 ELSE 0.72 END) / 30.0 * 100), CASE WHEN done >= 30 THEN 100 ELSE 99 END) AS c FROM e)
SELECT event_id, CAST(max(c) OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS progress FROM p"""
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("event_type")
    phase = F.when(kind == "view", "parsing").when(kind == "click", "summarizing").otherwise("queued")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.count(F.when(kind == "purchase", 1)).over(w).alias("done"), phase.alias("phase"), F.lit(30).alias("total"))
    return joblog.job_progress(rows, "user_id", ["event_id"], "done", "phase", "total").select("event_id", "progress")


@query(
    "SELECT job_id, stream, CAST(time_bucket(INTERVAL '1 hour', logged_at) AS TIMESTAMPTZ) AS window_start, count(*) AS lines FROM (SELECT DISTINCT ON (job_id, logged_at, message) * FROM job_log ORDER BY job_id, logged_at, message, stream NULLS LAST) WHERE logged_at IS NOT NULL AND job_id <> '' GROUP BY 1, 2, 3"
)
def log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "job_log").groupBy("job_id", "logged_at", "message").agg(F.min("stream").alias("stream"))
    return streams.batch_windows(log)


@query("SELECT status, count(*) AS n, count(summary_error) AS errors, CAST(sum(visual_count) AS BIGINT) AS visuals FROM summary_manifest GROUP BY status")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "summary_manifest")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count("summary_error").alias("errors"), F.sum("visual_count").alias("visuals"))


# ---- topics ------------------------------------------------------------------------------------------

_STOPPED = ", ".join(f"'{w}'" for w in topics.STOP_WORDS)
# NFKC, which DuckDB lacks: what NFC leaves of it in these texts is one Thai vowel sign.
_TERM = r"regexp_extract_all(lower(nfc_normalize(replace({x}, chr(3635), chr(3661) || chr(3634)))), '[\p{{L}}\p{{N}}]{{2,}}')"


@query(
    f"""WITH d AS (SELECT doc_id, text FROM documents WHERE text <> ''), n AS (SELECT count(*) AS n FROM d), w AS (SELECT doc_id, unnest({_TERM.format(x='text')}) AS term FROM d)
SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df, ln((1.0 + n) / (1.0 + count(DISTINCT doc_id))) + 1 AS idf FROM w, n WHERE term NOT IN ({_STOPPED}) GROUP BY term, n HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) <= 0.9 * n"""
)
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of all documents with text, of whatever language, but for English stop words."""
    return topics.term_statistics(_documents(spark, sf_dir), "doc_id", F.col("text"), stop_words=topics.STOP_WORDS)


@query()
def embedding_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.embedding_topics(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query(
    f"""WITH w AS (SELECT source_file AS topic, unnest({_TERM.format(x="coalesce(title,'') || '. ' || coalesce(abstract,'')")}) AS term FROM all_papers WHERE source_file IS NOT NULL),
c AS (SELECT topic, term, count(*) AS tf FROM w WHERE term NOT IN ({_STOPPED}) GROUP BY ALL), a AS (SELECT term, sum(tf) AS every FROM c GROUP BY term), m AS (SELECT avg(n) AS mean FROM (SELECT sum(tf) AS n FROM c GROUP BY topic)),
s AS (SELECT topic, term, tf * ln(1 + mean / every) AS score FROM c JOIN a USING (term), m)
SELECT topic, term, score, place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS place FROM s) WHERE place <= 10"""
)
def topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that set each source file's papers apart: a known grouping, so that the result can be checked."""
    papers = table(spark, sf_dir, "all_papers").where("source_file is not null")
    kinds = papers.select("pos", F.col("source_file").alias("topic"))
    return topics.topic_words(papers.select("pos", "title", "abstract"), "pos", kinds, topics.topic_text(F.col("title"), F.col("abstract")), stop_words=topics.STOP_WORDS)
