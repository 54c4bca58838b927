"""Queries over text functions, Markdown, names and small operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.functions import text as t
from litlake.operators import facets, figures, joblog, reports, sections, tables, visuals
from litlake.pipeline import filter_stage
from litlake.plans.papers import _TEXT, _base, _squeeze, _strip
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


def _unescape(x: str) -> str:
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "' || chr(160) || '"), ("&amp;", "&")):
        x = f"replace({x}, '{safe}', '{raw}')"
    return x


def _truncated(x: str, size: int) -> str:
    return f"(CASE WHEN length({x}) <= {size} THEN {x} ELSE rtrim(substr({x}, 1, {size - 3})) || '...' END)"


# ---- markup ------------------------------------------------------------------------------------------

_ROWS = r"regexp_replace(regexp_replace(table_body, '(?i)<\s*/\s*(tr|p|div|table)\s*>', chr(10), 'g'), '(?i)<\s*/\s*(td|th)\s*>', ' | ', 'g')"


_PLAIN_BODY = f"regexp_replace({_ROWS}, '<[^>]+>', ' ', 'g')"


@query(f"SELECT DISTINCT source_stem, item_index, {_squeeze(_unescape(_PLAIN_BODY))} AS body FROM visual_items WHERE table_body IS NOT NULL")
def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "visual_items").where("table_body is not null")
    return items.select("source_stem", "item_index", t.strip_html(F.col("table_body")).alias("body")).distinct()


@query("SELECT pos, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM all_papers WHERE title IS NOT NULL")
def escaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_papers").where("title is not null").select("pos", t.escape_html(F.col("title")).alias("html"))


@query(
    "SELECT pos, "
    + _squeeze(_unescape("array_to_string(list_filter([title, keywords, abstract], lambda x: x IS NOT NULL AND x <> ''), ' ')"))
    + " AS joined FROM all_papers"
)
def joined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_papers").select("pos", t.join_texts(F.array("title", "keywords", "abstract")).alias("joined"))


def _intro(x: str) -> str:
    for pattern, new in ((r"!\[[^\]]*\]\([^)]+\)", " "), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), ("<[^>]+>", " "), (r"(?m)^[#>\-*0-9.\s]+", ""), ("[`*_~]+", "")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"regexp_replace({_squeeze(x)}, '^[ \\t\\r\\n\\-，,；;：:]+|[ \\t\\r\\n\\-，,；;：:]+$', '', 'g')"


@query(f"SELECT pos, {_intro('abstract')} AS intro FROM all_papers WHERE abstract IS NOT NULL")
def intro_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_papers").where("abstract is not null").select("pos", t.intro_text(F.col("abstract")).alias("intro"))


_MARK_AT = "CASE WHEN instr(c, '{m}') > 0 AND length(c) - instr(reverse(c), '{m}') >= 80 THEN substr(c, 1, length(c) - instr(reverse(c), '{m}') + 1) END"


@query(
    f"""WITH i AS (SELECT pos, {_intro('abstract')} AS x FROM all_papers WHERE abstract IS NOT NULL), c AS (SELECT pos, x, rtrim(substr(x, 1, 200)) AS c FROM i)
SELECT pos, CASE WHEN length(x) <= 200 THEN x ELSE coalesce({', '.join(_MARK_AT.format(m=m) for m in '。！？；')}, regexp_replace(c, '[，,；;：:、 ]+$', '') || '。') END AS cut FROM c"""
)
def cut_intros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_papers").where("abstract is not null").select("pos", t.truncate_intro(F.col("abstract"), 200).alias("cut"))


_KEY = r"lower(regexp_replace(regexp_replace(regexp_replace({x}, '^[#\s\x{{a0}}\x{{3000}}]+', ''), '^[0-9]+(?:\.[0-9]+)*\.?[\s\x{{a0}}\x{{3000}}]*', ''), '[：:()\[\]【】\-—_\s\x{{a0}}\x{{3000}}]+', '', 'g'))"


@query(f"SELECT section, {_KEY.format(x='section')} AS key, count(*) AS n FROM visual_items WHERE section IS NOT NULL GROUP BY 1")
def heading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "visual_items").where("section is not null").groupBy("section").agg(F.count("*").alias("n"))
    return items.select("section", t.heading_key(F.col("section")).alias("key"), "n")


# ---- Markdown ----------------------------------------------------------------------------------------

_LINES = r"string_split_regex(text, '\r\n|\r|\n')"
_STRIPPED = f"list_transform({_LINES}, lambda x: {_strip('x')})"


@query(
    f"""SELECT doc_id, {_strip("regexp_replace(regexp_extract(text, '(?m)^[ ' || chr(9) || ']*(# [^' || chr(10) || chr(13) || ']*)', 1), '^#+', '')")} AS title,
 list_filter({_STRIPPED}, lambda x: regexp_matches(x, '^#{{1,4}}\\s+\\S+'))[1:24] AS heads FROM documents WHERE text IS NOT NULL"""
)
def markdown_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents").where("text is not null"), F.col("text")
    return docs.select("doc_id", t.markdown_title(text).alias("title"), t.markdown_headings(text).alias("heads"))


@query(
    f"""WITH l AS (SELECT doc_id, {_squeeze("array_to_string(list_filter(" + _STRIPPED + ", lambda x: x <> '' AND NOT starts_with(x, '!') AND NOT starts_with(x, '<')), ' ')")} AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, {_truncated('x', 300)} AS lead FROM l"""
)
def leading_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", t.leading_text(F.col("text"), 300).alias("lead"))


def _section_ctes(size: int) -> str:
    """CTEs that end in ``t`` (doc_id, x): the squeezed body of the section named abstract."""
    return f"""r AS (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, {_LINES} AS l FROM documents WHERE text <> '')),
s AS (SELECT doc_id, min(n) AS head_no FROM r WHERE lower({_strip("trim(" + _strip('line') + ", '#')")}) = 'abstract' GROUP BY doc_id),
b AS (SELECT r.doc_id, n, {_strip('line')} AS line, sum(CASE WHEN {_strip('line')} <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY r.doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS filled, starts_with(line, '#') AS head
 FROM r JOIN s ON r.doc_id = s.doc_id AND n > head_no),
e AS (SELECT doc_id, min(n) AS stop FROM b WHERE head AND filled > 0 GROUP BY doc_id),
t AS (SELECT doc_id, {_truncated('x', size)} AS x FROM (SELECT b.doc_id, {_squeeze("string_agg(line, ' ' ORDER BY n)")} AS x FROM b LEFT JOIN e ON b.doc_id = e.doc_id WHERE line <> '' AND (stop IS NULL OR n < stop) GROUP BY b.doc_id))"""


@query(
    f"""WITH {_section_ctes(500)}
SELECT d.doc_id, coalesce(x, '') AS body FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id WHERE text <> ''"""
)
def abstract_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    return docs.select("doc_id", t.named_section(F.col("text"), "abstract", 500).alias("body"))


@query(
    f"""WITH r AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''))
SELECT doc_id, pos, length(regexp_extract(line, '^(#{{2,4}})\\s', 1)) AS level, regexp_extract(line, '^#{{2,4}}\\s+(.+?)\\s*$', 1) AS heading FROM r
WHERE regexp_matches(line, '^#{{2,4}}\\s+\\S') AND {_KEY.format(x="regexp_extract(line, '^#{{2,4}}\\s+(.+?)\\s*$', 1)")} <> '相关图表'""".replace("{{", "{").replace("}}", "}")
)
def summary_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visuals.headings(table(spark, sf_dir, "documents").where("text <> ''"), "doc_id", "text", 2, 4)


@query(
    "SELECT pos, line, regexp_extract(line, '^\\s*\\+\\s+(.+?)\\s*\\[Paper\\]\\(([^)]+)\\)', 1) AS found_title, regexp_extract(line, '^\\s*\\+\\s+(.+?)\\s*\\[Paper\\]\\(([^)]+)\\)', 2) AS found_url "
    "FROM (SELECT pos, '+ ' || title || ' [Paper](' || url || ')' AS line FROM all_papers WHERE title IS NOT NULL AND url IS NOT NULL) WHERE regexp_matches(line, '^\\s*\\+\\s+(.+?)\\s*\\[Paper\\]\\(([^)]+)\\)')"
)
def bibliography_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "all_papers").where("title is not null and url is not null")
    lines = papers.select("pos", F.concat(F.lit("+ "), "title", F.lit(" [Paper]("), "url", F.lit(")")).alias("line"))
    parsed = lines.select("pos", "line", t.bibliography_line(F.col("line")).alias("x")).where("x is not null")
    return parsed.select("pos", "line", F.col("x.title").alias("found_title"), F.col("x.url").alias("found_url"))


@query(
    f"""SELECT DISTINCT source_stem, item_index, CASE WHEN regexp_matches(path, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://|#)') OR regexp_matches(path, '[)]') THEN '![x](' || path || ') end' ELSE '![x](img/' || {_base('path')} || ') end' END AS md
 FROM visual_items WHERE path <> ''"""
)
def rewritten_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "visual_items").where("path <> ''").select("source_stem", "item_index", "path").distinct()
    md = F.concat(F.lit("![x]("), "path", F.lit(") end"))
    paths = F.create_map(t.strip(F.col("path")), F.concat(F.lit("img/"), t.base_name(F.col("path"))))
    return items.select("source_stem", "item_index", t.rewrite_images(md, paths).alias("md"))


@query(
    f"""SELECT pos, {_intro('title')} AS task, CASE WHEN {_intro('title')} = '' THEN '' ELSE {_intro('title')} END AS again FROM
 (SELECT pos, regexp_replace(title, '[\\r\\n]+', ' ', 'g') AS title FROM all_papers WHERE length({_strip('title')}) > 0)"""
)
def info_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a summary's section, from summaries made of the papers' titles."""
    papers = table(spark, sf_dir, "all_papers").withColumn("title", F.regexp_replace("title", "[\r\n]+", " ")).where(~t.is_blank(F.col("title")))
    summary = F.concat(F.lit("# x\n## 基本信息\n> - 研究任务："), "title", F.lit("\n## 方法\n研究任务：other"))
    value = t.info_field(summary, "研究任务")
    return papers.select("pos", value.alias("task"), t.first_filled(value).alias("again"))


@query(
    f"""WITH {_section_ctes(1400)},
l AS (SELECT doc_id, {_strip("regexp_replace(regexp_extract(text, '(?m)^[ ' || chr(9) || ']*(# [^' || chr(10) || chr(13) || ']*)', 1), '^#+', '')")} AS title, list_filter({_STRIPPED}, lambda x: regexp_matches(x, '^#{{1,4}}\\s+\\S+'))[1:24] AS heads,
 {_squeeze("array_to_string(list_filter(" + _STRIPPED + ", lambda x: x <> '' AND NOT starts_with(x, '!') AND NOT starts_with(x, '<')), ' ')")} AS lead FROM documents WHERE text <> '')
SELECT l.doc_id, '# ' || coalesce(nullif(title, ''), 'doc-' || l.doc_id) || chr(10) || chr(10) || '> no model' || chr(10) || chr(10) || '## 摘要线索' || chr(10) || coalesce(nullif(x, ''), {_truncated('lead', 1000)}) || chr(10) || chr(10) || '## 章节线索' || chr(10)
 || CASE WHEN len(heads) > 0 THEN array_to_string(list_transform(heads, lambda h: '- ' || h), chr(10)) ELSE '- 未识别到明显章节标题' END AS report FROM l LEFT JOIN t ON l.doc_id = t.doc_id"""
)
def fallback_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports without a model."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", sections.fallback_report(name, F.col("text"), F.lit("no model")).alias("report"))


@query(
    "SELECT pos, array_to_string(h, ', ') AS matched_keywords, 'pending' AS download_status, 'pending' AS parse_status, 'pending' AS report_status FROM (SELECT pos, list_filter(['emotion', 'speech'], lambda k: contains(x, k)) AS h FROM (SELECT pos, "
    + _TEXT
    + " AS x FROM all_papers)) WHERE len(h) > 0"
)
def filtered_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter stage with its defaults: matching papers with their status columns."""
    kept = filter_stage(table(spark, sf_dir, "all_papers"), ["emotion", "speech"])
    return kept.select("pos", "matched_keywords", "download_status", "parse_status", "report_status")


def _good(x: str) -> str:
    return f"(regexp_matches({x}, '[\\x{{3400}}-\\x{{9fff}}]') AND NOT contains(lower({x}), 'llm 总结失败') AND NOT contains(lower({x}), '请修复') AND length({x}) >= 12)"


def _first_good(x: str) -> str:
    listed = f"list_filter(list_transform(regexp_extract_all({x}, '[^。！？!?；;]+[。！？!?；;]?'), lambda p: {_strip('p')}), lambda p: p <> '' AND {_good('p')})"
    return f"CASE WHEN len({listed}) > 0 THEN {listed}[1] WHEN {_good(x)} THEN {x} ELSE '' END"


_ONE_LINE = "regexp_replace(coalesce({x}, ''), '[\\r\\n#]+', ' ', 'g')"


@query(
    f"""WITH i AS (SELECT pos, {_intro(_strip(_ONE_LINE.format(x='abstract')))} AS a, {_intro(_strip(_ONE_LINE.format(x='keywords')))} AS b, CASE WHEN regexp_matches({_strip("'研究任务：' || " + _ONE_LINE.format(x='title'))}, '：\\s*.') THEN {_intro(_ONE_LINE.format(x='title'))} ELSE '' END AS t FROM all_papers),
g AS (SELECT pos, {_intro('x')} AS c1, {_intro('y')} AS c2, {_intro('t')} AS c3 FROM (SELECT pos, {_first_good('a')} AS x, {_first_good('b')} AS y, t FROM i)),
l AS (SELECT pos, list_filter([c1, CASE WHEN c2 <> c1 THEN c2 END, CASE WHEN c3 <> c1 AND c3 <> c2 THEN c3 END], lambda v: v IS NOT NULL AND {_good('v')}) AS l FROM g),
h AS (SELECT pos, {_intro("CASE WHEN len(l) = 0 THEN '' ELSE list_reduce(l, lambda h, v: CASE WHEN length(h) >= 220 THEN h ELSE h || ' ' || v END) END")} AS x FROM l),
c AS (SELECT pos, x, rtrim(substr(x, 1, 320)) AS c FROM h)
SELECT pos, CASE WHEN length(x) <= 320 THEN x ELSE coalesce({', '.join(_MARK_AT.format(m=m) for m in '。！？；')}, regexp_replace(c, '[，,；;：:、 ]+$', '') || '。') END AS introduction FROM c"""
)
def summary_introductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Introductions from summaries made of the papers' abstracts (core question), keywords (method) and titles (task)."""
    one = lambda name: F.regexp_replace(F.coalesce(name, F.lit("")), "[\r\n#]+", " ")
    summary = F.concat(
        F.lit("# x\n## 基本信息\n- 研究任务："), one("title"), F.lit("\n## 核心问题\n"), one("abstract"), F.lit("\n## 方法概述\n"), one("keywords"), F.lit("\n## 主要结果\nx")
    )
    return table(spark, sf_dir, "all_papers").select("pos", reports.introduction_from_summary(summary).alias("introduction"))


# ---- names, lists, predicates ------------------------------------------------------------------------


@query(
    "SELECT pos, updated_at, coalesce(nullif(substr(array_to_string(list_transform(string_split(matched_keywords, ','), lambda k: trim(regexp_replace(k, '[^A-Za-z0-9_.-]+', '_', 'g'), '_')), '_'), 1, 80), ''), 'keywords') AS slug FROM filtered_papers WHERE matched_keywords IS NOT NULL"
)
def keyword_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "filtered_papers").where("matched_keywords is not null")
    return papers.select("pos", "updated_at", t.keyword_slug(F.split("matched_keywords", ",")).alias("slug"))


_FLAT = r"""regexp_replace(regexp_replace(regexp_replace({x}, '[\\/:*?"<>|]+', '_', 'g'), '[\s\x{{a0}}\x{{3000}}]+', '_', 'g'), '^[._\- ]+|[._\- ]+$', '', 'g')"""


@query(
    rf"""WITH n AS (SELECT DISTINCT {_base('pdf_path')} AS name FROM parsed_papers), s AS (SELECT name, regexp_extract(name, '[^.](\.[^./\\ ]+)$', 1) AS suffix FROM n),
f AS (SELECT name, suffix, {_FLAT.format(x="substr(name, 1, length(name) - length(suffix))")} AS flat FROM s),
g AS (SELECT name, CASE WHEN suffix = '' THEN '.pdf' ELSE suffix END AS suffix, CASE WHEN flat = '' THEN 'paper' ELSE flat END AS flat FROM f),
p AS (SELECT name, suffix, list_max(list_filter(range(0, length(flat) + 1), lambda k: strlen(substr(flat, 1, k)) <= 49 - strlen(suffix))) AS k, flat FROM g)
SELECT name, CASE WHEN strlen(name) <= 60 THEN name ELSE coalesce(nullif(regexp_replace(substr(flat, 1, k), '[._\- ]+$', ''), ''), 'paper') || '-' || substr(sha1(name), 1, 10) || suffix END AS upload FROM p"""
)
def upload_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = table(spark, sf_dir, "parsed_papers").select(t.base_name(F.col("pdf_path")).alias("name")).distinct()
    return stems.select("name", t.upload_name(F.col("name"), 60).alias("upload"))


@query(
    f"SELECT pos, {_strip('coalesce(title, chr(32))')} = '' AS title_blank, {_strip('coalesce(url, chr(32))')} = '' AS url_blank, coalesce(nullif({_strip('title')}, ''), nullif({_strip('keywords')}, ''), nullif({_strip('abstract')}, ''), '') AS first_filled FROM all_papers"
)
def blank_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_papers").select(
        "pos", t.is_blank(F.col("title")).alias("title_blank"), t.is_blank(F.col("url")).alias("url_blank"), t.first_filled(F.col("title"), F.col("keywords"), F.col("abstract")).alias("first_filled")
    )


@query("SELECT path, regexp_matches(path, '^(http://|https://|data:|#|\\.\\./img/|/img/)') AS external, count(*) AS n FROM (SELECT path FROM visual_items WHERE path IS NOT NULL UNION ALL SELECT url FROM all_papers WHERE url IS NOT NULL) GROUP BY 1")
def external_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "visual_items").where("path is not null").select("path").unionByName(table(spark, sf_dir, "all_papers").where("url is not null").select(F.col("url").alias("path")))
    return paths.groupBy("path").agg(F.count("*").alias("n")).select("path", t.is_external_image(F.col("path")).alias("external"), "n")


@query("SELECT doc_id, regexp_matches(text, '[\\x{3400}-\\x{9fff}]') AND NOT contains(lower(text), 'llm 总结失败') AND NOT contains(lower(text), '请修复') AND length(text) >= 12 AS good FROM documents WHERE text IS NOT NULL")
def good_introductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", reports.good_chinese(F.col("text")).alias("good"))


@query(
    f"""SELECT pos, CASE WHEN regexp_matches(abstract, '[\\x{{3400}}-\\x{{9fff}}]') THEN {_intro('abstract')} ELSE '本文围绕《' || coalesce(nullif({_strip('title')}, ''), '该论文') || '》展开研究，主要内容包括问题背景、方法设计、实验结果和可借鉴点，详见对应博客总结。' END AS introduction FROM all_papers"""
)
def chinese_introductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_papers").select("pos", reports.chinese_introduction(F.col("abstract"), F.col("title")).alias("introduction"))


@query(
    "SELECT c AS conference, y AS year, CASE c WHEN 'CVPR' THEN 'https://openaccess.thecvf.com/CVPR' || y || '?day=all' WHEN 'ICCV' THEN 'https://openaccess.thecvf.com/ICCV' || y || '?day=all' WHEN 'ECCV' THEN 'https://www.ecva.net/papers.php' "
    "WHEN 'AAAI' THEN 'https://dblp.uni-trier.de/db/conf/aaai/aaai' || y || '.html' WHEN 'ACMMM' THEN 'https://dblp.uni-trier.de/db/conf/mm/mm' || y || '.html' END AS url, CASE WHEN c IN ('ICLR', 'ICML', 'NEURIPS') THEN 'openreview' ELSE 'openaccess' END AS source FROM "
    "(SELECT DISTINCT upper(regexp_extract(source_file, '([A-Za-z]+)[_ -]?([0-9]{4})', 1)) AS c, regexp_extract(source_file, '([A-Za-z]+)[_ -]?([0-9]{4})', 2) AS y FROM all_papers WHERE regexp_matches(source_file, '([A-Za-z]+)[_ -]?([0-9]{4})') UNION SELECT unnest(['CVPR', 'ICCV', 'ECCV', 'AAAI', 'ACMMM']), '2024')"
)
def conference_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.sources.files import resolve_source

    named = table(spark, sf_dir, "all_papers").select(t.source_of_file(F.col("source_file")).alias("s")).where("s is not null").select("s.conference", "s.year")
    known = spark.createDataFrame([(c, "2024") for c in ("CVPR", "ICCV", "ECCV", "AAAI", "ACMMM")], "conference string, year string")
    both = named.unionByName(known).distinct()
    return both.select("conference", "year", t.conference_url(F.col("conference"), F.col("year")).alias("url"), resolve_source(F.col("conference"), F.lit("auto")).alias("source"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS found FROM events")
def searched_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", t.json_search(F.col("props"), ["k", "missing"]).alias("found"))


@query(f"SELECT pos, {_strip('title')} AS answer FROM all_papers WHERE title IS NOT NULL")
def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers read from responses in two of the known shapes, made of the papers' titles."""
    papers = table(spark, sf_dir, "all_papers").where("title is not null")
    choices = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("title").alias("content")).alias("message"))).alias("choices")))
    plain = F.to_json(F.struct(F.struct(F.col("title").alias("content")).alias("data")))
    return papers.select("pos", t.chat_content(F.when(F.col("pos") % 2 == 0, choices).otherwise(plain)).alias("answer"))


# ---- reports, figures, status ------------------------------------------------------------------------


@query(
    f"""WITH u AS (SELECT DISTINCT {_base('pdf_path')} AS name, 'data/reports/' || stem AS path FROM parsed_papers), v AS (SELECT name, max(path) AS path FROM u GROUP BY name)
SELECT pos, updated_at, CASE WHEN path IS NOT NULL THEN 'done' ELSE report_status END AS report_status, coalesce(path, report_path) AS report_path
FROM filtered_papers LEFT JOIN v ON trim(coalesce(pdf_path,'')) <> '' AND {_base('pdf_path')} = name"""
)
def report_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "parsed_papers").select("pdf_path", F.lit("done").alias("report_status"), F.concat(F.lit("data/reports/"), F.col("stem")).alias("report_path"))
    return tables.upsert_by_file(table(spark, sf_dir, "filtered_papers"), updates, ["report_status", "report_path"]).select("pos", "updated_at", "report_status", "report_path")


@query(
    f"""SELECT id, coalesce(nullif({_strip('t')}, ''), id) AS title, coalesce(nullif({_strip('t')}, ''), id) AS full_title, year, 'Uncategorized' AS category, coalesce(nullif({_strip('type')}, ''), 'Unknown') AS type, coalesce(nullif({_strip('venue')}, ''), 'Unknown') AS venue,
 coalesce(nullif({_strip('abstract')}, ''), '') AS introduction FROM (SELECT coalesce(nullif({_strip('paper_id')}, ''), 'paper-' || (pos + 1)) AS id, title AS t, type, abstract, upper(regexp_extract(source_file, '([A-Za-z]+)[_ -]?([0-9]{{4}})', 1)) AS venue, try_cast(regexp_extract(source_file, '([A-Za-z]+)[_ -]?([0-9]{{4}})', 2) AS INTEGER) AS year FROM all_papers)"""
)
def report_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "all_papers")
    source = t.source_of_file(F.col("source_file"))
    none = F.lit(None).cast("string")
    rows = papers.select(
        "pos", F.col("paper_id").alias("id"), none.alias("slug"), "title", none.alias("fullTitle"), source["year"].alias("year"), none.alias("category"), "type", none.alias("modality"),
        F.lit(None).cast("array<string>").alias("tags"), F.col("abstract").alias("introduction"), source["conference"].alias("venue"),
    )
    return facets.report_view(rows).select("id", "title", F.col("fullTitle").alias("full_title"), "year", "category", "type", "venue", "introduction")


@query(
    "SELECT DISTINCT paper_id, 'reports/' || paper_id || '/paper.json' AS metadata, 'reports/' || paper_id || '/blog.md' AS blog, 'reports/' || paper_id || '/img' AS images, '/blog/' || paper_id AS slug FROM all_papers WHERE paper_id IS NOT NULL"
)
def report_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "all_papers").where("paper_id is not null").select("paper_id").distinct()
    return papers.select("paper_id", reports.report_paths(F.col("paper_id")).alias("p")).select("paper_id", "p.*")


_SLUG = "trim(substr(trim(regexp_replace(lower({x}), '[^A-Za-z0-9]+', '-', 'g'), '-'), 1, 80), '-')"


@query(
    f"SELECT pos, CASE WHEN own = '' THEN fallback WHEN slug = '' THEN fallback ELSE slug END AS id FROM (SELECT pos, own, {_SLUG.format(x='own')} AS slug, 'stem' AS fallback FROM (SELECT pos, trim(regexp_replace({_strip('coalesce(url, chr(32))')}, '(?i)^/blog/', ''), '/') AS own FROM all_papers))"
)
def report_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from the address where there is one; without title and address the stem is left."""
    return table(spark, sf_dir, "all_papers").select("pos", reports.report_id(F.col("url"), F.lit(""), F.lit("stem")).alias("id"))


@query(
    "SELECT DISTINCT source_stem, item_index, least(length(coalesce(path,'')) * 1000.0 * item_index / 1e5, 10.0) + CASE WHEN coalesce(caption, '') <> '' THEN 8.0 ELSE 0.0 END - CASE WHEN page <= 1 THEN 1.0 ELSE 0.0 END AS score FROM visual_items"
)
def figure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each item as a figure; the tables hold no sizes, so the path's length and the index stand for them."""
    items = table(spark, sf_dir, "visual_items")
    width, height = F.length(F.coalesce("path", F.lit(""))) * F.lit(1000.0), F.col("item_index")
    return items.select("source_stem", "item_index", figures.figure_score(width, height, F.col("caption"), F.col("page")).alias("score")).distinct()


_LABEL, _STOP = "(?i)^((?:fig(?:ure)?\\.?|table)\\s*[0-9]+)", "(?i)^(?:fig(?:ure)?\\.?|table|abstract|introduction|conclusion)"
_LABELS = f"""WITH t AS (SELECT source_stem, string_agg(caption, chr(10) || chr(10) ORDER BY item_index, caption) AS text FROM (SELECT DISTINCT source_stem, item_index, caption FROM visual_items WHERE caption <> '') GROUP BY 1),
r AS (SELECT source_stem, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT source_stem, list_filter({_STRIPPED}, lambda x: x <> '') AS l FROM t)),
a AS (SELECT a.source_stem, a.n, lower(regexp_extract(a.line, '{_LABEL}', 1)) AS label, a.line, min(b.n) AS stop FROM r a LEFT JOIN r b ON a.source_stem = b.source_stem AND b.n > a.n AND b.n <= a.n + 5 AND regexp_matches(b.line, '{_STOP}') WHERE regexp_matches(a.line, '{_LABEL}') GROUP BY 1, 2, 3, 4),
m AS (SELECT a.source_stem, label, a.n, a.line || coalesce(' ' || string_agg(b.line, ' ' ORDER BY b.n), '') AS caption FROM a LEFT JOIN r b ON a.source_stem = b.source_stem AND b.n > a.n AND b.n <= a.n + 5 AND (stop IS NULL OR b.n < stop) GROUP BY 1, 2, 3, a.line)
SELECT source_stem, label, n AS line_no, substr(caption, 1, 600) AS caption FROM m QUALIFY row_number() OVER (PARTITION BY source_stem, label ORDER BY n DESC) = 1"""


@query(_LABELS)
def figure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    captions = table(spark, sf_dir, "visual_items").where("caption <> ''").select("source_stem", "item_index", "caption").distinct()
    texts = captions.groupBy("source_stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_index", "caption"))), lambda x: x["caption"]), "\n\n").alias("text"))
    return figures.figure_labels(texts, "source_stem", "text")


@query(
    f"""WITH l AS ({_LABELS}), p AS (SELECT DISTINCT source_stem, unnest(range(0, 4)) AS page FROM visual_items),
d AS (SELECT p.source_stem, p.page, label, caption, row_number() OVER (PARTITION BY p.source_stem, p.page ORDER BY abs(line_no - (p.page * 40 + 20)), line_no) AS k FROM p JOIN l ON p.source_stem = l.source_stem AND line_no >= p.page * 40 AND line_no < p.page * 40 + 90)
SELECT p.source_stem, p.page, label, caption FROM p LEFT JOIN d ON p.source_stem = d.source_stem AND p.page = d.page AND k = 1"""
)
def captions_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "visual_items").select("source_stem").distinct().select("source_stem", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page"))
    return figures.page_captions(pages, figure_labels(spark, sf_dir), "source_stem")


@query("SELECT job_id, CASE max(CASE WHEN regexp_matches(message, '(?i)summari[sz]|成功生成摘要') THEN 2 WHEN regexp_matches(message, '(?i)pars(e|ed|ing)|成功解析') THEN 1 ELSE 0 END) WHEN 2 THEN 'summarizing' WHEN 1 THEN 'parsing' ELSE 'queued' END AS stage, count(*) AS lines FROM job_log GROUP BY job_id")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.last_state(table(spark, sf_dir, "job_log"))


@query(
    """WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'exit0' WHEN 'purchase' THEN 'exit1' ELSE event_type END AS event FROM events),
s AS (SELECT event_id, count(*) FILTER (event IN ('exit0', 'exit1')) OVER w AS ended, count(*) FILTER (event = 'exit0') OVER w AS done, count(*) FILTER (event IN ('exit1', 'error')) OVER w AS bad, count(*) FILTER (event = 'cancel') OVER w AS gone,
 count(*) FILTER (event = 'start') OVER w AS begun FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT *, CASE WHEN gone > 0 THEN 'canceled' WHEN ended >= 20 AND bad > 0 THEN 'failed' WHEN ended >= 20 THEN 'completed' WHEN begun > 0 THEN 'running' ELSE 'queued' END AS status FROM s)
SELECT event_id, CAST(ended AS INTEGER) AS current_index, CAST(done AS INTEGER) AS completed, CAST(bad AS INTEGER) AS failed_files, status, CASE status WHEN 'failed' THEN 1 WHEN 'completed' THEN 0 END AS exit_code FROM t"""
)
def job_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of jobs of 20 files after each event; users stand for jobs, kinds of events for starts and ends."""
    kind = F.col("event_type")
    event = F.when(kind == "view", "start").when(kind == "click", "exit0").when(kind == "purchase", "exit1").otherwise(kind)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", event.alias("event"), F.lit(20).alias("total"))
    return joblog.job_states(rows, "user_id", ["event_id"], "event", "total").select("event_id", "current_index", "completed", "failed_files", "status", "exit_code")


_CHUNKS = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM documents WHERE text <> '')
SELECT doc_id, unnest(range(len(p))) AS n, unnest(p) AS chunk, len(p) AS total FROM p WHERE len(p) > 0"""


@query(f"SELECT doc_id, n, 'Source doc-' || doc_id || ', part ' || (n + 1) || ' of ' || total || ': ' || chunk AS prompt FROM ({_CHUNKS})")
def chunk_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", sections.paragraphs(F.col("text")).alias("p"))
    rows = docs.select("doc_id", F.size("p").alias("total"), F.posexplode("p").alias("n", "chunk"))
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", "n", sections.chunk_prompt("Source {source_name}, part {index} of {total}: {chunk}", name, F.col("chunk"), F.col("n") + 1, F.col("total")).alias("prompt"))


@query(f"SELECT doc_id, 'doc-' || doc_id || ': ' || string_agg('### 分片 ' || (n + 1) || chr(10) || chunk, chr(10) || chr(10) ORDER BY n) AS prompt FROM ({_CHUNKS}) GROUP BY doc_id")
def reduce_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", sections.paragraphs(F.col("text")).alias("p")).where("size(p) > 0")
    return docs.select("doc_id", sections.reduce_prompt("{source_name}: {merged}", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("p")).alias("prompt"))
