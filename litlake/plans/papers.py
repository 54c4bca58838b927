"""Queries over papers: matching, names, deduplication, upserts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.functions import text as t
from litlake.operators import match, tables
from litlake.sources import sinks
from litlake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# A text of a paper as the keyword filter sees it.
_TEXT = "lower(concat_ws(chr(10), coalesce(title,''), coalesce(abstract,''), coalesce(keywords,'')))"
_WS = r"[\s\x{a0}\x{3000}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{1680}\x{85}\x{1c}-\x{1f}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _matched(df: DataFrame, columns: tuple[str, ...] = ("pos", "paper_id", "matched_keywords")) -> DataFrame:
    return df.select(*columns)


def _hits_sql(keywords: list[str], text: str, test: str = "contains(text, k)") -> str:
    words = ", ".join(f"'{k}'" for k in keywords)
    return f"SELECT *, list_filter([{words}], lambda k: {test}) AS h FROM (SELECT *, {text} AS text FROM all_papers)"


@query(f"SELECT pos, paper_id, array_to_string(h, ', ') AS matched_keywords FROM ({_hits_sql(['emotion', 'gaze', 'prosody'], _TEXT)}) WHERE len(h) > 0")
def keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(match.filter_papers(table(spark, sf_dir, "all_papers"), ["emotion", "gaze", "prosody"]))


@query(f"SELECT pos, paper_id, array_to_string(h, ', ') AS matched_keywords FROM ({_hits_sql(['study', 'emotion'], _TEXT)}) WHERE len(h) = 2")
def keyword_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(match.filter_papers(table(spark, sf_dir, "all_papers"), ["study", "emotion"], match_all=True))


@query(
    "SELECT pos, paper_id, array_to_string(h, ', ') AS matched_keywords FROM ("
    + _hits_sql(["LLM", "Emotion"], "concat_ws(chr(10), coalesce(title,''), coalesce(keywords,''))")
    + ") WHERE len(h) > 0"
)
def keyword_case_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(match.filter_papers(table(spark, sf_dir, "all_papers"), ["LLM", "Emotion"], ["title", "keywords"], case_sensitive=True))


@query(
    "SELECT pos, paper_id, array_to_string(h, ', ') AS matched_keywords FROM ("
    + _hits_sql(["emotion(al)? [a-z]+ing", "[0-9]+ recordings report"], _TEXT, "regexp_matches(text, k)")
    + ") WHERE len(h) > 0"
)
def keyword_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(match.filter_papers(table(spark, sf_dir, "all_papers"), ["emotion(al)? [a-z]+ing", "[0-9]+ recordings report"], regex=True))


@query(
    "SELECT pos, paper_id, array_to_string(h, ', ') AS matched_keywords FROM ("
    + _hits_sql(["stress"], _TEXT)
    + ") WHERE len(h) > 0 AND lower(trim(coalesce(type, 'nan'))) IN ('oral', 'spotlight')"
)
def keyword_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(match.filter_papers(table(spark, sf_dir, "all_papers"), ["stress"], allowed_types=["Oral", "spotlight"]))


@query(
    "SELECT pos, paper_id, array_to_string(h, ', ') AS matched_keywords FROM ("
    + _hits_sql(["nan"], "lower(concat_ws(chr(10), coalesce(title,'nan'), coalesce(abstract,'nan'), coalesce(keywords,'nan')))")
    + ") WHERE len(h) > 0"
)
def keyword_null_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(match.filter_papers(table(spark, sf_dir, "all_papers"), ["nan"], null_text="nan"))


@query("SELECT source_file, pos, paper_id, title FROM all_papers WHERE regexp_matches(coalesce(title,'nan'), '(?i)emotion|affect') AND lower(type) IN ('poster', 'oral')")
def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "all_papers")
    return match.title_filter(papers, "emotion|affect", ["poster", "oral"]).select("source_file", "pos", "paper_id", "title")


@query(
    "SELECT pos, array_to_string(list_filter(['Emotion', '[Gg]aze', 'Meets .*:'], lambda k: regexp_matches(title, k)), ', ') AS patterns FROM all_papers WHERE title IS NOT NULL"
)
def pattern_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "all_papers").where("title is not null")
    return papers.select("pos", match.pattern_provenance(F.col("title"), ["Emotion", "[Gg]aze", "Meets .*:"]).alias("patterns"))


_TYPE = """CASE WHEN trim(coalesce(type,'')) = '' THEN 'unknown' WHEN contains(lower(type),'oral') THEN 'oral'
 WHEN contains(lower(type),'spotlight') THEN 'spotlight' WHEN contains(lower(type),'poster') THEN 'poster' ELSE lower(type) END"""


@query(f"SELECT pos, {_TYPE} AS kind FROM all_papers")
def submission_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_papers").select("pos", match.submission_type(F.col("type")).alias("kind"))


@query(
    f"""WITH k AS (SELECT pos, {_TYPE} AS kind FROM all_papers), g AS (SELECT kind, row_number() OVER (ORDER BY min(pos)) AS group_order FROM k GROUP BY kind)
SELECT pos, kind, group_order FROM k JOIN g USING (kind)"""
)
def first_seen_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_seen_order(submission_types(spark, sf_dir), "kind", "pos")


@query(f"SELECT {_TYPE} AS kind, count(*) AS n, count(DISTINCT paper_id) AS papers FROM all_papers GROUP BY 1")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "all_papers").select("paper_id", match.submission_type(F.col("type")).alias("kind"))
    return papers.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("papers"))


@query(
    "SELECT pos, paper_id, 'pending' AS download_status, '' AS pdf_path, 'pending' AS parse_status, '' AS parsed_dir, 'pending' AS report_status, '' AS report_path FROM all_papers"
)
def status_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ensure_columns(table(spark, sf_dir, "all_papers").select("pos", "paper_id"))


def _base(column: str) -> str:
    return f"regexp_extract({column}, '([^/\\\\]*)$', 1)"


@query(
    f"""WITH files AS (SELECT DISTINCT {_base('pdf_path')} AS file FROM parsed_papers)
SELECT pos, e AS pdf_path, CASE WHEN file IS NULL THEN 'missing' ELSE 'downloaded' END AS download_status
FROM (SELECT pos, updated_at, {_base('pdf_path')} AS e FROM filtered_papers) LEFT JOIN files ON e = file"""
)
def status_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "filtered_papers").withColumn("old_path", F.col("pdf_path"))
    files = table(spark, sf_dir, "parsed_papers").select(F.col("pdf_path").alias("path"))
    return tables.reconcile_files(papers, t.base_name(F.col("old_path")), files).select("pos", "pdf_path", "download_status")


@query(
    f"""WITH u AS (SELECT DISTINCT {_base('pdf_path')} AS name, 'data/parsed/' || stem AS dir FROM parsed_papers), v AS (SELECT name, max(dir) AS dir FROM u GROUP BY name)
SELECT pos, updated_at, CASE WHEN dir IS NOT NULL THEN 'parsed' ELSE parse_status END AS parse_status, coalesce(dir, parsed_dir) AS parsed_dir
FROM filtered_papers LEFT JOIN v ON trim(coalesce(pdf_path,'')) <> '' AND {_base('pdf_path')} = name"""
)
def status_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = table(spark, sf_dir, "parsed_papers").select("pdf_path", F.lit("parsed").alias("parse_status"), F.concat(F.lit("data/parsed/"), F.col("stem")).alias("parsed_dir"))
    out = tables.upsert_by_file(table(spark, sf_dir, "filtered_papers"), updates, ["parse_status", "parsed_dir"])
    return out.select("pos", "updated_at", "parse_status", "parsed_dir")


@query(
    f"""WITH f AS (SELECT *, {_base('pdf_path')} AS name FROM filtered_papers WHERE trim(coalesce(pdf_path,'')) <> ''),
r AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY pos, updated_at) = 1)
SELECT DISTINCT file, pos, paper_id FROM (SELECT {_base('pdf_path')} AS file FROM parsed_papers) LEFT JOIN r ON file = name"""
)
def first_status_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "parsed_papers").select(t.base_name(F.col("pdf_path")).alias("file")).distinct()
    return tables.first_status_row(names, table(spark, sf_dir, "filtered_papers"), "pos").select("file", "pos", "paper_id")


@query("SELECT DISTINCT stem FROM parsed_papers WHERE stem NOT IN (SELECT source_stem FROM summary_manifest WHERE source_stem IS NOT NULL)")
def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "summary_manifest").select(F.col("source_stem").alias("stem"))
    return tables.without_artefacts(table(spark, sf_dir, "parsed_papers").select("stem").distinct(), done, "stem")


@query(
    """WITH g AS (SELECT DISTINCT stem, 'new' AS status, page_count AS visual_count FROM parsed_papers)
SELECT coalesce(g.stem, m.source_stem) AS stem, coalesce(m.status, g.status) AS status, coalesce(m.visual_count, g.visual_count) AS visual_count
FROM g FULL JOIN (SELECT DISTINCT source_stem, status, visual_count FROM summary_manifest) m ON g.stem = m.source_stem"""
)
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    generated = table(spark, sf_dir, "parsed_papers").select("stem", F.lit("new").alias("status"), F.col("page_count").alias("visual_count")).distinct()
    existing = table(spark, sf_dir, "summary_manifest").select(F.col("source_stem").alias("stem"), "status", "visual_count").distinct()
    return tables.merge_metadata(generated, existing, "stem")


@query(
    """SELECT stem, visual_count FROM (SELECT DISTINCT stem, page_count AS visual_count FROM parsed_papers) p
WHERE NOT EXISTS (SELECT 1 FROM summary_manifest m WHERE m.source_stem = p.stem AND m.visual_count IS NOT DISTINCT FROM p.visual_count)"""
)
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = table(spark, sf_dir, "parsed_papers").select("stem", F.col("page_count").alias("visual_count")).distinct()
    before = table(spark, sf_dir, "summary_manifest").select(F.col("source_stem").alias("stem"), "visual_count").distinct()
    return tables.changed_rows(before, after, "stem", ["visual_count"])


@query("SELECT pos, url, paper_id FROM all_papers QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.keep_first(table(spark, sf_dir, "all_papers").select("pos", "url", "paper_id"), ["url"], "pos")


@query("SELECT pos, '+ ' || title || ' [Paper](' || url || ')' AS line FROM all_papers WHERE title IS NOT NULL AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1")
def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.title_lines(table(spark, sf_dir, "all_papers"))


@query("SELECT pos, title, NULL AS matched_keywords FROM all_papers UNION ALL SELECT pos, title, matched_keywords FROM filtered_papers")
def table_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.union_by_name([table(spark, sf_dir, "all_papers").select("pos", "title"), table(spark, sf_dir, "filtered_papers").select("pos", "title", "matched_keywords")])


# ---- names, addresses, titles ---------------------------------------------------------------------


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


@query(
    "SELECT pos, '2026_' || upper(split_part(source_file, '_', 1)) || '_' || substr(regexp_replace("
    + _strip("regexp_replace(title, '[\\\\/:*?\"<>|]', '_', 'g')")
    + ", '\\.+$', ''), 1, 200) || '.pdf' AS file FROM all_papers WHERE title IS NOT NULL AND source_file IS NOT NULL"
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "all_papers").where("title is not null and source_file is not null")
    conference = F.upper(F.split("source_file", "_")[0])
    return papers.select("pos", t.pdf_name(F.lit(2026), conference, F.col("title")).alias("file"))


@query(
    "SELECT pos, trim(substr(trim(regexp_replace(lower("
    + _strip("title")
    + "), '[^A-Za-z0-9]+', '-', 'g'), '-'), 1, 80), '-') AS slug FROM all_papers WHERE title IS NOT NULL"
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_papers").where("title is not null").select("pos", t.slug(F.col("title")).alias("slug"))


_FLAT = f"""regexp_replace(regexp_replace(regexp_replace(stem, '[\\\\/:*?"<>|]+', '_', 'g'), '{_WS}+', '_', 'g'), '^[._\\- ]+|[._\\- ]+$', '', 'g')"""


@query(
    f"""WITH f AS (SELECT DISTINCT stem, {_FLAT} AS flat, regexp_extract({_FLAT}, '^(20[0-9][0-9]_[^_]+_).', 1) AS lead FROM parsed_papers)
SELECT stem, CASE WHEN length(flat) <= 72 THEN flat ELSE (CASE WHEN lead <> '' AND length(lead) < 61
 THEN lead || regexp_replace(substr(flat, length(lead) + 1, 61 - length(lead)), '[._\\- ]+$', '') ELSE regexp_replace(substr(flat, 1, 61), '[._\\- ]+$', '') END)
 || '-' || substr(sha1(flat), 1, 10) END AS cache FROM f"""
)
def cache_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_papers").select("stem").distinct().select("stem", t.cache_stem(F.col("stem")).alias("cache"))


@query(
    "SELECT DISTINCT stem, CASE WHEN s = '' THEN 'paper' ELSE substr(s, 1, 120) END AS safe FROM (SELECT stem, regexp_replace("
    + _squeeze("regexp_replace(stem, '[\\\\/:*?\"<>|]+', '_', 'g')")
    + ", '\\.+$', '') AS s FROM parsed_papers)"
)
def safe_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_papers").select("stem", t.safe_stem(F.col("stem")).alias("safe")).distinct()


@query(
    "SELECT pos, CASE WHEN contains(url, '/forum?id=') OR contains(url, 'openreview.net/forum') THEN replace(url, 'forum', 'pdf') ELSE replace(url, '/article/view/', '/article/download/') END AS pdf, "
    "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS bare FROM all_papers WHERE url IS NOT NULL AND url <> ''"
)
def url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, url = table(spark, sf_dir, "all_papers").where("url is not null and url <> ''"), F.col("url")
    return papers.select("pos", t.pdf_url(url).alias("pdf"), t.url_host(url).alias("host"), t.strip_query(url).alias("bare"))


@query(
    """SELECT DISTINCT stem, regexp_extract(stem, '(?s)^(20[0-9][0-9])_([^_]+)_(.+)$', 1) AS year, regexp_extract(stem, '(?s)^(20[0-9][0-9])_([^_]+)_(.+)$', 2) AS venue,
CASE WHEN regexp_matches(stem, '(?s)^20[0-9][0-9]_[^_]+_.+$') THEN trim(replace(regexp_extract(stem, '(?s)^(20[0-9][0-9])_([^_]+)_(.+)$', 3), '_', ': ')) ELSE stem END AS title FROM parsed_papers"""
)
def source_of_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_papers").select("stem", t.source_of_stem(F.col("stem")).alias("s")).select("stem", "s.year", "s.venue", "s.title").distinct()


@query(
    "SELECT source_file, upper(regexp_extract(source_file, '([A-Za-z]+)[_ -]?([0-9]{4})', 1)) AS conference, regexp_extract(source_file, '([A-Za-z]+)[_ -]?([0-9]{4})', 2) AS year, count(*) AS n FROM all_papers WHERE source_file IS NOT NULL GROUP BY 1"
)
def source_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "all_papers").where("source_file is not null").groupBy("source_file").agg(F.count("*").alias("n"))
    return counts.select("source_file", t.source_of_file(F.col("source_file")).alias("s"), "n").select("source_file", "s.conference", "s.year", "n")


@query("SELECT pos, coalesce(title,'') || '. ' || coalesce(abstract,'') AS text FROM all_papers")
def topic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litlake.operators.topics import topic_text

    return table(spark, sf_dir, "all_papers").select("pos", topic_text(F.col("title"), F.col("abstract")).alias("text"))


_CLEAN = "regexp_replace(" + f"regexp_replace(replace(regexp_replace(title, '^\\s*20[0-9][0-9][_\\s-]+[A-Za-z]+[_\\s-]+', ''), '_', ' '), '{_WS}+', ' ', 'g')" + ", '^[ .]+|[ .]+$', '', 'g')"


@query(
    f"""WITH c AS (SELECT pos, {_CLEAN} AS x FROM all_papers WHERE title <> ''),
a AS (SELECT pos, x, trim(regexp_extract(x, '^{_WS}*([A-Za-z][A-Za-z0-9-]{{1,20}}){_WS}*[:：-]{_WS}+', 1), '-') AS w, regexp_extract_all(x, '[A-Za-z0-9]+') AS ws FROM c)
SELECT pos, CASE WHEN w <> '' AND (regexp_matches(w, '[A-Z]') OR length(w) <= 8) THEN w
 WHEN len(ws) BETWEEN 2 AND 5 THEN array_to_string(ws, ' ') WHEN len(ws) > 0 THEN array_to_string(ws[1:4], ' ') ELSE 'none' END AS short FROM a"""
)
def short_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_papers").where("title <> ''").select("pos", t.short_title(F.col("title"), F.lit("none")).alias("short"))


@query("SELECT DISTINCT stem, coalesce(try_cast(nullif(regexp_extract(coalesce(year,'') || ' ' || stem, '20[0-9][0-9]', 0), '') AS INTEGER), 2026) AS y FROM parsed_papers")
def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "parsed_papers")
    return papers.select("stem", t.infer_year(F.concat_ws(" ", F.coalesce("year", F.lit("")), "stem")).alias("y")).distinct()


@query(
    "SELECT pos, updated_at, list_filter(list_transform(string_split_regex(matched_keywords, '[,;|/、，；]+'), lambda x: "
    + _strip("x")
    + "), lambda x: x <> '') AS parts FROM filtered_papers WHERE matched_keywords IS NOT NULL"
)
def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "filtered_papers").where("matched_keywords is not null")
    return papers.select("pos", "updated_at", t.split_list(F.col("matched_keywords")).alias("parts"))


@query(
    "SELECT pos, list_reduce(list_transform(parts, lambda x: [x]), lambda s, x: CASE WHEN list_contains(list_transform(s, lambda k: lower(k)), lower(x[1])) THEN s ELSE list_concat(s, x) END) AS words "
    "FROM (SELECT pos, regexp_extract_all(title, '[A-Za-z]+') AS parts FROM all_papers) WHERE len(parts) > 0"
)
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("title", F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, sf_dir, "all_papers").select("pos", words.alias("w")).where("size(w) > 0").select("pos", t.distinct_ignoring_case(F.col("w")).alias("words"))


@query(
    "WITH s AS (SELECT doc_id, "
    + _squeeze("text")
    + " AS q, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN length(q) <= 200 THEN q ELSE rtrim(substr(q, 1, 197)) || '...' END AS cut, "
    "CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 272) || chr(10) || chr(10) || '[...中间内容已截断...]' || chr(10) || chr(10) || substr(text, length(text) - 127) END AS ends FROM s"
)
def truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents").where("text is not null"), F.col("text")
    return docs.select("doc_id", t.truncate(text, 200).alias("cut"), t.head_tail(text, 400).alias("ends"))


@query(
    "SELECT doc_id, "
    + _strip("regexp_replace(regexp_replace(replace(text, chr(0), ' '), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
    + " AS normal FROM documents WHERE text IS NOT NULL"
)
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", t.normalize_text(F.col("text")).alias("normal"))


@query(
    "SELECT doc_id, u.i - 1 AS n, u.s AS sentence FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;]+[。！？!?；;]?'), lambda x: "
    + _strip("x")
    + "), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL), unnest(list_zip(range(1, len(l) + 1), l)) AS z(u0), (SELECT u0[1] AS i, u0[2] AS s) AS u"
)
def simple_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all texts, whatever their language or its tag."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(t.simple_sentences(F.col("text"))).alias("n", "sentence"))


@query("SELECT coalesce(lower(lang), 'none') AS lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[\\x{3400}-\\x{9fff}]')) AS with_han FROM documents GROUP BY 1")
def language_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.coalesce(F.lower("lang"), F.lit("none")).alias("lang")).agg(F.count("*").alias("n"), F.count_if(t.has_han(F.col("text"))).alias("with_han"))


@query(
    "SELECT pos, "
    + _squeeze("replace(replace(replace(replace(replace(abstract, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')")
    + " AS clean FROM all_papers WHERE abstract IS NOT NULL"
)
def clean_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_papers").where("abstract is not null").select("pos", t.clean_text(F.col("abstract")).alias("clean"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", value.alias("k"), value.try_cast("int").alias("n"))
