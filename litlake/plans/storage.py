"""Queries that write tables and read them back, and over listings, pages and notes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake import ports
from litlake.functions import text as t
from litlake.operators import tables
from litlake.pipeline import download_stage
from litlake.plans import documents
from litlake.plans.papers import _squeeze, _strip
from litlake.session import scratch
from litlake.sources import files, sinks
from litlake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_MISSING = ", ".join(f"'{m}'" for m in files.MISSING)


def _cell(name: str) -> str:
    return f"CASE WHEN {name} NOT IN ({_MISSING}) THEN {name} END AS {name}"


@query("SELECT CAST(pos AS VARCHAR) AS pos, " + ", ".join(map(_cell, ("paper_id", "title", "type", "keywords", "abstract", "url"))) + " FROM all_papers")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All papers written as CSV and read back: all cells strings, those that stand for a missing value null."""
    path = scratch(spark, ".csv")
    sinks.write_table(table(spark, sf_dir, "all_papers").select("pos", "paper_id", "title", "type", "keywords", "abstract", "url"), path)
    return files.read_table(spark, path)


@query("SELECT CAST(pos AS VARCHAR) AS pos, " + ", ".join(map(_cell, ("title", "type", "keywords", "abstract", "url"))) + " FROM (SELECT DISTINCT pos, title, type, keywords, abstract, url FROM filtered_papers)")
def excel_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered papers written as a workbook and read back."""
    path = scratch(spark, ".xlsx")
    sinks.write_table(table(spark, sf_dir, "filtered_papers").select("pos", "title", "type", "keywords", "abstract", "url").distinct(), path)
    return files.read_table(spark, path)


@query("SELECT id, title, fullTitle, year, modality, tags, introduction, venue FROM (" + documents.ORACLES["report_metadata"] + ")")
def report_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report records written as one JSON file each and read back as one corpus."""
    path = scratch(spark, ".reports")
    documents.report_metadata(spark, sf_dir).write.option("maxRecordsPerFile", 1).json(path)
    return files.read_reports(spark, path).select("id", "title", "fullTitle", "year", "modality", "tags", "introduction", "venue")


@query("SELECT pos, paper_id, title, keywords, source_file FROM all_papers")
def partitioned_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All papers written as Parquet, a folder for each source file, and read back."""
    path = scratch(spark, ".parquet")
    sinks.write_table(table(spark, sf_dir, "all_papers").select("pos", "paper_id", "title", "keywords", "source_file"), path, ["source_file"])
    return files.read_table(spark, path).select("pos", "paper_id", "title", "keywords", F.col("source_file").cast("string"))


@query("SELECT pos, title, matched_keywords, updated_at FROM filtered_papers")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, ".json")
    sinks.write_table(table(spark, sf_dir, "filtered_papers").select("pos", "title", "matched_keywords", "updated_at"), path)
    return files.read_table(spark, path).select("pos", "title", "matched_keywords", F.to_timestamp("updated_at").alias("updated_at"))


_ENTRY = "^\\s*\\+\\s+(.+?)\\s*\\[Paper\\]\\(([^)]+)\\)"


@query(
    f"""SELECT regexp_extract(line, '{_ENTRY}', 1) AS title, regexp_extract(line, '{_ENTRY}', 2) AS url, count(*) AS n FROM (SELECT unnest(string_split(line, chr(10))) AS line FROM
 (SELECT '+ ' || title || ' [Paper](' || url || ')' AS line FROM all_papers WHERE title IS NOT NULL AND url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1)) WHERE regexp_matches(line, '{_ENTRY}') GROUP BY 1, 2"""
)
def exported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of titles and addresses written as text and read back line by line."""
    path = scratch(spark, ".txt")
    sinks.title_lines(table(spark, sf_dir, "all_papers")).select("line").write.text(path)
    found = spark.read.text(path).select(t.bibliography_line(F.col("value")).alias("x")).where("x is not null")
    return found.groupBy("x.title", "x.url").agg(F.count("*").alias("n"))


_PDF = "'2026_ICLR_' || substr(regexp_replace(" + _strip("regexp_replace(coalesce(title, 'nan'), '[\\\\/:*?\"<>|]', '_', 'g')") + ", '\\.+$', ''), 1, 200) || '.pdf'"
_PDF_URL = "CASE WHEN contains(url, '/forum?id=') OR contains(url, 'openreview.net/forum') THEN replace(url, 'forum', 'pdf') ELSE replace(url, '/article/view/', '/article/download/') END"
_WANTED = f"SELECT {_PDF} AS file, min({_PDF_URL}) AS url FROM filtered_papers WHERE {_strip("coalesce(url, '')")} <> '' GROUP BY 1"


@query(
    f"""WITH w AS ({_WANTED}) SELECT pos, updated_at, p.file AS pdf_path, CASE WHEN contains(w.url, '://') THEN 'downloaded' ELSE 'missing' END AS download_status
 FROM (SELECT pos, updated_at, {_PDF} AS file FROM filtered_papers) p LEFT JOIN w USING (file)"""
)
def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected files and statuses after the download stage with a stand-in for the network."""
    done, _ = download_stage(table(spark, sf_dir, "filtered_papers"), "ICLR", 2026, ports.HashFetcher())
    return done.select("pos", "updated_at", "pdf_path", "download_status")


@query(f"SELECT file, sha1(url) AS content, 40 AS bytes FROM ({_WANTED}) WHERE contains(url, '://')")
def downloaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the download stage fetched, written as files, listed and read back."""
    _, contents = download_stage(table(spark, sf_dir, "filtered_papers"), "ICLR", 2026, ports.HashFetcher())
    folder = scratch(spark)
    sizes = sinks.write_files(contents.where("error is null"), folder)
    listed = files.list_files(spark, folder, "pdf").select(t.base_name(F.col("path")).alias("file"))
    read = spark.read.format("binaryFile").load(folder).select(t.base_name(F.col("path")).alias("file"), F.decode("content", "UTF-8").alias("content"))
    return sizes.join(listed, "file").join(read, "file").select("file", "content", F.col("bytes").cast("int").alias("bytes"))


# ---- notes and pages ---------------------------------------------------------------------------------


@query(
    """SELECT paper_id, coalesce(replace(title, chr(10), ' '), '') AS title, CASE WHEN trim(coalesce(type,'')) = '' THEN 'unknown' WHEN contains(lower(type),'oral') THEN 'oral'
 WHEN contains(lower(type),'spotlight') THEN 'spotlight' WHEN contains(lower(type),'poster') THEN 'poster' ELSE lower(type) END AS type, coalesce(replace(keywords, ';', ','), '') AS keywords,
 coalesce(replace(abstract, chr(10), ' '), '') AS abstract, 'https://openreview.net/pdf?id=' || paper_id AS url FROM all_papers"""
)
def note_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of notes as the notes' service gives them, made of all papers."""
    value = lambda c: F.struct(c.alias("value"))
    content = F.struct(
        value(F.col("title")).alias("title"), value(F.col("type")).alias("venue"), value(F.split("keywords", ";")).alias("keywords"), value(F.col("abstract")).alias("abstract")
    )
    return files.venue_notes(table(spark, sf_dir, "all_papers").select(F.col("paper_id").alias("id"), content.alias("content")))


def _pages(spark: SparkSession, sf_dir: str, before: str, between: str, after: str, link_first: bool = False) -> DataFrame:
    """(url, html): a page for each source file with all its papers that have title and address."""
    papers = table(spark, sf_dir, "all_papers").where("source_file is not null and title is not null and url is not null")
    parts = [t.escape_html(F.col("title")), F.col("url")]
    entry = F.concat(F.lit(before), *([parts[1], F.lit(between), parts[0]] if link_first else [parts[0], F.lit(between), parts[1]]), F.lit(after))
    rows = papers.groupBy(F.col("source_file").alias("url")).agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("l"))
    return rows.select("url", F.array_join(F.transform("l", lambda x: x["e"]), "\n").alias("html"))


_ON_PAGES = f"SELECT source_file, pos, {_squeeze('title')} AS title, url FROM all_papers WHERE source_file IS NOT NULL AND title IS NOT NULL AND url <> '' AND NOT contains(url, chr(34))"


@query(f"SELECT CAST(row_number() OVER (ORDER BY source_file, pos) AS VARCHAR) AS paper_id, title, 'poster' AS type, '' AS keywords, '' AS abstract, url FROM ({_ON_PAGES})")
def page_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of proceedings pages, numbered over all pages."""
    pages = _pages(spark, sf_dir, '<dt class="ptitle"><br>', '</dt><dd>[<a href="', '">pdf</a>]</dd>')
    pages = pages.withColumn("html", F.regexp_replace("html", r'<dt class="ptitle"><br>[^\n<]*(?:\n[^\n<]*)*</dt><dd>\[<a href="">pdf</a>\]</dd>', ""))
    return files.paper_rows(files.page_pairs(pages), "poster")


@query(f"SELECT source_file AS url, title, url AS link FROM ({_ON_PAGES}) WHERE NOT contains(url, 'icml')")
def bibliography_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of bibliography pages, without those that link to one host."""
    pages = _pages(spark, sf_dir, '<li class="entry inproceedings"><nav><div class="head"><a href="', '"></a></div></nav><span class="title">', "</span></li>", link_first=True)
    return files.proceedings_entries(pages, "icml").select("url", "title", "link")


# ---- listings ----------------------------------------------------------------------------------------


@query("SELECT job_id, max_by(message, (coalesce(logged_at, TIMESTAMPTZ '1900-01-01'), message)) AS path FROM job_log GROUP BY job_id")
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest file of each key, over a listing made of the log: its times and messages."""
    log = table(spark, sf_dir, "job_log")
    return files.latest_files(log.select("job_id", F.col("message").alias("path"), F.coalesce("logged_at", F.to_timestamp(F.lit("1900-01-01"))).alias("modificationTime")), "job_id")


_LISTED = "SELECT DISTINCT 'data/' || source_stem || '/' || item_index || CASE WHEN kind = 'table' THEN '_content_list_v2.json' WHEN page % 2 = 0 THEN '_content_list.json' ELSE '.json' END AS path FROM visual_items"


@query(
    f"""SELECT folder, path FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, path, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY ends_with(path, '_v2.json'), path) AS n
 FROM ({_LISTED}) WHERE ends_with(path, '_content_list.json') OR ends_with(path, '_content_list_v2.json')) WHERE n = 1"""
)
def block_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "visual_items")
    name = F.when(F.col("kind") == "table", "_content_list_v2.json").when(F.col("page") % 2 == 0, "_content_list.json").otherwise(".json")
    listing = items.select(F.concat(F.lit("data/"), "source_stem", F.lit("/"), F.col("item_index").cast("string"), name).alias("path")).distinct()
    return files.block_files(listing)


@query(
    """WITH f AS (SELECT DISTINCT output_path AS path FROM summary_manifest WHERE output_path IS NOT NULL UNION SELECT DISTINCT raw_markdown_path FROM summary_manifest WHERE raw_markdown_path IS NOT NULL)
SELECT source_stem, CASE WHEN output_path IN (SELECT path FROM f) THEN output_path WHEN raw_markdown_path IN (SELECT path FROM f) THEN raw_markdown_path END AS artefact FROM summary_manifest"""
)
def first_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "summary_manifest")
    there = manifest.select(F.explode(F.array("output_path", "raw_markdown_path")).alias("path")).where("path is not null")
    return tables.first_artefact(manifest.select("source_stem", "output_path", "raw_markdown_path"), ["output_path", "raw_markdown_path"], there).select("source_stem", "artefact")


@query(
    f"""SELECT DISTINCT source_stem, item_index + 1 AS pos, CASE WHEN kind = 'table' THEN 'table' ELSE 'image' END AS type, page - 1 AS page_idx, path, {_strip("''")} || coalesce(caption, '') AS caption, coalesce(footnote, '') AS footnote, table_body
FROM (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY source_stem ORDER BY item_index, kind, coalesce(path,''), coalesce(caption,'')) - 1 AS INTEGER) AS item_index) FROM (SELECT DISTINCT source_stem, item_index, kind, page, path, caption, footnote, table_body FROM visual_items))"""
)
def block_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks written as one JSON array for each document and read back."""
    items = table(spark, sf_dir, "visual_items").select("source_stem", "item_index", "kind", "page", "path", "caption", "footnote", "table_body").distinct()
    block = F.struct(
        F.when(F.col("kind") == "table", "table").otherwise("image").alias("type"), (F.col("page") - 1).alias("page_idx"), F.col("path").alias("img_path"),
        F.when(F.col("caption").isNotNull(), F.array("caption")).alias("image_caption"), F.col("footnote").alias("table_footnote"), F.col("table_body"),
    )
    order = F.struct("item_index", "kind", F.coalesce("path", F.lit("")), F.coalesce("caption", F.lit("")), block.alias("b"))
    rows = items.groupBy("source_stem").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.to_json(x["b"])).alias("l"))
    first = F.to_json(F.struct(F.lit("title").alias("type"), F.col("source_stem").alias("text")))
    path = scratch(spark, ".blocks")
    rows.select(F.concat(F.lit("["), F.array_join(F.concat(F.array(first), "l"), ","), F.lit("]")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    blocks = files.read_blocks(spark, path)
    stems = blocks.where("pos = 0").select("file", F.col("text").alias("source_stem"))
    return blocks.where("pos > 0").join(stems, "file").select("source_stem", "pos", "type", "page_idx", "path", "caption", "footnote", "table_body")
