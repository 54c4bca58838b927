"""Readers of tables, listings, JSON, pages and notes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litlake.functions.text import clean_text, strip

# Cells that a table reader takes for missing.
MISSING = ("", "#N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def nulls_of_csv(df: DataFrame) -> DataFrame:
    """String cells that stand for a missing value become null."""
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")) for c, k in df.dtypes if k == "string"})


def read_table(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A table by its suffix: .csv with a header, .xlsx (a sheet by name or number), .parquet or .json; others are errors.

    CSV and Excel cells are strings; cells that stand for a missing value are null.
    """
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        # A byte order mark, quotes and line feeds in cells are part of the format.
        df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
        first = df.columns[0].lstrip("﻿")
        return nulls_of_csv(df.withColumnRenamed(df.columns[0], first))
    if suffix == "xlsx":
        return read_excel(spark, path, sheet)
    if suffix in ("parquet", "json"):
        return spark.read.format(suffix).load(path)
    raise ValueError(f"unknown kind of table: {path}")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _cell_text(element: ElementTree.Element) -> str:
    """A cell's text; characters that XML can't hold stand in it as _xHHHH_."""
    text = "".join(t.text or "" for t in element.iter(f"{_SHEET}t"))
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _parsed(book: zipfile.ZipFile, part: str, *path: str) -> Iterator[ElementTree.Element]:
    """Elements at ``path`` under the root of a part, one at a time; the part is never held as a whole."""
    tags = [f"{_SHEET}{tag}" for tag in path]
    with book.open(part) as xml:
        above: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(xml, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if 0 < len(above) <= len(tags):
                if [e.tag for e in (*above[1:], element)] == tags:
                    yield element
                above[-1].clear()


def _sheet_rows(source: str | bytes, sheet: str | int) -> Iterator[list[str | None]]:
    """Rows of a workbook, a local path or a content, as they are read; of shared strings those read so far are kept."""
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(source if isinstance(source, str) else io.BytesIO(source)) as book:
        shared: list[str] = []
        strings = _parsed(book, "xl/sharedStrings.xml", "si")
        sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{_SHEET}sheets/{_SHEET}sheet")
        chosen = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[chosen.get(rel)].lstrip("/")
        for row in _parsed(book, target if target.startswith("xl/") else f"xl/{target}", "sheetData", "row"):
            cells: dict[int, str | None] = {}
            for n, c in enumerate(row.iterfind(f"{_SHEET}c")):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                place = n
                if letters:
                    place = 0
                    for x in letters:
                        place = place * 26 + ord(x) - 64
                    place -= 1
                kind, value = c.get("t"), c.find(f"{_SHEET}v")
                if kind == "inlineStr":
                    cells[place] = _cell_text(c)
                elif value is not None and kind == "s":
                    while len(shared) <= int(value.text):
                        shared.append(_cell_text(next(strings)))
                    cells[place] = shared[int(value.text)]
                elif value is not None:
                    cells[place] = value.text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]


#: Characters of a block of rows, about.
_BLOCK = 4_000_000


def _blocks(rows: Iterator[list[str | None]], width: int) -> Iterator[list[list[str | None]]]:
    """Rows of ``width`` cells in blocks of about ``_BLOCK`` characters."""
    block, size = [], 0
    for row in rows:
        block.append((row + [None] * width)[:width])
        size += width + sum(map(len, filter(None, row)))
        if size >= _BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet of each .xlsx file of ``path``, the first row as header; all cells strings.

    A workbook is parsed in one task, row by row, as its format can't be split.
    Files of a folder that all machines share are opened there, those of other
    stores come as their content.  The driver gets the header only.
    """
    files = spark.read.format("binaryFile").load(path)
    first = files.agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(path)
    source = F.regexp_replace("path", "^file:(//)?", "") if first.startswith("file:") else F.col("content")

    def head(batches):
        for batch in batches:
            for book in batch["source"]:
                yield pd.DataFrame({"header": [next(_sheet_rows(book, sheet), [])]})

    found = files.where(F.col("path") == first).select(source.alias("source")).mapInPandas(head, "header array<string>").first()[0]
    header = [c if c is not None else f"column_{i + 1}" for i, c in enumerate(found)]
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])

    def parse(batches):
        for batch in batches:
            for book in batch["source"]:
                rows = _sheet_rows(book, sheet)
                next(rows, None)
                for body in _blocks(rows, len(header)):
                    yield pd.DataFrame(body, columns=header, dtype=object)

    return nulls_of_csv(files.select(source.alias("source")).mapInPandas(parse, schema))


def list_files(spark: SparkSession, path: str, suffix: str = "pdf", recursive: bool = False, limit: int | None = None) -> DataFrame:
    """(path) of files with the suffix, whatever its case, sorted; contents are not read."""
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    listed = files.select("path").orderBy("path")
    return listed if limit is None else listed.limit(limit)


def detect_column(df: DataFrame, preferred: str, candidates: list[str]) -> str:
    """The preferred name; else the first candidate that equals a column without case and spaces; else that a column contains."""
    if preferred in df.columns:
        return preferred
    flat = {re.sub(r"\s+", "", c).lower(): c for c in df.columns}
    for test in (lambda c, k: c == k, lambda c, k: k in c):
        for candidate in candidates:
            for key, column in flat.items():
                if test(key, candidate.lower()):
                    return column
    raise KeyError(f"no column like {preferred} in {df.columns}")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """All report records of a folder's JSON files but ``paper.json``; unreadable files are left out."""
    schema = (
        "id string, title string, fullTitle string, year int, category string, type string, modality string, tags array<string>, "
        "introduction string, blog struct<enabled:boolean,slug:string>, venue string, _bad string"
    )
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/*.json")
    named = df.select("*", F.col("_metadata.file_name").alias("__file"))
    return named.where("_bad is null and __file <> 'paper.json'").drop("_bad", "__file")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Content blocks (file, pos, type, text, text_level, page_idx, path, caption, footnote, table_body) of JSON arrays.

    Captions and footnotes are strings or arrays of strings and stand under
    several names; the first that is filled counts.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    items = raw.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "block"))

    def texts(*names: str) -> Column:
        def one(name: str) -> Column:
            value = F.get_json_object("block", f"$.{name}")
            many = F.array_join(F.from_json(value, "array<string>"), " ")
            return F.nullif(F.when(value.startswith("["), many).otherwise(value), F.lit(""))

        return F.coalesce(*[one(n) for n in names], F.lit(""))

    def field(name: str) -> Column:
        return F.get_json_object("block", f"$.{name}")

    return items.select(
        "file",
        "pos",
        field("type").alias("type"),
        field("text").alias("text"),
        field("text_level").try_cast("int").alias("text_level"),
        field("page_idx").try_cast("int").alias("page_idx"),
        F.coalesce(field("img_path"), field("image_path")).alias("path"),
        texts("image_caption", "table_caption", "caption").alias("caption"),
        texts("image_footnote", "table_footnote", "footnote").alias("footnote"),
        field("table_body").alias("table_body"),
    )


def venue_notes(notes: DataFrame, address: str = "https://openreview.net/pdf?id=") -> DataFrame:
    """Papers of a venue's notes (id, content struct with value fields), in the order of their types' first appearance.

    Line feeds in title and abstract become spaces, keywords are joined by commas, missing fields are empty.
    """
    from litlake.operators.match import submission_type

    def value(name: str) -> Column:
        return F.coalesce(F.regexp_replace(F.col(f"content.{name}.value"), "\n", " "), F.lit(""))

    return notes.select(
        F.col("id").alias("paper_id"),
        value("title").alias("title"),
        submission_type(F.col("content.venue.value")).alias("type"),
        F.coalesce(F.array_join("content.keywords.value", ","), F.lit("")).alias("keywords"),
        value("abstract").alias("abstract"),
        F.concat(F.lit(address), F.col("id")).alias("url"),
    )


def page_pairs(pages: DataFrame, title: str = r'(?s)class="ptitle"[^>]*>(.*?)</', link: str = r'(?i)<a[^>]+href="([^"]+)"[^>]*>\s*pdf\s*</a>') -> DataFrame:
    """(url, pos, title, link): the i-th title of a page's HTML with its i-th link; unequal numbers are an error."""
    rows = pages.select("url", F.regexp_extract_all("html", F.lit(title), F.lit(1)).alias("t"), F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("l"))
    # What follows reads the check's result, so that the optimizer can't drop it.
    paired = F.when(F.size("t") == F.size("l"), F.arrays_zip("t", "l")).otherwise(F.raise_error(F.lit("titles and links of a page differ in number")))
    return rows.select("url", F.posexplode(paired).alias("pos", "x")).select("url", "pos", clean_text(F.regexp_replace("x.t", "<[^>]+>", " ")).alias("title"), F.col("x.l").alias("link"))


def proceedings_entries(pages: DataFrame, skip: str = "dl.acm.org") -> DataFrame:
    """(url, pos, title, link) of the entries of a bibliography page, without links to ``skip``."""
    entries = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?s)<li[^>]*class="entry inproceedings"[^>]*>(.*?)</li>'), F.lit(1))).alias("pos", "e"))
    found = entries.select(
        "url",
        "pos",
        clean_text(F.regexp_replace(F.regexp_extract("e", r'(?s)class="title"[^>]*>(.*?)</span>', 1), "<[^>]+>", " ")).alias("title"),
        F.regexp_extract("e", r'(?s)class="head"[^>]*>.*?href="([^"]+)"', 1).alias("link"),
    )
    return found.where((F.col("link") != "") & ~F.col("link").contains(skip))


def resolve_source(conference: Column, source: Column) -> Column:
    """``auto`` becomes openreview for the venues that use it, else openaccess."""
    # Venues whose papers are notes.
    notes = F.upper(strip(conference)).isin("ICLR", "ICML", "NEURIPS")
    return F.when(F.lower(source) != "auto", F.lower(source)).when(notes, "openreview").otherwise("openaccess")


def paper_rows(pairs: DataFrame, kind: str = "", first: int = 1) -> DataFrame:
    """Papers of title and link pairs (url, pos, title, link): ids from ``first`` in order of page and place, empty strings for what is not known.

    Rows are numbered over range partitions, so no window runs over all of them.
    """
    from litlake.operators.tables import numbered

    empty = F.lit("")
    return numbered(pairs, ["url", "pos"], "__number").select(
        (F.col("__number") + (first - 1)).cast("string").alias("paper_id"), "title", F.lit(kind).alias("type"), empty.alias("keywords"), empty.alias("abstract"), F.col("link").alias("url")
    )


def block_files(listing: DataFrame) -> DataFrame:
    """(folder, path): of each folder of ``listing`` (path) its block file: the first ``_content_list.json``, else the first ``_content_list_v2.json``."""
    rank = F.when(F.col("path").endswith("_content_list.json"), 0).when(F.col("path").endswith("_content_list_v2.json"), 1)
    named = listing.withColumn("__rank", rank).where(F.col("__rank").isNotNull())
    return named.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.min(F.struct("__rank", "path")).alias("x")).select("folder", "x.path")


def latest_files(listing: DataFrame, key: str) -> DataFrame:
    """(key, path): the most recently modified path of each key of ``listing`` (key, path, modificationTime); ties go to the last path."""
    return listing.groupBy(key).agg(F.max(F.struct("modificationTime", "path")).alias("x")).select(key, "x.path")


def tables_named(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """All CSV tables of a folder whose name holds ``key``, whatever its case, with the file's name as ``source_file``; none is an error."""
    pattern = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in key)
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*{pattern}*.csv").load(folder).select("path")
    paths = [r[0] for r in names.collect()]  # one row per file of a folder
    if not paths:
        raise FileNotFoundError(f"no table named {key} in {folder}")
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    return nulls_of_csv(df).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
