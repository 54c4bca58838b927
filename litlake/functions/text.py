"""Text functions as Column expressions.

White space means Unicode white space, lengths are code points, and null gives
null unless a function says otherwise.
"""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litlake.functions.unicode import SPACE

HAN = r"[㐀-鿿]"


def strip(column: Column, also: str = "") -> Column:
    """Without white space (and the characters of the class body ``also``) at both ends."""
    edge = f"(?U:[\\s\\x1c-\\x1f\\x85{also}])"
    return F.regexp_replace(column, f"^{edge}+|{edge}+$", "")


def rstrip(column: Column, characters: str) -> Column:
    return F.regexp_replace(column, f"[{characters}]+$", "")


def squeeze(column: Column) -> Column:
    """White-space runs become one space; stripped."""
    return F.trim(F.regexp_replace(column, SPACE + "+", " "))


def is_blank(column: Column) -> Column:
    """True for null, empty and white space only."""
    return F.coalesce(strip(column) == "", F.lit(True))


def first_filled(*columns: Column) -> Column:
    """The first column that is not blank, stripped; empty if there is none."""
    return F.coalesce(*[F.when(~is_blank(c), strip(c)) for c in columns], F.lit(""))


def has_han(column: Column) -> Column:
    return column.rlike(HAN)


# ---- names and paths -----------------------------------------------------


def sanitize_filename(title: Column) -> Column:
    r"""Each of ``\ / : * ? " < > |`` becomes ``_``; stripped; no full stop at the end; at most 200 characters."""
    return F.substring(rstrip(strip(F.regexp_replace(title, r'[\\/:*?"<>|]', "_")), "."), 1, 200)


def pdf_name(year: Column, conference: Column, title: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("_"), conference, F.lit("_"), sanitize_filename(title), F.lit(".pdf"))


def safe_stem(value: Column, size: int = 120) -> Column:
    """Runs of illegal characters become ``_``; white space squeezed; ``paper`` if nothing is left."""
    name = rstrip(squeeze(F.regexp_replace(value, r'[\\/:*?"<>|]+', "_")), ".")
    return F.substring(F.when(name == "", "paper").otherwise(name), 1, size)


def flat_stem(value: Column) -> Column:
    """Illegal characters and white space become ``_``; ``paper`` if nothing is left."""
    flat = F.regexp_replace(F.regexp_replace(value, r'[\\/:*?"<>|]+', "_"), SPACE + "+", "_")
    flat = F.regexp_replace(flat, r"^[._\- ]+|[._\- ]+$", "")
    return F.when(flat == "", "paper").otherwise(flat)


def cache_stem(value: Column, size: int = 72) -> Column:
    """A flat stem of at most ``size`` characters; longer ones end in ten hex digits of its SHA-1."""
    flat, room = flat_stem(value), size - 11
    lead = F.regexp_extract(flat, r"^(20\d{2}_[^_]+_).", 1)
    with_lead = F.concat(lead, rstrip(F.substring(flat, F.length(lead) + 1, room - F.length(lead)), r"._\- "))
    short = F.when((lead != "") & (F.length(lead) < room), with_lead).otherwise(rstrip(F.substring(flat, 1, room), r"._\- "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(short, F.lit("-"), F.substring(F.sha1(flat), 1, 10)))


def truncate_bytes(value: Column, size: int | Column) -> Column:
    """The longest prefix of at most ``size`` UTF-8 bytes that holds whole characters."""
    # A character is kept when all its bytes fit: count the bytes of every prefix without leaving the JVM.
    letters = F.split(value, "")
    kept = F.aggregate(
        letters,
        F.struct(F.lit(0).alias("used"), F.lit("").alias("text"), F.lit(False).alias("full")),
        lambda s, c: F.when(
            s["full"] | (s["used"] + F.octet_length(c) > size),
            F.struct(s["used"].alias("used"), s["text"].alias("text"), F.lit(True).alias("full")),
        ).otherwise(F.struct((s["used"] + F.octet_length(c)).alias("used"), F.concat(s["text"], c).alias("text"), F.lit(False).alias("full"))),
        lambda s: s["text"],
    )
    return F.when(F.octet_length(value) <= size, value).otherwise(kept)


def upload_name(name: Column, size: int = 120) -> Column:
    """A file name of at most ``size`` bytes; a longer one's stem is cut and gets ten hex digits of the name's SHA-1."""
    suffix = F.regexp_extract(name, r"[^.](\.[^./\\ ]+)$", 1)
    stem = flat_stem(F.substring(name, F.lit(1), F.length(name) - F.length(suffix)))
    suffix = F.when(suffix == "", ".pdf").otherwise(suffix)
    room = F.lit(size - 11) - F.octet_length(suffix)
    short = rstrip(truncate_bytes(stem, room), r"._\- ")
    short = F.when(short == "", "paper").otherwise(short)
    return F.when(F.octet_length(name) <= size, name).otherwise(F.concat(short, F.lit("-"), F.substring(F.sha1(name), 1, 10), suffix))


def slug(value: Column, size: int = 80) -> Column:
    """Lower case, runs of other than ASCII letters and digits become ``-``."""
    text = F.regexp_replace(F.lower(strip(value)), "[^A-Za-z0-9]+", "-")
    return F.trim(F.substring(F.trim(text, F.lit("-")), 1, size), F.lit("-"))


def keyword_slug(keywords: Column, size: int = 80) -> Column:
    joined = F.array_join(F.transform(keywords, lambda k: F.trim(F.regexp_replace(k, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_"))), "_")
    return F.coalesce(F.nullif(F.substring(joined, 1, size), F.lit("")), F.lit("keywords"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def source_of_stem(stem: Column) -> Column:
    """struct(year, venue, title) of a stem ``year_venue_title``; other stems are a title."""
    pattern = r"(?s)^(20\d{2})_([^_]+)_(.+)$"
    fits = stem.rlike(pattern)
    title = strip(F.replace(F.regexp_extract(stem, pattern, 3), F.lit("_"), F.lit(": ")))
    return F.struct(
        F.when(fits, F.regexp_extract(stem, pattern, 1)).otherwise("").alias("year"),
        F.when(fits, F.regexp_extract(stem, pattern, 2)).otherwise("").alias("venue"),
        F.when(fits, title).otherwise(stem).alias("title"),
    )


def source_of_file(name: Column) -> Column:
    """struct(conference, year) of the first letters-then-four-digits in a file name; null if there are none."""
    pattern = r"([A-Za-z]+)[_\- ]?(\d{4})"
    return F.when(
        name.rlike(pattern),
        F.struct(F.upper(F.regexp_extract(name, pattern, 1)).alias("conference"), F.regexp_extract(name, pattern, 2).alias("year")),
    )


# ---- addresses -----------------------------------------------------------


def pdf_url(url: Column, compat: bool = True) -> Column:
    """The address of the PDF.  ``compat`` replaces every ``forum``, else only the path's."""
    forum = url.contains("openreview.net/forum") | url.contains("/forum?id=")
    direct = F.replace(url, F.lit("forum"), F.lit("pdf")) if compat else F.regexp_replace(url, r"/forum(?=\?)", "/pdf")
    return F.when(forum, direct).otherwise(F.replace(url, F.lit("/article/view/"), F.lit("/article/download/")))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#:]+)", 1)


def strip_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def join_url(base: Column, path: Column) -> Column:
    """An address below a base address; whole addresses stay, one slash stands between."""
    return F.when(is_url(path), path).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", "")))


def is_url(value: Column) -> Column:
    return value.startswith("http://") | value.startswith("https://")


def is_external_image(path: Column) -> Column:
    # Prefixes of images that are not copied.
    prefixes = ("http://", "https://", "data:", "#", "../img/", "/img/")
    found = path.startswith(prefixes[0])
    for p in prefixes[1:]:
        found = found | path.startswith(p)
    return found


def conference_url(conference: Column, year: Column) -> Column:
    # Address templates of proceedings pages.
    templates = {
        "CVPR": "https://openaccess.thecvf.com/CVPR%s?day=all",
        "ICCV": "https://openaccess.thecvf.com/ICCV%s?day=all",
        "ECCV": "https://www.ecva.net/papers.php",
        "AAAI": "https://dblp.uni-trier.de/db/conf/aaai/aaai%s.html",
        "ACMMM": "https://dblp.uni-trier.de/db/conf/mm/mm%s.html",
    }
    name, out = F.upper(F.trim(conference)), F.lit(None).cast("string")
    for key, template in templates.items():
        value = F.format_string(template, year.cast("string")) if "%s" in template else F.lit(template)
        out = F.when(name == key, value).otherwise(out)
    return out


# ---- markup --------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def unescape(column: Column) -> Column:
    """HTML entities resolved; only values that hold ``&`` go through Python."""
    held = column.contains("&")
    return F.when(held, _unescape(F.when(held, column))).otherwise(column)


def clean_text(column: Column) -> Column:
    """Entities resolved, white space squeezed, stripped."""
    return squeeze(unescape(column))


def strip_html(column: Column) -> Column:
    """Text of an HTML fragment; cells are divided by bars."""
    text = F.regexp_replace(column, r"(?i)<\s*/\s*(tr|p|div|table)\s*>", "\n")
    text = F.regexp_replace(text, r"(?i)<\s*/\s*(td|th)\s*>", " | ")
    return clean_text(F.regexp_replace(text, "<[^>]+>", " "))


def escape_html(column: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        column = F.replace(column, F.lit(raw), F.lit(safe))
    return column


def join_texts(values: Column) -> Column:
    """The non-empty strings of an array, cleaned, joined by spaces; empty for null."""
    return F.coalesce(clean_text(F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), " ")), F.lit(""))


def truncate(column: Column, size: int) -> Column:
    """Squeezed; longer texts end in three full stops within ``size``."""
    text = squeeze(column)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, size - 3)), F.lit("...")))


#: Fixed value: what stands for the middle of a cut text.
CUT_MARK = "\n\n[...中间内容已截断...]\n\n"


def head_tail(column: Column, size: int, marker: str = CUT_MARK) -> Column:
    """Texts over ``size`` keep 68 % of it from the head, a marker, and the rest from the tail."""
    head = int(size * 0.68)
    return F.when(F.length(column) <= size, column).otherwise(
        F.concat(F.substring(column, 1, head), F.lit(marker), F.right(column, F.lit(size - head)))
    )


def normalize_text(column: Column) -> Column:
    """NUL becomes a space, blanks are squeezed, three or more line feeds become two."""
    text = F.regexp_replace(F.replace(column, F.lit("\x00"), F.lit(" ")), "[ \t]+", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def heading_key(column: Column) -> Column:
    """A heading without marks, number, punctuation and case."""
    # The marks that are removed.
    text = F.regexp_replace(column, rf"^(?:#|{SPACE})+", "")
    text = F.regexp_replace(text, rf"^\d+(?:\.\d+)*\.?{SPACE}*", "")
    return F.lower(F.regexp_replace(text, rf"(?:[：:()\[\]【】\-—_]|{SPACE})+", ""))


def intro_text(column: Column) -> Column:
    """Running text of Markdown: no images, link targets, tags, line marks and emphasis."""
    # The marks that are removed.
    text = F.regexp_replace(column, r"!\[[^\]]*\]\([^)]+\)", " ")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    text = F.regexp_replace(text, r"(?m)^[#>\-*\d.\s]+", "")
    text = squeeze(F.regexp_replace(text, "[`*_~]+", ""))
    return F.regexp_replace(text, r"^[ \t\r\n\-，,；;：:]+|[ \t\r\n\-，,；;：:]+$", "")


def simple_sentences(column: Column) -> Column:
    """Stretches up to 。！？!?；; as an array."""
    parts = F.regexp_extract_all(column, F.lit("[^。！？!?；;]+[。！？!?；;]?"), F.lit(0))
    return F.filter(F.transform(parts, lambda p: strip(p)), lambda p: p != "")


def truncate_intro(column: Column, size: int = 320) -> Column:
    """Cut after the last 。, else ！, ？ or ； from place 80 on; else ends in 。"""
    text = intro_text(column)
    cut = F.regexp_replace(F.substring(text, 1, size), SPACE + "+$", "")
    out = F.concat(F.regexp_replace(cut, "[，,；;：:、 ]+$", ""), F.lit("。"))
    for mark in "；？！。":
        place = F.length(cut) - F.instr(F.reverse(cut), mark)  # from 0
        out = F.when((F.instr(cut, mark) > 0) & (place >= 80), F.substring(cut, F.lit(1), place + 1)).otherwise(out)
    return F.when(F.length(text) <= size, text).otherwise(out)


# ---- titles and tags -----------------------------------------------------


def infer_year(column: Column, default: int = 2026) -> Column:
    found = F.regexp_extract(F.coalesce(column, F.lit("")), r"20\d{2}", 0)
    return F.when(found == "", F.lit(default)).otherwise(found.try_cast("int"))


def clean_title(column: Column) -> Column:
    title = F.regexp_replace(column, r"^\s*20\d{2}[_\s-]+[A-Za-z]+[_\s-]+", "")
    title = F.regexp_replace(F.regexp_replace(F.replace(title, F.lit("_"), F.lit(" ")), SPACE + "+", " "), "^[ .]+|[ .]+$", "")
    return F.when(title == "", column).otherwise(title)


def acronym(column: Column) -> Column:
    """A leading word before a colon or dash that has a capital or at most 8 characters; else empty."""
    word = F.trim(F.regexp_extract(column, rf"^{SPACE}*([A-Za-z][A-Za-z0-9-]{{1,20}}){SPACE}*[:：-]{SPACE}+", 1), F.lit("-"))
    return F.when(word.rlike("[A-Z]") | (F.length(word) <= 8), word).otherwise("")


def short_title(title: Column, stem: Column) -> Column:
    """Acronym of title or stem; else the title's words if 2 to 5, else its first 4; else the stem."""
    clean = clean_title(title)
    words = F.regexp_extract_all(clean, F.lit("[A-Za-z0-9]+"), F.lit(0))
    few = F.when(F.size(words).between(2, 5), F.array_join(words, " ")).when(F.size(words) > 0, F.array_join(F.slice(words, 1, 4), " ")).otherwise(stem)
    return F.coalesce(F.nullif(acronym(clean), F.lit("")), F.nullif(acronym(stem), F.lit("")), few)


def split_list(column: Column, pattern: str = "[,;|/、，；]+") -> Column:
    """Non-empty stripped parts; empty array for null."""
    parts = F.filter(F.transform(F.split(column, pattern), lambda p: strip(p)), lambda p: p != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def distinct_ignoring_case(values: Column) -> Column:
    """Values in order, the first spelling of each kept."""
    return F.aggregate(
        values,
        F.array().cast("array<string>"),
        lambda kept, v: F.when(v.isNull() | F.exists(kept, lambda k: F.lower(k) == F.lower(v)), kept).otherwise(F.array_append(kept, v)),
    )


# ---- Markdown ------------------------------------------------------------


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|\r|\n")


def markdown_title(text: Column) -> Column:
    """The first line that starts with ``# ``; empty if there is none."""
    return strip(F.regexp_replace(F.regexp_extract(text, r"(?m)^[ \t]*(# [^\n\r]*)", 1), "^#+", ""))


def markdown_headings(text: Column, most: int = 24) -> Column:
    return F.slice(F.filter(F.transform(lines(text), lambda p: strip(p)), lambda x: x.rlike(r"^#{1,4}\s+\S+")), 1, most)


def leading_text(text: Column, size: int = 1000) -> Column:
    """The text without blank lines and lines that start with ``!`` or ``<``, truncated."""
    kept = F.filter(F.transform(lines(text), lambda p: strip(p)), lambda x: (x != "") & ~x.startswith("!") & ~x.startswith("<"))
    return truncate(F.array_join(kept, " "), size)


def named_section(text: Column, name: str, size: int = 1400) -> Column:
    """The body of the section whose heading is ``name``, up to the next ``#`` line, truncated; empty if there is none."""
    rows = lines(text)
    start = F.array_position(F.transform(rows, lambda x: F.lower(strip(F.trim(strip(x), F.lit("#"))))), name.lower())
    body = F.slice(rows, start.cast("int") + 1, F.greatest(F.size(rows), F.lit(1)))
    taken = F.aggregate(
        body,
        F.struct(F.array().cast("array<string>").alias("rows"), F.lit(False).alias("over")),
        lambda s, x: F.when(s["over"] | (x.startswith("#") & (F.size(s["rows"]) > 0)), F.struct(s["rows"].alias("rows"), F.lit(True).alias("over")))
        .otherwise(F.struct(F.when(strip(x) == "", s["rows"]).otherwise(F.array_append(s["rows"], strip(x))).alias("rows"), F.lit(False).alias("over"))),
        lambda s: F.array_join(s["rows"], " "),
    )
    return F.when(start > 0, truncate(taken, size)).otherwise("")


def summary_key(column: Column) -> Column:
    """A summary's heading without marks, punctuation and case."""
    text = F.regexp_replace(column, rf"(?:[#`*_~>]|{SPACE})+", "")
    return F.lower(F.regexp_replace(text, r"[：:，,。.!！?？（）()\[\]【】]+", ""))


def summary_section(text: Column, names: list[str], size: int = 1200) -> Column:
    """The body of the first heading with one of the names, up to a heading of its level or above, cut at the line that reaches ``size``; empty if there is none."""
    wanted = [n.lower() for n in names]
    start = F.struct(F.lit(0).alias("level"), F.array().cast("array<string>").alias("rows"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(s: Column, line: Column) -> Column:
        stripped = strip(line)
        level = F.length(F.regexp_extract(stripped, r"^(#{1,6})\s+\S", 1))
        title = F.regexp_extract(stripped, r"^#{1,6}\s+(.+?)\s*$", 1)
        opens = (s["level"] == 0) & (level > 0) & summary_key(title).isin(*wanted)
        ends = (s["level"] > 0) & (level > 0) & (level <= s["level"])

        def state(level: Column, rows: Column, size: Column, done: Column) -> Column:
            return F.struct(level.alias("level"), rows.alias("rows"), size.alias("size"), done.alias("done"))

        grown = s["size"] + F.length(line) + 1
        return (
            F.when(s["done"] | ((s["level"] == 0) & ~opens), s)
            .when(opens, state(level, s["rows"], s["size"], F.lit(False)))
            .when(ends, state(s["level"], s["rows"], s["size"], F.lit(True)))
            .otherwise(state(s["level"], F.array_append(s["rows"], line), grown, grown - 1 >= size))
        )

    return strip(F.aggregate(lines(text), start, step, lambda s: F.array_join(s["rows"], "\n")))


def info_field(text: Column, field: str, section: str = "基本信息") -> Column:
    """The value of a line ``field: value`` of a summary's section; empty if there is none."""
    rows = F.transform(lines(summary_section(text, [section], 1000)), lambda x: strip(F.regexp_replace(x, r"^[>\-*\s]+", "")))
    pattern = rf"^{re.escape(field)}\s*[:：]\s*(.+)$"
    found = F.filter(rows, lambda x: x.rlike(pattern))
    return F.when(F.size(found) > 0, intro_text(F.regexp_extract(found[0], pattern, 1))).otherwise("")


def rewrite_images(text: Column, paths: Column) -> Column:
    """Markdown images whose target is a key of the map ``paths`` get its value; addresses, fragments and other targets stay."""
    targets = F.array_distinct(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1)))
    known = F.filter(targets, lambda x: ~x.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://|#)") & paths[strip(x)].isNotNull())
    return F.aggregate(known, text, lambda t, x: F.replace(t, F.concat(F.lit("]("), x, F.lit(")")), F.concat(F.lit("]("), paths[strip(x)], F.lit(")"))))


def json_search(document: Column, keys: list[str]) -> Column:
    """The first filled value of one of the keys in a JSON document, depth first, an object's own keys before its children, as text; null if there is none.

    Shapes are unknown, so documents that hold a key's name go through Python.
    """

    def find(data: object) -> object:
        if isinstance(data, dict):
            for key in keys:
                if data.get(key) not in (None, ""):
                    return data[key]
        for child in data.values() if isinstance(data, dict) else data if isinstance(data, list) else ():
            if (found := find(child)) not in (None, ""):
                return found
        return None

    def one(text: str) -> str | None:
        try:
            value = find(json.loads(text))
        except ValueError:
            return None
        return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    @F.pandas_udf(T.StringType())
    def search(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    held = F.lit(False)
    for key in keys:
        held = held | document.contains(f'"{key}"')
    return search(F.when(held, document))


def bibliography_line(line: Column) -> Column:
    """struct(title, url) of a line ``+ title [Paper](url)``; null for other lines."""
    pattern = r"^\s*\+\s+(.+?)\s*\[Paper\]\(([^)]+)\)"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("title"), F.regexp_extract(line, pattern, 2).alias("url")))


def chat_content(response: Column) -> Column:
    """The answer of a chat service's JSON response in any of the known shapes; empty if there is none."""
    paths = ("$.content", "$.contentList[0].content", "$.choices[0].message.content", "$.choices[0].message.content[0].text", "$.choices[0].text", "$.data.content", "$.data")
    return first_filled(*[F.get_json_object(response, p) for p in paths])
