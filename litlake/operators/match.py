"""Keyword filters with provenance, type normalisation and faceted search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.functions.text import strip

#: Columns searched when none are named, as far as the table has them.
DEFAULT_COLUMNS = ("title", "abstract", "keywords")


def searched_text(df: DataFrame, columns: list[str], null_text: str = "") -> Column:
    """The columns joined by line feeds; ``null_text='nan'`` gives nulls the text that a string cast of a missing cell has."""
    return F.concat_ws("\n", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_text)) for c in columns])


def hits(text: Column, keywords: list[str], regex: bool = False, case_sensitive: bool = False) -> Column:
    """The keywords found in ``text``, in the order given."""

    def found(keyword: str) -> Column:
        if regex:
            return text.rlike(keyword if case_sensitive else f"(?iu){keyword}")
        return text.contains(keyword) if case_sensitive else F.lower(text).contains(keyword.lower())

    return F.array_compact(F.array(*[F.when(found(k), F.lit(k)) for k in keywords]))


def filter_papers(
    df: DataFrame,
    keywords: list[str],
    columns: list[str] | None = None,
    match_all: bool = False,
    regex: bool = False,
    case_sensitive: bool = False,
    allowed_types: list[str] | None = None,
    type_column: str = "type",
    null_text: str = "",
) -> DataFrame:
    """Rows in which any keyword (``match_all``: every one) occurs, with ``matched_keywords``.

    Keywords are substrings or regular expressions.  An existing column
    ``matched_keywords`` is replaced.  ``allowed_types=[]`` keeps nothing, None
    everything.  Missing columns and an empty keyword list are errors.  The cheap
    type filter stands before the text match.
    """
    if not keywords:
        raise ValueError("no keywords")
    columns = columns or [c for c in DEFAULT_COLUMNS if c in df.columns]
    missing = [c for c in [*columns, *([type_column] if allowed_types is not None else [])] if c not in df.columns]
    if missing or not columns:
        raise KeyError(f"missing columns: {missing or list(DEFAULT_COLUMNS)}")
    if allowed_types is not None:
        kept = {t.strip().lower() for t in allowed_types}
        kind = F.lower(strip(F.coalesce(F.col(f"`{type_column}`").cast("string"), F.lit("nan"))))
        df = df.where(kind.isin(*kept) if kept else F.lit(False))
    found = df.withColumn("__hits", hits(searched_text(df, columns, null_text), keywords, regex, case_sensitive))
    enough = F.size("__hits") == len(keywords) if match_all else F.size("__hits") > 0
    return found.where(enough).withColumn("matched_keywords", F.array_join("__hits", ", ")).drop("__hits")


def title_filter(df: DataFrame, keyword: str, allowed_types: list[str] | None = None, source: str = "source_file") -> DataFrame:
    """Rows whose title matches a regular expression, without regard to case; the source column stands first.

    A null title has the text ``nan``.  Without a type column a type filter keeps nothing.
    """
    out = df.where(F.coalesce(F.col("title").cast("string"), F.lit("nan")).rlike(f"(?iu){keyword}"))
    if allowed_types is not None:
        kept = [t.strip().lower() for t in allowed_types]
        out = out.where(F.lower(F.col("type")).isin(*kept) if "type" in df.columns and kept else F.lit(False))
    return out.select(source, *[c for c in df.columns if c != source]) if source in df.columns else out


def pattern_provenance(title: Column, patterns: list[str]) -> Column:
    """The case-sensitive patterns that match, joined by ``", "``; nothing is filtered."""
    for p in patterns:
        re.compile(p)
    return F.array_join(F.array_compact(F.array(*[F.when(title.rlike(p), F.lit(p)) for p in patterns])), ", ")


def submission_type(value: Column) -> Column:
    """oral, spotlight or poster, the first that occurs in the value; else the value in lower case; ``unknown`` for blank."""
    text = F.lower(F.coalesce(value, F.lit("")))
    out = F.when(strip(text) == "", "unknown").otherwise(text)
    for kind in ("poster", "spotlight", "oral"):
        out = F.when(text.contains(kind), kind).otherwise(out)
    return out


def faceted_search(
    reports: DataFrame, query: str = "", venue: str = "all", year: str = "all", modality: str = "all", tag: str = "all"
) -> DataFrame:
    """Reports (title, fullTitle, introduction, venue, year, modality, tags array) that hold the query and have the facets; ``all`` switches one off."""
    text = F.lower(F.concat_ws(" ", "title", "fullTitle", "introduction", "venue", "modality", F.array_join("tags", " ")))
    out = reports
    if query.strip():
        out = out.where(text.contains(query.strip().lower()))
    for column, wanted in (("venue", venue), ("year", year), ("modality", modality)):
        if wanted != "all":
            out = out.where(F.col(column).cast("string") == str(wanted))
    return out if tag == "all" else out.where(F.array_contains("tags", tag))
