"""Facets, report views and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.functions.text import first_filled, squeeze


def tag_counts(reports: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, n): in how many places each tag stands; nulls and empty arrays count nothing."""
    # As an expression the array is evaluated once; of a column Spark would also filter its size below.
    held = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    return reports.select(F.explode(held).alias("tag")).where("tag is not null and tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def facet_values(reports: DataFrame, column: str, order: str) -> DataFrame:
    """(value, first_seen): distinct non-empty values with the first place they occur at."""
    text = F.col(column).cast("string")
    return reports.where(text.isNotNull() & (text != "")).groupBy(text.alias("value")).agg(F.min(order).alias("first_seen"))


def report_order(kind: str) -> list[Column]:
    """Sort columns of a report list: recent, title or venue; names by the Unicode collation, ties by identifier."""
    year = F.coalesce(F.col("year"), F.lit(0)).desc()
    title, venue = F.collate("title", "UNICODE"), F.collate("venue", "UNICODE")
    orders = {"recent": [year, venue, title], "title": [title], "venue": [venue, year, title]}
    return [*orders[kind], F.col("id")]


def report_view(reports: DataFrame, order: str = "pos") -> DataFrame:
    """Reports with defaults: titles for each other, else the id; the id from the slug's tail, else ``paper-`` and the row's place; a numeric year or null.

    Fixed values: Uncategorized, Unknown and unknown stand for missing categories, types, venues and modalities.
    """
    slug_tail = F.regexp_extract(F.coalesce(F.col("slug"), F.lit("")), r"([^/]*)$", 1)
    ident = first_filled(F.col("id"), slug_tail, F.concat(F.lit("paper-"), (F.col(order) + 1).cast("string")))
    year = F.col("year").try_cast("int")
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda x: squeeze(x)), lambda x: x != "")
    return reports.select(
        ident.alias("id"),
        first_filled(F.col("title"), F.col("fullTitle"), ident).alias("title"),
        first_filled(F.col("fullTitle"), F.col("title"), ident).alias("fullTitle"),
        F.nullif(year, F.lit(0)).alias("year"),
        first_filled(F.col("category"), F.lit("Uncategorized")).alias("category"),
        first_filled(F.col("type"), F.lit("Unknown")).alias("type"),
        first_filled(F.col("modality"), F.lit("unknown")).alias("modality"),
        tags.alias("tags"),
        first_filled(F.col("introduction")).alias("introduction"),
        first_filled(F.col("venue"), F.lit("Unknown")).alias("venue"),
    )


def top_rows(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows: TakeOrdered, no full sort."""
    return df.orderBy(*order).limit(k)
