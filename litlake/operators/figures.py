"""Figure labels in running text, captions for pages and the ranking of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlake.functions.text import lines, strip

# What starts a label, and what ends a caption.
LABEL = r"(?i)^((?:fig(?:ure)?\.?|table)\s*\d+)"
STOP = r"(?i)^(?:fig(?:ure)?\.?|table|abstract|introduction|conclusion)"


def figure_labels(docs: DataFrame, key: str, text: str, following: int = 5, size: int = 600) -> DataFrame:
    """(key, label, line_no, caption): the last line of each label, joined with up to ``following`` lines before one that stops a caption.

    Lines are the non-blank ones, numbered from 0; null texts have none.
    """
    kept = F.filter(F.transform(lines(F.col(text)), lambda x: strip(x)), lambda x: x != "")
    rows = docs.select(key, F.posexplode(kept).alias("line_no", "line"))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(1, following)
    near = rows.withColumn("__next", F.collect_list("line").over(order)).where(F.col("line").rlike(LABEL))
    stop = F.array_position(F.transform("__next", lambda x: x.rlike(STOP)), True)
    more = F.when(stop > 0, F.slice("__next", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("__next"))
    caption = F.substring(F.concat_ws(" ", F.col("line"), F.nullif(F.array_join(more, " "), F.lit(""))), 1, size)
    found = near.select(key, F.lower(F.regexp_extract("line", LABEL, 1)).alias("label"), "line_no", caption.alias("caption"))
    return found.groupBy(key, "label").agg(F.max("line_no").alias("line_no"), F.max_by("caption", "line_no").alias("caption"))


def page_captions(pages: DataFrame, labels: DataFrame, key: str, per_page: int = 40) -> DataFrame:
    """``pages`` (key, page from 0) with the nearest label: lines from the page's start to 50 after its end, nearest to its middle, the first of equals.

    Labels meet pages by an equi-join: a label's line belongs to at most three pages.
    """
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col("line_no") - per_page - 50) / F.lit(per_page)).cast("int")), F.floor(F.col("line_no") / F.lit(per_page)).cast("int"))
    spread = labels.withColumn("page", F.explode(reach))
    start = F.col("page") * per_page
    spread = spread.where((F.col("line_no") >= start) & (F.col("line_no") < start + per_page + 50))
    distance = F.abs(F.col("line_no") - (start + per_page // 2))
    best = spread.groupBy(key, "page").agg(F.min_by(F.struct("label", "caption"), F.struct(distance, "line_no")).alias("b"))
    return pages.join(best, [key, "page"], "left").select(*pages.columns, "b.label", "b.caption")


def figure_score(width: Column, height: Column, caption: Column, page: Column) -> Column:
    """Area in units of 100,000 up to 10, 8 for a caption, 1 less on the first page."""
    area = F.least(width * height / F.lit(1e5), F.lit(10.0))
    return area + F.when(F.coalesce(caption, F.lit("")) != "", 8.0).otherwise(0.0) - F.when(page <= 1, 1.0).otherwise(0.0)
