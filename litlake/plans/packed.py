"""Queries of problem 2: several values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlake.operators.packed import explode_packed
from litlake.sources.tables import table

#: (table, packed column)
PACKED = (("all_papers", "keywords"), ("filtered_papers", "matched_keywords"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase of both packed fields with its place; rows that a table repeats count once."""
    parts = [
        explode_packed(table(spark, sf_dir, name), column, ["pos"]).select(F.lit(column).alias("field"), "pos", "ord", "item")
        for name, column in PACKED
    ]
    # pos is unique in all_papers; filtered_papers repeats rows with a later updated_at, which distinct() merges.
    return parts[0].unionByName(parts[1].distinct())




def items_sql(table_name: str, column: str, key: str) -> str:
    """DuckDB SQL for (key, ord, item) of a packed column: JSON and quoted lists by their own grammar, all others by one scan."""
    label = r"^\s*(?:key\s*-?\s*words?|index\s+terms|关键词|关键字)\s*(?:[:：—–]|-\s)\s*"
    scan = r'\s*"(?:[^"]|"")*"|\s*“[^”]*”|[^,，;；|、\n\t]+'
    return rf"""SELECT {key}, CAST(u[1] AS INTEGER) AS ord, u[2] AS item FROM (
 SELECT {key}, unnest(list_zip(range(1, len(l) + 1), l)) AS u FROM (
  SELECT {key}, list_filter(list_transform(raw, lambda x: trim(regexp_replace(lower(nfc_normalize(replace(regexp_replace(trim(replace(x, chr(160), ' '), ' ' || chr(9) || chr(10)), '^["“”'']|["“”'']$', '', 'g'), '""', '"'))), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM (
   SELECT {key}, CASE WHEN starts_with(f, '["') AND json_valid(f) THEN list_transform(from_json(f, '["VARCHAR"]'), lambda x: chr(34) || x || chr(34))
    WHEN regexp_matches(f, '^\[[''"]') THEN regexp_extract_all(f, '''[^'']*''|"[^"]*"')
    ELSE regexp_extract_all(replace(replace(regexp_replace(regexp_replace(f, '^\[|\]$', '', 'g'), '(^|\n)[ \t]*[-•][ \t]+', '\1', 'g'), ' / ', chr(10)), ' · ', chr(10)), '{scan}') END AS raw
   FROM (SELECT {key}, regexp_replace(trim(regexp_replace(replace({column}, chr(160), ' '), '(?i){label}', '')), '[\s.。]+$', '') AS f FROM {table_name} WHERE {column} IS NOT NULL))))"""


QUERIES = {"p2_found": p2_found}
ORACLES = {
    "p2_found": f"SELECT 'keywords' AS field, pos, ord, item FROM ({items_sql('all_papers', 'keywords', 'pos')}) UNION "
    f"SELECT 'matched_keywords', pos, ord, item FROM ({items_sql('filtered_papers', 'matched_keywords', 'pos')})"
}
