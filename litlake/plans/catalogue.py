"""All queries outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litlake.operators import match, tables
from litlake.plans import documents, packed, papers, storage, texts
from litlake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**papers.QUERIES, **documents.QUERIES, **texts.QUERIES, **storage.QUERIES, **packed.QUERIES}
ORACLES: dict[str, str] = {**papers.ORACLES, **documents.ORACLES, **texts.ORACLES, **storage.ORACLES, **packed.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that speak of emotion or speech, with what matched and their status columns."""
    kept = match.filter_papers(table(spark, sf_dir, "all_papers"), ["emotion", "speech"])
    return tables.ensure_columns(kept.select("pos", "paper_id", "title", "matched_keywords"))
