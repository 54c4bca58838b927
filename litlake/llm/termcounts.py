"""Problem 4: frequency of every distinct term.

Method: last-seen counters.  Records are hash-partitioned and sorted by their
identifier; a task walks through its terms in that order and keeps for each term
the occurrences, the records and the last record seen, so no record needs a set
of its own.  As no record is in two tasks, the tasks' counters simply add up:
what is shuffled by term is already aggregated, and a term that stands in a
third of all records sends one row per task.  Tables of counters are given out
and emptied, between two records, when they reach ``FLUSH`` terms.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms that a task holds before it gives its counters out.
FLUSH = 500_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits of the lower-cased NFKC form, in order."""
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower())


def _last_seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counters: dict[tuple[str, str], list] = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame(
            [(f, t, n, r) for (f, t), (n, r, _) in counters.items()], columns=["field", "term", "occurrences", "records"]
        )

    for batch in batches:
        for record, field, terms in zip(batch["record"], batch["field"], batch["terms"], strict=True):
            for term in terms:
                held = counters.get((field, term))
                if held is None:
                    counters[field, term] = [1, 1, record]
                else:
                    held[0] += 1
                    if held[2] != record:
                        held[1] += 1
                        held[2] = record
            if len(counters) >= FLUSH:
                # The next row may belong to the same record only under another field, which shares no counter.
                yield out()
                counters.clear()
    if counters:
        yield out()


def term_counts(terms: DataFrame, partitioned: bool = False) -> DataFrame:
    """(field, term, occurrences, records) of ``terms``: (record, field, terms array), one row per record and field.

    Null records, null or empty arrays and null terms count nothing; a term that
    a record repeats counts each time as an occurrence and once as a record.
    ``partitioned``: all rows of a record are in one partition already, as after an
    aggregation by record, so they needn't be shuffled again.
    """
    ready = (
        terms.where(F.col("record").isNotNull() & (F.size("terms") > 0))
        .select("record", "field", F.filter("terms", lambda t: t.isNotNull()).alias("terms"))
    )
    ready = (ready if partitioned else ready.repartition("record")).sortWithinPartitions("record", "field")
    counted = ready.mapInPandas(_last_seen, "field string, term string, occurrences long, records long")
    return counted.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, records: int, common_share: float = 0.02, rare_records: int = 1) -> DataFrame:
    """``counts`` with ``mark``: 'rare' for terms of at most ``rare_records`` records, else 'common' from ``common_share`` of ``records``, else null."""
    return counts.withColumn(
        "mark",
        F.when(F.col("records") <= rare_records, "rare").when(F.col("records") >= common_share * records, "common"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_of(texts: pd.Series) -> pd.Series:
    return texts.map(words)
