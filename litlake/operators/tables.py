"""Deduplication, ordered groups, upserts, reconciliation, merges, unions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlake.functions.text import base_name, is_blank
from litlake.session import written

# Status columns and their defaults.
STATUS_DEFAULTS = {
    "download_status": "pending",
    "pdf_path": "",
    "parse_status": "pending",
    "parsed_dir": "",
    "report_status": "pending",
    "report_path": "",
}


def ensure_columns(df: DataFrame, defaults: dict[str, str] = STATUS_DEFAULTS) -> DataFrame:
    """Each missing column with its default; existing ones untouched."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each combination of keys, nulls equal; ties are settled by the whole row.

    A grouped minimum with map-side combine, so a key that holds a third of all
    rows is combined before the shuffle, where a window would sort it in one task.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    comparable = F.struct(F.col(f"`{order}`"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    picked = df.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, comparable).alias("__row"))
    return picked.select("__row.*")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with the place of each row from 1 in the order of all rows; ``order`` should be unique.

    The rows are range-partitioned and numbered within their partitions; only the
    partitions' sizes, one row each, are added up in one place.
    """
    parts = written(df.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__within", within).join(F.broadcast(starts), "__part").withColumn(out, F.col("__before") + F.col("__within")).select(*df.columns, out)


def first_seen_order(df: DataFrame, key: str, order: str, place: str = "group_order") -> DataFrame:
    """Each row with the place of its group among the groups in order of first appearance, from 1.

    The groups' first places are aggregated, numbered and joined back.
    """
    firsts = df.groupBy(F.col(f"`{key}`").alias("__g")).agg(F.min(order).alias("__first"))
    ranked = numbered(firsts, ["__first", "__g"], place)
    return df.join(ranked, df[key].eqNullSafe(ranked["__g"]), "left").drop("__g", "__first")


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows; missing columns are null."""
    if not frames:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert_by_file(status: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """``status`` with ``columns`` taken from ``updates`` where the base names of ``pdf_path`` are equal.

    All rows of a name are updated; of several updates of a name the last by
    (columns) wins; null values leave the old ones; rows without a path stay.
    """
    latest = updates.where(~is_blank(F.col("pdf_path"))).groupBy(base_name(F.col("pdf_path")).alias("__name"))
    latest = latest.agg(F.max(F.struct(*columns)).alias("__new"))
    named = status.withColumn("__name", F.when(~is_blank(F.col("pdf_path")), base_name(F.col("pdf_path"))))
    joined = named.join(latest, "__name", "left")
    return joined.withColumns({c: F.coalesce(F.col("__new").getField(c), F.col(c)) for c in columns}).select(*status.columns)


def first_status_row(names: DataFrame, status: DataFrame, order: str) -> DataFrame:
    """``names`` (file) with the first row of ``status`` whose path has that base name; blank values become null."""
    filled = status.where(~is_blank(F.col("pdf_path"))).withColumn("__name", base_name(F.col("pdf_path")))
    first = keep_first(filled, ["__name"], order)
    kinds = dict(status.dtypes)
    values = [F.when(~is_blank(F.col(c)), F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in status.columns]
    return names.join(first.select("__name", *values), names["file"] == F.col("__name"), "left").drop("__name")


def reconcile_files(papers: DataFrame, expected: Column, files: DataFrame) -> DataFrame:
    """``pdf_path`` is the expected name; ``download_status`` says whether ``files`` (path) has it, whatever it said before."""
    there = files.select(base_name(F.col("path")).alias("__found_file")).distinct()
    named = papers.drop("pdf_path", "download_status").withColumn("pdf_path", expected)
    joined = named.join(there, named["pdf_path"] == there["__found_file"], "left")
    return joined.withColumn("download_status", F.when(F.col("__found_file").isNotNull(), "downloaded").otherwise("missing")).drop("__found_file")


def without_artefacts(items: DataFrame, artefacts: DataFrame, key: str) -> DataFrame:
    """Items that have no artefact yet."""
    return items.join(artefacts.select(key).distinct(), key, "left_anti")


def merge_metadata(generated: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Full outer merge; a value that exists wins, an empty string too."""
    columns = [c for c in generated.columns if c != key]
    old = existing.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns if c in existing.columns])
    joined = generated.join(old, generated[key] == old["__key"], "full")
    return joined.select(
        F.coalesce(key, "__key").alias(key), *[F.coalesce(f"__{c}", c).alias(c) if c in existing.columns else F.col(c) for c in columns]
    )


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``after`` that are new or differ from ``before`` in one of the columns."""
    old = before.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    return after.join(old, after[key] == old["__key"], "left").where(F.col("__key").isNull() | ~same).select(*after.columns)


def resolve_assets(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``refs`` (doc, ref) with the path of the file: the equal relative path, else the first of equal base name in the document's folder.

    ``files`` is (doc, path).
    """
    exact = files.select("doc", F.col("path").alias("ref"), F.col("path").alias("__exact")).distinct()
    named = files.groupBy("doc", base_name(F.col("path")).alias("__name")).agg(F.min("path").alias("__first"))
    out = refs.withColumn("__name", base_name(F.col("ref"))).join(exact, ["doc", "ref"], "left").join(named, ["doc", "__name"], "left")
    return out.withColumn("path", F.coalesce("__exact", "__first")).drop("__exact", "__first", "__name")


def first_artefact(items: DataFrame, names: list[str], files: DataFrame, out: str = "artefact") -> DataFrame:
    """``items`` with the first of the columns ``names`` whose value is the path of a file of ``files`` (path); null if none is."""
    there = files.select(F.col("path").alias("__path")).distinct()
    joined, found = items, []
    for i, name in enumerate(names):
        joined = joined.join(there.withColumnRenamed("__path", f"__path{i}"), F.col(f"`{name}`") == F.col(f"__path{i}"), "left")
        found.append(F.col(f"__path{i}"))
    return joined.select(*[F.col(f"`{c}`") for c in items.columns], F.coalesce(*found).alias(out))


def assign_ids(df: DataFrame, key: str, order: str, group: str) -> DataFrame:
    """Within each group, in order: an id that is a positive whole number not used before is kept; others get the smallest unused from a moving counter.

    Each id depends on all before it, so a group is one task: meant for groups
    such as one source page.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {'long' if c == key else kinds[c]}" for c in df.columns)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        used: set[int] = set()
        counter, out = 1, []
        for value in rows[key]:
            try:
                number = int(value)
                valid = number > 0 and float(value) == number and number not in used
            except (TypeError, ValueError):
                valid = False
            if not valid:
                while counter in used:
                    counter += 1
                number = counter
            used.add(number)
            out.append(number)
        return rows.assign(**{key: out})

    return df.groupBy(group).applyInPandas(run, schema)


def unique_names(df: DataFrame, name: str, order: str, group: str, out: str = "unique_name") -> DataFrame:
    """Within each group: a slug of the stem with the lower-cased suffix; collisions get -2, -3 ... in order.

    Names that collide with a numbered name are numbered on, so a group is one task: meant for the images of one report.
    """
    import re

    schema = ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes), f"`{out}` string"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        used: set[str] = set()
        names = []
        for value in rows[name]:
            stem, dot, suffix = (value or "").rpartition(".")
            stem, suffix = (stem, dot + suffix.lower()) if dot else (value or "", "")
            base = re.sub("[^A-Za-z0-9]+", "-", stem.strip().lower()).strip("-")[:80].strip("-") or "image"
            candidate, n = base + suffix, 1
            while candidate in used:
                n += 1
                candidate = f"{base}-{n}{suffix}"
            used.add(candidate)
            names.append(candidate)
        return rows.assign(**{out: names})

    return df.groupBy(group).applyInPandas(run, schema)
