"""Problem 3: all similar pairs between set-valued records (Jaccard similarity).

Method: pigeonhole partitioning.  For each length l of the smaller set, the
token universe is cut into segments.  Two sets of sizes l <= s with similarity
at least t differ in at most H = floor((1-t)/(1+t)*(l+s)) tokens.  A segment may
be matched exactly (it catches 0 differences in it, and uses up 1 of the budget)
or up to one deletion (catches <= 1, uses up 2).  If the segments a probe picks
use up H+1 together, a similar set must match in one of them.  A probe picks its
segments by cost, so that segments of a single frequent token are avoided while
others suffice; a probe whose tokens fall in too few segments uses its H+1
rarest tokens, each a segment of its own.  Candidates are verified exactly.

What is shuffled for the key join is (key, id, size, sketch).  A sketch has one bit
for each hash value of a token modulo 64, so two sets can't differ in more bits
than tokens; that rejects most candidates and no similar pair.  Tokens are fetched
for the distinct pairs left.

A key that may be shared by more than ``HOT`` sets (no more than its rarest token
has) is split: a set is filed under one part of it by its id, a probe asks all parts.

Equal sets are one class first, so copies cost nothing and are never paired with
each other.  Nothing is broadcast but the table of frequent tokens: those that
make up at least 1/``HEAVY`` of all occurrences, hence at most ``HEAVY`` of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.session import cut_lineage, written

#: Bound of the broadcast table of frequent tokens.
HEAVY = 10_000
#: Sets under one part of a key, about.
HOT = 20_000


def segments_of(length: int, threshold: float) -> int:
    """Number of segments for sets whose smaller partner has ``length`` tokens."""
    return max(2, math.floor((1 - threshold) / threshold * length + 1e-9))


def _cut(tokens: list[int], m: int) -> dict[int, tuple[int, ...]]:
    parts: dict[int, list[int]] = {}
    for t in tokens:
        parts.setdefault((t >> 5) % m, []).append(t)
    return {i: tuple(p) for i, p in parts.items()}


def parts_of(tokens: tuple[int, ...], heavy: dict[int, int], hot: int = HOT) -> int:
    """Parts of a key that stands for sets with all of ``tokens`` (at least one)."""
    return 1 + min(heavy.get(t, 1) for t in tokens) // hot


def index_keys(tokens: list[int], threshold: float, heavy: dict[int, int] | None = None, place: int = 0, hot: int = HOT) -> set[int]:
    """Keys under which a set can be found by sets of its own size or larger; ``tokens`` sorted, ``place`` any number of the set's own."""
    n, heavy = len(tokens), heavy or {}
    keys = set()

    def file(kind: int, head: tuple[int, ...], part: tuple[int, ...]) -> None:
        keys.add(hash((kind, *head, *part, place % parts_of(part, heavy, hot))))

    for i, p in _cut(tokens, segments_of(n, threshold)).items():
        file(0, (n, i), p)
        if len(p) > 1:
            for j in range(len(p)):
                file(1, (n, i), p[:j] + p[j + 1 :])
    for t in tokens:
        file(2, (n,), (t,))
    return keys


def probe_keys(tokens: list[int], threshold: float, heavy: dict[int, int], hot: int = HOT) -> set[int]:
    """Keys with which a set finds every similar set of its own size or smaller; ``tokens`` sorted."""
    s = len(tokens)
    keys = set()

    def ask(kind: int, head: tuple[int, ...], part: tuple[int, ...]) -> None:
        keys.update(hash((kind, *head, *part, x)) for x in range(parts_of(part, heavy, hot)))

    for n in range(math.ceil(threshold * s - 1e-9), s + 1):
        need = math.floor((1 - threshold) / (1 + threshold) * (n + s) + 1e-9) + 1
        steps = []
        for i, p in _cut(tokens, segments_of(n, threshold)).items():
            often = sorted(heavy.get(t, 1) for t in p)
            if len(p) == 1:
                steps.append((often[0], 0, i, p))
            else:
                exact = often[0] / 50 if len(p) == 2 else often[0] / 2000
                steps.append((exact, 0, i, p))
                steps.append((max(exact, often[0] + often[1] if len(p) == 2 else often[0] / 20), 1, i, p))
        if len(steps) < need:
            for t in sorted(tokens, key=lambda t: heavy.get(t, 1))[:need]:
                ask(2, (n,), (t,))
            continue
        steps.sort(key=lambda x: (x[0], x[1]))
        for _, kind, i, p in steps[:need]:
            if kind == 0:
                ask(0, (n, i), p)
            else:
                ask(1, (n, i), p)
                for j in range(len(p)):
                    ask(0, (n, i), p[:j] + p[j + 1 :])
    return keys


def _keys(make: Callable[[list[int], int], set[int]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [list(make(t.tolist(), i)) for t, i in zip(batch["tokens"], batch["id"], strict=True)]
            out = batch.drop(columns="tokens").assign(key=made).explode("key")
            yield out.assign(key=out["key"].astype("int64"))

    return run


def set_classes(sets: DataFrame, key: str, items: str, least: int) -> DataFrame:
    """(key, cls, tokens) with the record's key as ``key``: the distinct items as sorted 64-bit hashes; sets with fewer than ``least`` items are left out."""
    tokens = F.array_sort(F.array_distinct(F.transform(F.filter(F.col(f"`{items}`"), lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))
    # The generator keeps what is below it from being evaluated once for each use of the tokens.
    once = sets.select(F.col(f"`{key}`").alias("key"), F.explode(F.array(tokens)).alias("tokens"))
    digest = F.sha1(F.array_join(F.transform("tokens", lambda t: t.cast("string")), ","))
    return once.where(F.size("tokens") >= least).select("key", digest.alias("cls"), "tokens")


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(cls_a, cls_b, similarity) for all unordered pairs of distinct sets at or above ``threshold``; ``classes`` is (cls, tokens)."""
    spark = classes.sparkSession
    sketch = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))))
    held = written(classes.select(F.xxhash64("cls").alias("id"), "cls", F.size("tokens").alias("n"), sketch.alias("sketch"), "tokens"))
    counts = cut_lineage(held.select(F.explode("tokens").alias("token")).groupBy("token").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    frequent = counts.where((F.col("count") > 1) & (F.col("count") * HEAVY >= total)).collect()
    heavy = spark.sparkContext.broadcast({r["token"]: r["count"] for r in frequent})
    rows = held.select("id", "n", "sketch", "tokens")
    schema, hot = "id long, n int, sketch long, key long", HOT
    index = rows.mapInPandas(_keys(lambda t, i: index_keys(t, threshold, heavy.value, i, hot)), schema)
    probe = rows.mapInPandas(_keys(lambda t, i: probe_keys(t, threshold, heavy.value, hot)), schema)
    other = index.select("key", F.col("id").alias("__id"), F.col("n").alias("__n"), F.col("sketch").alias("__sketch"))
    differ = F.floor((F.col("n") + F.col("__n")) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    pairs = cut_lineage(
        probe.join(other, "key")
        .where((F.col("id") != F.col("__id")) & (F.col("__n") <= F.col("n")) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("__sketch"))) <= differ))
        .select(F.least("id", "__id").alias("x"), F.greatest("id", "__id").alias("y"))
        .distinct()
    )
    a = held.select(F.col("id").alias("x"), F.col("cls").alias("__a"), F.col("tokens").alias("__ta"))
    b = held.select(F.col("id").alias("y"), F.col("cls").alias("__b"), F.col("tokens").alias("__tb"))
    shared = F.size(F.array_intersect("__ta", "__tb"))
    return (
        pairs.join(a, "x")
        .join(b, "y")
        .withColumn("similarity", shared / (F.size("__ta") + F.size("__tb") - shared))
        .where(F.col("similarity") >= threshold)
        .select(F.least("__a", "__b").alias("cls_a"), F.greatest("__a", "__b").alias("cls_b"), "similarity")
        .distinct()
    )


def similar_sets(sets: DataFrame, key: str, items: str, threshold: float = 0.6, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members, links): (key, cls), and the similar pairs of classes (cls_a, cls_b, similarity).

    ``sets`` has one row per record; repeated rows count once, and a key with
    several sets is a member of several classes.  Null and empty sets, sets below
    ``least`` and null items are left out; items that a record repeats count once.
    """
    rows = written(set_classes(sets, key, items, least))
    classes = rows.groupBy("cls").agg(F.first("tokens").alias("tokens"))  # equal for equal classes
    return rows.select(F.col("key").alias(key), "cls").distinct(), similar_classes(classes, threshold)
