"""Classes of equal records, pairs between them, and connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.session import checkpoint_folder, cut_lineage


def first_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per non-null ``key``: the columns of its first row by ``order`` (map-side combined, so a hot key is no hot task)."""
    picked = F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.col(f"`{order}`"))
    return (
        df.where(F.col(f"`{key}`").isNotNull())
        .groupBy(F.col(f"`{key}`").alias(key))
        .agg(picked.alias("__row"))
        .select(key, *[F.col(f"__row.`{c}`").alias(c) for c in columns])
    )


def expand_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """All pairs of ``key`` (a < b) that share a class or whose classes are linked.

    ``members`` is (key, cls); ``links`` is (cls_a, cls_b), each unordered pair once.
    """
    a = members.select(F.col("cls").alias("cls_a"), F.col(key).alias("__a"))
    b = members.select(F.col("cls").alias("cls_b"), F.col(key).alias("__b"))
    across = links.join(a, "cls_a").join(b, "cls_b").select("__a", "__b")
    within = a.join(b, F.col("cls_a") == F.col("cls_b")).where("__a < __b").select("__a", "__b")
    return across.unionByName(within).select(
        F.least("__a", "__b").alias(f"{key}_a"), F.greatest("__a", "__b").alias(f"{key}_b")
    )


def connected_groups(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, grp) with grp the smallest node of the node's component.

    ``nodes`` is (node), ``edges`` (a, b) without self-loops.  Alternating
    large-star and small-star rounds: their number grows with the logarithm of
    the longest chain, each round is a shuffle of the edges, and lineage is cut
    by checkpoint() in the shared folder.  Only a checksum of the edges reaches
    the driver.  A star's centre is found by a grouped minimum with map-side
    combine; nothing is collected per group.
    """
    checkpoint_folder(nodes.sparkSession)
    current = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    mark = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        current = cut_lineage(small.where("u <> v").distinct())
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = current.groupBy("u").agg(F.min("v").alias("grp"))
    return nodes.join(labels, nodes["node"] == labels["u"], "left").select("node", F.coalesce("grp", "node").alias("grp"))
