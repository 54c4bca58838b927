"""Problem 8: mixing sources to target weights.

Method: capped water-filling.  A source can supply at most its tokens times its
maximal repeats.  Sources whose share would exceed that are clamped, and what
they leave is redistributed over the others in proportion to their weights until
no further source has to be clamped.  A source's tokens times its whole epochs
are drawn from every text; the fraction is drawn in the order of a seeded hash.

A text counts once however many identifiers it has: its lowest identifier in a
listed source stands for it, so no text is drawn more often than its source
allows.  The fraction's border is found from token sums per (source, hash
bucket): texts in the buckets before the border's are drawn, those behind it
not, and only those inside it are ordered, so a source that holds a third of all
texts is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litlake.session import cut_lineage, written

#: Hash buckets per source.
BUCKETS = 4096


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Amounts that sum to ``total`` or to all caps, proportional to ``weights`` but for clamped sources."""
    amounts = {s: 0.0 for s in weights}
    free = {s for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0}
    left = float(total)
    while free and left > 0:
        scale = left / sum(weights[s] for s in free)
        clamped = {s for s in free if weights[s] * scale >= caps[s]}
        if not clamped:
            for s in free:
                amounts[s] = weights[s] * scale
            break
        for s in clamped:
            amounts[s] = float(caps[s])
            left -= caps[s]
        free -= clamped
    return amounts


def mix_sources(
    texts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11
) -> tuple[DataFrame, DataFrame]:
    """(draws, shares) for ``texts`` (doc_id, source, text_key, n_tokens) and ``targets`` (source, target_share, max_repeats).

    draws: source, doc_id, n_tokens, repeats (at least 1).  shares: one row per
    target with the tokens available and drawn, the epochs, whether the source
    was clamped (sources without texts aren't), the share reached and, as
    ``unclamped_total``, the largest total at which no source with texts is
    clamped.  ``total_tokens`` defaults to the tokens
    available in the listed sources.  Texts without a listed source, null or
    empty ones are not drawn; a target without texts reaches share 0.  The
    targets, one row per source, are the only table that reaches the driver.
    """
    goals = {r["source"]: r for r in targets.groupBy("source").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("r")).where("source is not null").collect()}
    spark = texts.sparkSession
    listed = texts.where(F.col("source").isin(list(goals)) & (F.col("n_tokens") > 0))
    once = written(
        listed.groupBy("text_key")
        .agg(F.min_by(F.struct("source", "doc_id", "n_tokens"), "doc_id").alias("t"))
        .select("text_key", "t.*")
        .withColumn("__order", F.xxhash64(F.lit(seed), F.col("text_key")))
        .withColumn("__bucket", F.shiftrightunsigned("__order", 52).cast("int"))
    )
    buckets = cut_lineage(once.groupBy("source", "__bucket").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts")))
    held = {r["source"]: r for r in buckets.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).collect()}
    have = {s: held[s]["tokens"] if s in held else 0 for s in goals}
    caps = {s: have[s] * max(0, goals[s]["r"] or 0) for s in goals}
    weights = {s: goals[s]["w"] or 0.0 for s in goals}
    wanted = water_fill(weights, caps, sum(have.values()) if total_tokens is None else total_tokens)
    open_ = {s for s in goals if weights[s] > 0 and caps[s] > 0}
    unclamped = int(min((caps[s] * sum(weights[x] for x in open_) / weights[s] for s in open_), default=0))
    plan = []
    for s in goals:
        epochs = wanted[s] / have[s] if have[s] else 0.0
        whole = int(epochs + 1e-9)
        plan.append((s, whole, max(0.0, wanted[s] - whole * have[s]) if have[s] else 0.0, epochs, bool(have[s] and caps[s] <= wanted[s] + 1e-6)))
    plan_df = spark.createDataFrame(plan, "source string, whole int, rest double, epochs double, clamped boolean")
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "__bucket", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("__start"))
    border = (
        starts.join(F.broadcast(plan_df.select("source", "rest")), "source")
        .where(F.col("__start") + F.col("tokens") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct(F.col("__bucket").alias("border"), F.col("__start").alias("start"))).alias("b"))
        .select("source", "b.*")
    )
    goal = plan_df.select("source", "whole", "rest").join(border, "source", "left")  # one row per source
    sided = once.join(F.broadcast(goal), "source")
    inside = Window.partitionBy("source").orderBy("__order", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("__bucket") == F.col("border")
    ordered = sided.where(at).withColumn("__in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    drawn_there = F.col("start") + F.col("__in") + F.col("n_tokens") / 2 <= F.col("rest")
    columns = ["source", "doc_id", "n_tokens"]
    draws = (
        sided.where(~F.coalesce(at, F.lit(False)))
        .select(*columns, (F.col("whole") + F.coalesce(F.col("__bucket") < F.col("border"), F.lit(True)).cast("int")).alias("repeats"))
        .unionByName(ordered.select(*columns, (F.col("whole") + drawn_there.cast("int")).alias("repeats")))
        .where("repeats > 0")
    )
    drawn = draws.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("drawn_tokens"), F.max("repeats").alias("most_repeats"))
    facts = spark.createDataFrame(
        [(s, float(weights[s]), goals[s]["r"], have[s], held[s]["texts"] if s in held else 0, unclamped) for s in goals],
        "source string, target_share double, max_repeats int, available_tokens long, texts long, unclamped_total long",
    )
    shares = (
        facts.join(plan_df.select("source", "epochs", "clamped"), "source")
        .join(drawn, "source", "left")
        .fillna(0, ["drawn_tokens", "most_repeats"])
        .withColumn("share_reached", F.col("drawn_tokens") / F.greatest(F.sum("drawn_tokens").over(Window.partitionBy()), F.lit(1)))
    )
    return draws, shares
