"""Problem 6: near-duplicate records with small edits.

Method: multi-index hashing.  A record's fingerprint is a string of min-wise
symbols (8 bits or less) of its word set, so two records with Jaccard similarity J
differ in a share of 1-J of the places.  The fingerprint is cut into segments of
``k`` symbols; in each segment's table a record looks up the Hamming ball of
radius 1 around its own value.  All values that differ in one given place are
one entry, so a ball is ``k`` entries, and two records meet if they differ in at
most one symbol of a segment.  What meets must agree in a check word, then the
complete distance is verified, then the word sets are compared exactly.

Segments grow with the collection (``plan``): unrelated records, of which about a
tenth of the words agree, then share an entry about as rarely per record at every
size, and the work grows as the number of records times a small power of its
logarithm.  The number of segments follows from the threshold: a pair at the
threshold is missed with probability ``MISSED`` at most, a more similar one far
less often.  What is found is exact.  Equal word sets are one class first.

Only ids, check words and 64-bit entries are shuffled; the word sets stay in a table in
the shared folder, from which those of the pairs left are fetched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.llm.termcounts import words
from litlake.session import cut_lineage, written

#: Probability that a pair at the threshold shares no entry, and that it fails the check word or the complete distance.
MISSED, BEYOND = 1e-4, 1e-6
#: Bits of the check word.
CHECK = 256
#: The classes whose word sets are fetched by broadcast are at most so many (16 bytes each); more are fetched by a shuffle.
FETCHED = 500_000


def plan(records: int, threshold: float) -> tuple[int, int]:
    """(symbols in a segment, segments) for a collection of so many records."""
    k = 1 + max(3, round(math.log10(max(records, 1))))
    met = threshold**k + k * (1 - threshold) * threshold ** (k - 1)
    return k, math.ceil(math.log(MISSED) / math.log1p(-met))


def most_apart(places: int, differ: float, beyond: float = BEYOND) -> int:
    """The least number of places that a pair at the threshold exceeds with probability ``beyond`` at most, each differing with probability ``differ``."""
    left = 1.0
    for d in range(places + 1):
        left -= math.exp(math.lgamma(places + 1) - math.lgamma(d + 1) - math.lgamma(places - d + 1) + d * math.log(differ) + (places - d) * math.log1p(-differ))
        if left <= beyond:
            return d
    return places


def symbol_bits(k: int) -> int:
    """Bits of a symbol: a segment is one 64-bit number."""
    return min(8, 64 // k)


def fingerprints(sets: list[np.ndarray], symbols: int, bits: int = 8) -> np.ndarray:
    """``symbols`` values of ``bits`` bits and ``CHECK`` of one bit for each non-empty array of 64-bit word hashes."""
    rng = np.random.default_rng(20240607)
    size = symbols + CHECK
    multipliers = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    adders = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    mixed = ((every[:, None] * multipliers[None, :] + adders[None, :]) >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum([len(s) for s in sets])
    out = np.empty((len(sets), size), dtype=np.uint32)
    for i, (start, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
        out[i] = mixed[place[start:end]].min(axis=0)
    out[:, :symbols] &= (1 << bits) - 1
    out[:, symbols:] &= 1
    return out.astype(np.uint8)


def _describe(k: int, segments: int):
    symbols, bits = k * segments, symbol_bits(k)
    shifts = (np.arange(k, dtype=np.uint64) * np.uint64(bits))[None, None, :]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets, keep = [], []
            for i, text in enumerate(batch["text"]):
                found = set(words(text))
                if found:
                    keep.append(i)
                    sets.append(np.sort(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in found), dtype=np.uint64, count=len(found))))
            for start in range(0, len(sets), 1000):
                part = sets[start : start + 1000]
                prints = fingerprints(part, symbols, bits)
                cut = (prints[:, :symbols].reshape(len(part), segments, k).astype(np.uint64) << shifts).sum(axis=2, dtype=np.uint64)
                check = np.packbits(prints[:, symbols:], axis=1).view(">i8").astype(np.int64)
                rows = batch.iloc[keep[start : start + 1000]]
                yield pd.DataFrame(
                    {
                        "key": rows["key"].to_numpy(),
                        "place": rows["place"].to_numpy(),
                        "cls": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in part],
                        **{f"check_{i}": check[:, i] for i in range(CHECK // 64)},
                        "segments": list(cut.view(np.int64)),
                        "words": [s.view(np.int64) for s in part],
                    }
                )

    return run


_CHECKS = [f"check_{i}" for i in range(CHECK // 64)]


def describe(records: DataFrame, k: int, segments: int) -> DataFrame:
    """(key, place, cls, check_0.., segments, words) of ``records``: (key string, place long, text); null texts and texts without words are left out."""
    checks = ", ".join(f"{c} long" for c in _CHECKS)
    return records.where(F.col("text").isNotNull()).mapInPandas(
        _describe(k, segments), f"key string, place long, cls string, {checks}, segments array<long>, words array<long>"
    )


def near_classes(described: DataFrame, records: int, k: int, segments: int, threshold: float) -> DataFrame:
    """(cls_a, cls_b, similarity) for the similar pairs of classes of ``described``, a table that is cheap to read again."""
    once = described.groupBy("cls").agg(F.first(F.struct(*_CHECKS, "segments")).alias("d"))  # equal for equal classes
    bits = symbol_bits(k)
    one = (1 << bits) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    without = [signed(((1 << 64) - 1) ^ (one << (bits * i))) for i in range(k)]
    # An entry has 8 bits more than would number all entries, so by chance it is shared by one row in 256.
    short = 64 - min(64, 8 + math.ceil(math.log2(max(2, records * k * segments))))
    entries = F.array(
        *[F.shiftrightunsigned(F.xxhash64(F.lit(s * k + i), F.col("d.segments")[s].bitwiseAND(F.lit(without[i]).cast("long"))), short) for s in range(segments) for i in range(k)]
    )
    rows = once.select(F.explode(entries).alias("entry"), F.xxhash64("cls").alias("rid"), *[F.col(f"d.{c}") for c in _CHECKS])
    x, y = rows.alias("x"), rows.alias("y")  # one shuffle serves both
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _CHECKS), F.lit(0))
    met = (
        x.join(y.hint("merge"), "entry")
        .where((F.col("x.rid") < F.col("y.rid")) & (apart <= most_apart(CHECK, (1 - threshold) / 2)))
        .select("x.rid", F.col("y.rid").alias("r"))
        .distinct()
    )
    pairs = cut_lineage(met)
    ids = pairs.select(F.explode(F.array("rid", "r")).alias("id")).distinct()
    sets = described.select(F.xxhash64("cls").alias("id"), "cls", "segments", "words")
    few = pairs.count() * 2 <= FETCHED
    sets = sets.join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["cls"])
    a = sets.select(F.col("id").alias("rid"), F.col("cls").alias("__a"), F.col("segments").alias("__sa"), F.col("words").alias("__wa"))
    b = sets.select(F.col("id").alias("r"), F.col("cls").alias("__b"), F.col("segments").alias("__sb"), F.col("words").alias("__wb"))
    unequal = lambda z: sum(((z.bitwiseAND(F.lit(signed(one << (bits * i))).cast("long")) != 0).cast("int") for i in range(k)), F.lit(0))
    distance = F.aggregate(F.zip_with("__sa", "__sb", lambda p, q: p.bitwiseXOR(q)), F.lit(0), lambda n, z: n + unequal(z))
    shared = F.size(F.array_intersect("__wa", "__wb"))
    return (
        pairs.join(a, "rid")
        .join(b, "r")
        .where(distance <= most_apart(k * segments, 1 - threshold))
        .withColumn("similarity", shared / (F.size("__wa") + F.size("__wb") - shared))
        .where(F.col("similarity") >= threshold)
        .select(F.least("__a", "__b").alias("cls_a"), F.greatest("__a", "__b").alias("cls_b"), "similarity")
        .distinct()
    )


def near_duplicates(records: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(members, links) of ``records`` (key string, text and, if wanted, place): (key, cls) and (cls_a, cls_b, similarity).

    Repeated rows count once.  With a column ``place`` (long) only the first by
    place of a key's rows with words counts; without it a key with
    several texts is a member of several classes.  Null keys, null texts and
    texts without letters or digits are left out.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    by_place = "place" in records.columns
    rows = records.select("key", *(["place"] if by_place else [F.lit(0).cast("long").alias("place")]), "text").where("key is not null")
    records = rows.count()
    k, segments = plan(records, threshold)
    described = written(describe(rows, k, segments))
    if by_place:
        members = described.groupBy("key").agg(F.min_by("cls", "place").alias("cls"))
    else:
        members = described.select("key", "cls").distinct()
    return members, near_classes(described, records, k, segments, threshold)
