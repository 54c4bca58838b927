"""Problem 7: filling containers of fixed capacity.

Method: sum-of-squares packing.  N(g) is the number of open containers with g
tokens left.  Each item goes where the sum of N(g)^2 over the gaps 1..capacity-1
becomes smallest: into an open container that it fits, or into a new one.  An
item larger than a container is divided into full containers and a rest; no
other item is.

Items are spread by a hash of their identifier over shards of about
``SHARD_TOKENS`` tokens; each shard is packed by itself, so the work is
proportional to the input and a shard's few half-empty containers weigh little
against its thousands of full ones.  Only identifiers and sizes are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlake.session import cut_lineage

#: Tokens that are packed together, about.
SHARD_TOKENS = 4_000_000


class Packer:
    """Sum-of-squares packing of one shard, item by item."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, dtype=np.int64)  # N(g)
        self.members: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.containers = 0

    def place(self, size: int) -> int:
        """Number of the container that takes an item of 1..capacity tokens."""
        c, n = self.capacity, self.open
        if size == c:
            self.containers += 1
            return self.containers - 1
        # Change of the sum for an open gap h >= size: N(h) falls by one, N(h - size) rises by one; a gap of 0 counts nothing.
        change = 2 * (n[0 : c - size] - n[size:c] + 1)
        change[0] = 1 - 2 * n[size]
        change = np.where(n[size:c] > 0, change, 1 << 60)
        best = int(change.argmin())
        if change[best] <= 2 * n[c - size] + 1:
            number = self.members[size + best].pop()
            n[size + best] -= 1
            gap = best
        else:
            number = self.containers
            self.containers += 1
            gap = c - size
        if gap:
            n[gap] += 1
            self.members[gap].append(number)
        return number


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, start, tokens, container) for the items' parts, in the order given."""
    packer, out = Packer(capacity), []
    for i, size in enumerate(sizes):
        start = 0
        while size - start > 0:
            part = min(capacity, size - start)
            out.append((i, start, part, packer.place(part)))
            start += part
    return out


def _shard(capacity: int, key: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__order", key], kind="stable")
        placed = np.array(pack(rows["size"].tolist(), capacity), dtype=np.int64).reshape(-1, 4)
        return pd.DataFrame(
            {
                "shard": rows["shard"].iloc[0],
                "container": placed[:, 3],
                key: rows[key].to_numpy()[placed[:, 0]],
                "start": placed[:, 1],
                "tokens": placed[:, 2],
            }
        )

    return run


def fill_containers(items: DataFrame, key: str, capacity: int, seed: int = 7, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(shard, container, key, start, tokens): where each part of each item goes.

    ``items`` is (key, size), one row per item; null, zero and negative sizes take
    no room and give no row.  A container is named by shard and number.  An item
    that fits has one row with start 0; a divided one has a row per part.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = cut_lineage(items.select(key, F.col("size").cast("long").alias("size")).where("size > 0"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, round(total / shard_tokens))
    spread = sized.withColumn("__order", F.xxhash64(F.lit(seed), F.col(key)))
    spread = spread.withColumn("shard", F.pmod(F.shiftrightunsigned("__order", 20), F.lit(shards)).cast("int"))
    schema = f"shard int, container long, `{key}` {dict(items.dtypes)[key]}, start long, tokens long"
    return spread.groupBy("shard").applyInPandas(_shard(capacity, key), schema)


def container_fill(placed: DataFrame, capacity: int) -> DataFrame:
    """(shard, container, parts, tokens, unused) of each container."""
    return placed.groupBy("shard", "container").agg(
        F.count("*").alias("parts"), F.sum("tokens").alias("tokens"), (F.lit(capacity) - F.sum("tokens")).alias("unused")
    )


