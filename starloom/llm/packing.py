"""Fixed-capacity containers filled by Karmarkar-Karp multiway differencing.

Items longer than the capacity are split into full containers and a rest. All other items are ordered by a hash
and cut, by prefix sums, into shards of about WINDOWS containers and at most ITEMS items; each shard is packed on
its own. Differencing starts with one partial partition per item and keeps merging the two with the largest
imbalance, heaviest window against lightest, so the windows of a shard end up nearly equal. Where one exceeds
the capacity, the shard is packed again with one window more. A shard's size is fixed by the capacity, so
neither the number of items nor any group of equal items changes what one task holds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.skew import prefix_sums
from starloom.runtime import Scratch

WINDOWS = 64
FILL = 0.995  # shards are cut at this part of their capacity
ITEMS = 8192  # items of a shard at most


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` windows, by largest differencing. Ties go by position."""
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = s
        heap.append((-int(s), i, sums, [None] * (k - 1) + [i]))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a, pa = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        sums = a + b[::-1]
        parts = [x if y is None else y if x is None else (x, y) for x, y in zip(pa, reversed(pb))]
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]
        heapq.heappush(heap, (-int(sums[-1]), made, sums, [parts[j] for j in order]))
        made += 1

    def leaves(tree) -> list[int]:
        out, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            elif t is not None:
                out.append(t)
        return out

    return [leaves(p) for p in heap[0][3]] if heap else [[] for _ in range(k)]


def pack_shard(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window number of each item; as few windows as differencing manages, counting up from the lower bound."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        windows = difference(sizes, k)
        if max(int(sizes[w].sum()) for w in windows) <= capacity:
            break
        k += 1
    out = np.empty(len(sizes), np.int32)
    for w, items in enumerate(windows):
        out[items] = w
    return out


def pack(df: DataFrame, key: str, size: str, capacity: int = 4096) -> DataFrame:
    """(key, piece, n_pieces, start, size, container): where each piece of each item goes.

    ``size`` counts units of an item (tokens); items of null, zero or negative size need no container and have
    one row with container null. Repeated keys count as items of their own if their rows differ in size, and
    once if they are equal. Rows without key are left out. An item up to the capacity is never split.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    items = scratch.keep(df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), n.alias("n")).distinct())
    whole = F.expr(f"CAST(n div {capacity} AS INT)")
    cut = items.where("n > 0").select("key", "n", whole.alias("full"), (F.col("n") % capacity).alias("rest"))
    cut = cut.withColumn("n_pieces", F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0))
    name = F.concat(F.lit("full-"), F.xxhash64("key", "n"), F.lit("-"), "piece")
    full = cut.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    full = full.select("key", "piece", "n_pieces", (F.col("piece") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("size"), name.alias("container"))
    rest = cut.where("rest > 0").select("key", F.col("full").alias("piece"), "n_pieces", (F.col("full") * F.lit(capacity)).cast("long").alias("start"), F.col("rest").alias("size"))
    room = int(WINDOWS * capacity * FILL)
    # an item takes its size of a shard's room, and a tiny one as much as keeps the shard at ITEMS
    rest = rest.withColumns({"h": F.xxhash64("key", "size"), "takes": F.greatest(F.col("size"), F.lit(-(-room // ITEMS)))})
    placed = prefix_sums(spark, rest, [], ["h", "key", "size", "piece"], "takes", "before", scratch)
    shard = F.expr(f"before div {room}")

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "key", "size", "piece"], kind="stable")
        w = pack_shard(pdf["size"].to_numpy(np.int64), capacity)
        return pdf[["key", "piece", "n_pieces", "start", "size"]].assign(container=[f"shard-{k[0]}-{i}" for i in w])

    kind = dict(items.dtypes)["key"]
    mixed = placed.withColumn("shard", shard).groupBy("shard").applyInPandas(run, f"key {kind}, piece int, n_pieces int, start long, size long, container string")
    none = items.where("n <= 0").select("key", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("container"))
    return full.unionByName(mixed).unionByName(none).withColumnRenamed("key", key)


def split_items(packed: DataFrame, key: str) -> DataFrame:
    """(key) of the items that the packing put into more than one container."""
    used = packed.where("container is not null").select(key, "container").distinct()
    return used.groupBy(key).agg(F.count(F.lit(1)).alias("_containers")).where("_containers > 1").select(key)


def fills(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """(container, n_items, used, unused) of every container."""
    used = packed.where("container is not null").groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("used"))
    return used.withColumn("unused", F.lit(capacity) - F.col("used"))


def report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: containers, items, size, the fewest containers possible, and the part of the space used."""
    total = fills(packed, capacity).agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n_items").alias("pieces"), F.sum("used").alias("size"), F.max("used").alias("fullest")
    )
    return total.withColumn("at_least", F.ceil(F.col("size") / capacity)).withColumn("fill", F.col("size") / (F.col("containers") * capacity))
