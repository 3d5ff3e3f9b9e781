"""Percentiles of numeric columns from dyadic Count-sketches.

A value is encoded as an integer of BITS bits that keeps its order (logarithmic, relative step about 0.07
percent). Prefixes of up to EXACT bits are counted exactly; every longer prefix length has one Count-sketch
of ROWS signed rows of WIDTH counters. A sketch is the relation (group, level, row, bucket, total): sketches
of separate loads are merged by adding up counters, and rows are deleted by adding them with weight -1.
Ranks are inverted by descending the levels, a counter estimate deciding between the two halves.

Infinite values count at the ends. Groups whose key is null are groups of their own.

Error: ranks are off by at most about 3 * sqrt(F2 / WIDTH) per level below EXACT, F2 being the sum of squared
counts of that level's prefixes; with 1024 counters about one percent of the rank at worst, and none for
groups of few values. Values come out as the middle of the last prefix, 0.04 percent off.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, EXACT, ROWS, WIDTH = 22, 10, 5, 1024
HALF = 1 << (BITS - 1)
STEPS = (HALF - 1) / 1500.0  # codes for each unit of the natural logarithm; doubles span -745..710
PRIME = (1 << 31) - 1
_draw = random.Random(20240229)
#: One pairwise independent hash for each level and row; the low bit is the sign, the others the bucket.
HASHES = [(level, row, _draw.randrange(1, PRIME), _draw.randrange(PRIME)) for level in range(EXACT + 1, BITS + 1) for row in range(ROWS)]


def encode(c: str) -> Column:
    """Order-preserving code in [0, 2**BITS); null for null and NaN. Infinities take the end codes."""
    v = F.col(c)
    size = F.least(F.greatest(F.floor((F.ln(F.abs(v)) + 750.0) * STEPS), F.lit(0)), F.lit(HALF - 2)).cast("long")
    code = F.when(v > 0, HALF + 1 + size).when(v < 0, HALF - 1 - size).otherwise(F.lit(HALF))
    return F.when(v.isNotNull() & ~F.isnan(v), F.least(code, F.lit(2 * HALF - 1))).cast("long")


def decode(code: np.ndarray) -> np.ndarray:
    """Middle value of a code."""
    size = np.where(code > HALF, code - HALF - 1, HALF - 1 - code)
    with np.errstate(over="ignore"):
        return np.where(code == HALF, 0.0, np.sign(code - HALF) * np.exp((size + 0.5) / STEPS - 750.0))


def sketch(df: DataFrame, group: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(group, level, row, bucket, total) of all values; ``weight`` -1 deletes. Null and NaN are left out.

    Equal codes of a group are merged first, so the counters are fed at most 2**BITS codes a group whatever
    the number of rows; both steps add up before they shuffle.
    """
    w = F.lit(1) if weight is None else weight
    codes = df.select(*group, encode(value).alias("_code"), w.cast("long").alias("_w")).where("_code is not null")
    codes = codes.groupBy(*group, "_code").agg(F.sum("_w").alias("_w")).where("_w <> 0")
    spec = F.array(
        F.struct(F.lit(EXACT).alias("level"), F.lit(0).alias("row"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
        *[F.struct(F.lit(lv).alias("level"), F.lit(r).alias("row"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for lv, r, a, b in HASHES],
    )
    fed = codes.select(*group, "_code", "_w", F.inline(spec)).withColumn("_p", F.expr(f"shiftright(_code, {BITS} - level)"))
    fed = fed.withColumn("_h", (F.col("a") * F.col("_p") + F.col("b")) % PRIME)
    exact = F.col("level") == EXACT
    bucket = F.when(exact, F.col("_p")).otherwise(F.shiftright("_h", 1) % WIDTH).cast("int")
    signed = F.when(exact | (F.col("_h") % 2 == 0), F.col("_w")).otherwise(-F.col("_w"))
    return fed.select(*group, "level", "row", bucket.alias("bucket"), signed.alias("total")).groupBy(*group, "level", "row", "bucket").agg(F.sum("total").alias("total"))


def changes(rows: DataFrame, key: list[str], at: str, load: Column) -> DataFrame:
    """The rows with their ``load`` and weight 1, and each row that a later one of its key replaces once more with weight -1
    in that later one's load. Added up over all loads only the latest row of each key counts.

    Rows of a key are ordered by ``at``, null first, then by their other columns, so equal times never depend on row
    order; a key has as many rows as it was delivered.
    """
    rest = [F.col(f"`{c}`").asc_nulls_first() for c in rows.columns if c not in key and c != at]
    w = Window.partitionBy(*key).orderBy(F.col(at).asc_nulls_first(), *rest)
    own = rows.withColumn("load", F.coalesce(load, F.lit("")))
    both = own.withColumn("_next", F.lead("load").over(w))
    each = F.array(F.struct(F.col("load"), F.lit(1).alias("weight")), F.when(F.col("_next").isNotNull(), F.struct(F.col("_next").alias("load"), F.lit(-1).alias("weight"))))
    return both.withColumn("_c", F.explode(F.array_compact(each))).select(*rows.columns, "_c.load", "_c.weight")


def merge(group: list[str], *sketches: DataFrame) -> DataFrame:
    """The sketch of all rows of several sketches."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*group, "level", "row", "bucket").agg(F.sum("total").alias("total"))


def _invert(counters: pd.DataFrame, qs: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of values and the code at each q, from one group's counters."""
    top = np.zeros(1 << EXACT, np.int64)
    exact = counters["level"].to_numpy() == EXACT
    top[counters["bucket"].to_numpy()[exact]] = counters["total"].to_numpy()[exact]
    n = int(top.sum())
    if n <= 0:
        return 0, np.zeros(0, np.int64)
    cells = np.zeros((BITS - EXACT, ROWS, WIDTH), np.int64)
    deep = counters[~exact]
    cells[deep["level"].to_numpy() - EXACT - 1, deep["row"].to_numpy(), deep["bucket"].to_numpy()] = deep["total"].to_numpy()
    a, b = (np.array([h[i] for h in HASHES], np.int64).reshape(BITS - EXACT, ROWS) for i in (2, 3))
    rank = np.maximum(1, np.ceil(qs * n)).astype(np.float64)
    upto = np.cumsum(top)
    prefix = np.searchsorted(upto, rank)
    rank = rank - (upto[prefix] - top[prefix])
    inside = top[prefix].astype(np.float64)  # values below the present prefix
    for i in range(BITS - EXACT):
        left = 2 * prefix
        both = []
        for p in (left, left + 1):
            h = (a[i][:, None] * p[None, :] + b[i][:, None]) % PRIME
            both.append(np.median(np.where(h % 2 == 0, 1, -1) * cells[i, np.arange(ROWS)[:, None], (h >> 1) % WIDTH], axis=0))
        # two estimates that must add up to ``inside``: split their error evenly
        est = np.clip(both[0] + (inside - both[0] - both[1]) / 2, 0, inside)
        right = rank > est
        prefix = left + right
        rank, inside = np.where(right, rank - est, rank), np.where(right, inside - est, est)
    return n, prefix


def quantiles(counters: DataFrame, group: list[str], qs: list[float]) -> DataFrame:
    """(group, q, n, value) from sketches. A group's counters are bounded by the parameters above, so the
    grouped step never holds more than that, however many rows the group has. No values: no rows."""
    fields = {f.name: f.dataType.simpleString() for f in counters.schema.fields}
    schema = ", ".join(f"`{g}` {fields[g]}" for g in group) + ", q double, n bigint, value double"
    q = np.array(qs, float)

    def run(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        n, codes = _invert(pdf, q)
        data = {g: [None if pd.isna(k) else k] * len(codes) for g, k in zip(group, keys)}
        return pd.DataFrame(data | {"q": q[: len(codes)], "n": [n] * len(codes), "value": decode(codes)})

    return counters.groupBy(*group).applyInPandas(run, schema)


def rank_errors(df: DataFrame, group: list[str], value: str, found: DataFrame) -> DataFrame:
    """(group, q, n, error): by how many ranks each found percentile misses the rank asked for. Values within the step of
    the encoding count as equal. Percentiles are few, so they are broadcast and counted on the map side."""
    v, e = F.col(value), F.col("_value")
    step = 1.0 / STEPS
    few = found.select(*group, "q", F.col("value").alias("_value"))
    both = df.select(*group, value).join(F.broadcast(few), group)
    counts = both.groupBy(*group, "q").agg(F.count(F.lit(1)).alias("n"), F.count_if(v < e - F.abs(e) * step).alias("_below"), F.count_if(v <= e + F.abs(e) * step).alias("_upto"))
    rank = F.greatest(F.lit(1.0), F.ceil(F.col("q") * F.col("n")))
    return counts.select(*group, "q", "n", F.greatest(F.lit(0.0), F.col("_below") + 1 - rank, rank - F.col("_upto")).alias("error"))


def outliers(df: DataFrame, group: list[str], value: str, factor: float, quartiles: DataFrame) -> DataFrame:
    """Rows whose positive value is above factor times the upper quartile, or below the lower quartile divided
    by factor, of their group. ``quartiles`` has (group, q, value) at 0.25 and 0.75."""
    low, high = F.max(F.when(F.col("q") == 0.25, F.col("value"))), F.max(F.when(F.col("q") == 0.75, F.col("value")))
    wide = quartiles.groupBy(*group).agg(F.struct(low.alias("low"), high.alias("high")).alias("_quartiles"))
    v, q = F.col(value), F.col("_quartiles")
    return df.drop("_quartiles").where((v > 0) & ~F.isnan(v)).join(wide, group).where((v > q["high"] * factor) | (v < q["low"] / factor)).drop("_quartiles")
