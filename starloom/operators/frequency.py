"""Per-key results over skewed keys by value-frequency compression.

Rows are grouped by (key, value) before key: the first grouping spreads a hot key over all its values,
and what the second one sees are weighted values, already merged on the map side. Distinct counts, modes
and percentiles come from the weights and are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.skew import prefix_sums
from starloom.runtime import Scratch


def compress(df: DataFrame, keys: list[str], values: list[str], weight: str = "weight") -> DataFrame:
    """One row per (keys, values) with its number of rows. Nulls group as values of their own."""
    return df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias(weight))


def distinct_counts(freq: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """(keys, n_distinct, n_rows) of compressed rows."""
    return freq.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"), F.sum(weight).alias("n_rows"))


def modes(freq: DataFrame, keys: list[str], value: str, weight: str = "weight") -> DataFrame:
    """(keys, mode, mode_weight): the heaviest value, of equals the smallest; null values never win.

    A max over (weight, -value) structs, so a hot key is merged on the map side.
    """
    best = F.max(F.struct(F.col(weight).alias("w"), (-F.col(value)).alias("v")))
    return (
        freq.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(best.alias("_b"))
        .select(*keys, (-F.col("_b.v")).alias("mode"), F.col("_b.w").alias("mode_weight"))
    )


def percentiles(freq: DataFrame, key: str, value: str, qs: list[float], weight: str = "weight") -> DataFrame:
    """(key, q, value): the smallest value whose cumulative weight reaches q of the key's weight.

    Null and NaN values are left out. Cumulative weights come from range-partitioned prefix sums, so a key
    with any number of distinct values is never held by one task.
    """
    spark = freq.sparkSession
    scratch = Scratch(spark, "percentiles")
    good = freq.where(F.col(value).isNotNull() & F.col(key).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    good = scratch.keep(good.groupBy(key, value).agg(F.sum(weight).alias(weight)))
    totals = good.groupBy(key).agg(F.sum(weight).alias("_total"))
    cum = prefix_sums(spark, good, [key], [value], weight, "_before", scratch)
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("_total")))
    return (
        cum.join(totals, key)
        .withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
        .where((F.col("_before") < rank) & (F.col("_before") + F.col(weight) >= rank))
        .select(key, "q", value)
    )


def memberships(df: DataFrame) -> DataFrame:
    """Deliveries of (halo_id, id, snap) compressed to weighted memberships; no halo or no id: left out.

    A null snap is a value of its own, as in SQL DISTINCT.
    """
    real = df.select("halo_id", "id", "snap").where((F.col("halo_id") > 0) & F.col("id").isNotNull())
    return compress(real, ["halo_id"], ["id", "snap"])


def halo_profiles(df: DataFrame) -> DataFrame:
    """Per halo: distinct memberships, deliveries, distinct ids and snapshots, mode and median snapshot.

    Extra columns are ignored; an empty table gives no rows. Of equally frequent snapshots the earliest is
    the mode; the median is the lower one.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "profiles")
    member = scratch.keep(memberships(df))
    ids = member.groupBy("halo_id", "id").agg(F.count(F.lit(1)).alias("k")).groupBy("halo_id").agg(F.count(F.lit(1)).alias("n_ids"))
    snaps = scratch.keep(
        member.groupBy("halo_id", "snap").agg(F.count(F.lit(1)).alias("weight"), F.sum("weight").alias("rows"))
    )
    sizes = snaps.groupBy("halo_id").agg(
        F.sum("weight").alias("n_memberships"), F.sum("rows").alias("n_rows"), F.count("snap").alias("n_snaps")
    )
    mode = modes(snaps.drop("rows"), ["halo_id"], "snap").withColumnsRenamed({"mode": "mode_snap", "mode_weight": "mode_n"})
    median = percentiles(snaps.drop("rows"), "halo_id", "snap", [0.5]).select("halo_id", F.col("snap").alias("median_snap"))
    return sizes.join(ids, "halo_id").join(mode, "halo_id", "left").join(median, "halo_id", "left")


def heavy_halos(df: DataFrame, percent: int = 2) -> DataFrame:
    """halo_ids with at least ``percent`` percent of all distinct memberships."""
    per = distinct_counts(memberships(df), ["halo_id"])
    total = per.agg(F.sum("n_distinct")).scalar()
    return per.where(F.col("n_distinct") * 100 >= total * percent).select("halo_id")


def top_snapshots(df: DataFrame, n: int = 3) -> DataFrame:
    """Per halo its ``n`` fullest snapshots (ties: earlier first), from weighted values."""
    snaps = memberships(df).groupBy("halo_id", "snap").agg(F.count(F.lit(1)).alias("n_members"))
    w = Window.partitionBy("halo_id").orderBy(F.col("n_members").desc(), F.col("snap").asc_nulls_last())
    return snaps.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
