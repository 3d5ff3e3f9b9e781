"""Joins, prefix sums and latest-row selection that keep their balance under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.runtime import Scratch, parallelism


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The row with the greatest ``at`` per ``key``; null keys are left out, a null ``at`` is the earliest.

    Equal ``at``: the greatest of the remaining sortable columns, so the choice never depends on row
    order. The rank filter becomes a group limit before and after the shuffle, so repeated rows of a
    hot key don't travel.
    """
    rest = [F.col(f"`{c}`").desc_nulls_last() for c, t in df.dtypes if c not in (key, at) and not t.startswith("map")]
    w = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), *rest)
    rank = "_rank" + "_" * sum(c.startswith("_rank") for c in df.columns)
    return df.where(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def hot_keys(df: DataFrame, key: str, rows: int | None = None, share: int = 4) -> list:
    """Keys holding more than 1/(share * partitions) of the rows: at most share * partitions of them."""
    parts = parallelism(df.sparkSession)
    rows = df.count() if rows is None else rows
    least = max(20_000, rows // (share * parts))
    if rows < least:
        return []
    found = df.groupBy(key).count().where((F.col("count") > least) & F.col(key).isNotNull())
    return [r[0] for r in found.select(key).collect()]


def lookup(left: DataFrame, right: DataFrame, key: str, rows: int | None = None, how: str = "left") -> DataFrame:
    """Join ``right``, unique by ``key``, to ``left``, where a few keys may hold most rows of ``left``.

    Rows of hot keys meet a broadcast of those keys' rows of ``right``: at most one for each hot key, and
    hot keys are bounded in number (see :func:`hot_keys`). All others take the ordinary shuffled join.
    """
    return join_hot(left, right, key, hot_keys(left, key, rows), how)


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """The join of :func:`lookup` with its hot keys given."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = left.where(~is_hot | F.col(key).isNull()).join(right.where(~is_hot), key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)


def prefix_sums(
    spark: SparkSession, df: DataFrame, keys: list[str], order: list[str], value: str, out: str, scratch: Scratch
) -> DataFrame:
    """Running sum of ``value`` before each row, per ``keys`` in ``order`` (exclusive).

    ``keys + order`` must identify a row. The rows are range-partitioned by them, so a hot key spreads over
    many partitions; each partition's sums per key give the offsets, and only partitions, never rows,
    are added up in one window.
    """
    parts = parallelism(spark)
    ranged = df.repartitionByRange(parts, *[*keys, *order]).withColumn("_pid", F.spark_partition_id())
    ranged = scratch.keep(ranged)
    sums = ranged.groupBy("_pid", *keys).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    if not keys:
        before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    within = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("_run", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = run["_pid"] == offsets["_pid"]
    for k in keys:
        same = same & run[k].eqNullSafe(offsets[k])
    total: Column = (F.col("_run") + F.col("_offset")).alias(out)
    return run.join(offsets, same).select(*[run[c] for c in df.columns], total)
