"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, order: list[Column], n: int, rank: str = "place") -> DataFrame:
    """The first ``n`` rows of every group in ``order``, with their place.

    The rank filter on row_number becomes a group limit: each task keeps at most ``n`` rows of a group before
    the shuffle, so a group with a third of all rows sends ``n`` rows a task. ``order`` should end in a unique
    column, then the result doesn't depend on row order. Rows with a null group are left out.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return df.where(F.col(group).isNotNull()).withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def positive(c: str) -> Column:
    """The value where it is a positive number; null for null, NaN, zero and negative."""
    v = F.col(c)
    return F.when(~F.isnan(v) & (v > 0), v)


def heaviest_progenitors(nodes: DataFrame, n: int = 3) -> DataFrame:
    """(descendant_id, halo_id, mass, redshift, place): the heaviest nodes of every positive descendant_id.

    Equal masses: lower redshift first, unusable redshifts last, then smaller halo_id. Nodes without a positive
    mass never rank. ``nodes`` must be unique by halo_id; other columns are ignored.
    """
    ranked = nodes.where((F.col("descendant_id") > 0) & positive("mass").isNotNull()).select("descendant_id", "halo_id", "mass", positive("redshift").alias("redshift"))
    return top_n(ranked, "descendant_id", [F.col("mass").desc(), F.col("redshift").asc_nulls_last(), F.col("halo_id")], n)
