"""Clusters of mutually close records by grid density clustering, exact under a linking length.

Features are quantised to cells whose diagonal is at most the linking length, cells are counted, adjacent dense
cells are joined, and minimum labels are propagated over them to convergence (see
:mod:`starloom.operators.friends`); a cluster is described by its size and the members of its densest cell.

Input ``id, x, y, z`` with any other columns, which are ignored. Repeated rows count once; rows with a null
id, or a null, NaN or infinite coordinate, are left out; an id at several places belongs to each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.friends import AXES, groups, linked
from starloom.runtime import Scratch


def members(df: DataFrame, link: float = 0.2, box: float = 1000.0, least: int = 20) -> DataFrame:
    """(cluster_id, id), one row for each id of each cluster of at least ``least`` distinct ids; cluster_id is the smallest.
    The box is periodic and at least 3 links wide."""
    scratch = Scratch(df.sparkSession, "clusters")
    once, named = groups(*linked(df, link, box, scratch), least, scratch)
    return once.join(named, "label").select(F.col("first").alias("cluster_id"), "id")


def describe(df: DataFrame, link: float = 0.2, box: float = 1000.0, least: int = 20, typical: int = 5) -> DataFrame:
    """(cluster_id, size, n_cells, densest_n, place, id): the ``typical`` members of each cluster's densest
    cell, nearest to the cell's centre of gravity first, ties by id; of equally dense cells the first."""
    scratch = Scratch(df.sparkSession, "clusters")
    points, labels = linked(df, link, box, scratch)
    _, named = groups(points, labels, least, scratch)
    placed = points.join(labels, "cell", "left").withColumn("label", F.coalesce("label", "cell"))
    rows = scratch.keep(placed.distinct().join(named, "label").select(F.col("first").alias("cluster_id"), "size", "id", "cell", *AXES))
    cells = rows.groupBy("cluster_id", "size", "cell").agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"c{a}") for a in AXES])
    dense = cells.groupBy("cluster_id").agg(
        F.max("size").alias("size"), F.count(F.lit(1)).alias("n_cells"), F.max(F.struct("n", (-F.col("cell")).alias("c"), *[f"c{a}" for a in AXES])).alias("b")
    )
    dense = dense.select("cluster_id", "size", "n_cells", F.col("b.n").alias("densest_n"), (-F.col("b.c")).alias("cell"), *[f"b.c{a}" for a in AXES])
    inside = rows.drop("size").join(dense, ["cluster_id", "cell"])
    d2 = sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in AXES), F.lit(0.0))
    w = Window.partitionBy("cluster_id").orderBy(F.round(d2, 12), "id")
    ranked = inside.withColumn("d2", d2).withColumn("place", F.row_number().over(w)).where(F.col("place") <= typical)
    return ranked.select("cluster_id", "size", "n_cells", "densest_n", "place", "id")
