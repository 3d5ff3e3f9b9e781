"""Connected components by minimum labels: hooking, pointer jumping, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.runtime import Scratch


def _roots(to: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, to) with every pointer followed to its end; pointers never go up, so their ends are fixed points."""
    moved = 1
    while moved:
        ahead = to.select(F.col("id").alias("to"), F.col("to").alias("ahead"))
        step = to.join(ahead, "to").select("id", F.col("ahead").alias("to"), (F.col("ahead") < F.col("to")).alias("moved"))
        after, moved = scratch.keep_counted(step, F.col("moved"))
        scratch.drop(to)
        to = after.select("id", "to")
    return after.select("id", "to")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) for every end of (u, v); label is the smallest id of the component.

    Each round every node points to the least of itself and its neighbours; pointers are followed to their
    ends, and the graph is contracted to the links between different ends. Rounds therefore handle ever fewer
    nodes and links. Minima are merged before they are shuffled. A popular end makes a skewed join, which is
    written right away, so that adaptive execution splits it. At last the rounds' pointers are chained, the
    smallest table first. A node linked to itself only is its own component.
    """
    links, n = scratch.keep_counted(edges.where("u is not null and v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    maps = []
    while n:
        both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("near"))
        to = _roots(scratch.keep(least.select("id", F.least("id", "near").alias("to"))), scratch)
        maps.append(to)
        moved = links.join(to.select(F.col("id").alias("u"), F.col("to").alias("ru")), "u").select("ru", "v")
        moved = moved.join(to.select(F.col("id").alias("v"), F.col("to").alias("rv")), "v").where("ru <> rv")
        after, n = scratch.keep_counted(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        scratch.drop(links)
        links = after
    label = None
    for to in reversed(maps):
        if label is not None:
            further = label.select(F.col("id").alias("to"), F.col("to").alias("end"))
            to = scratch.keep(to.join(further, "to", "left").select("id", F.coalesce("end", "to").alias("to")))
        label = to
    return links.select(F.col("u").alias("id"), F.col("v").alias("label")) if label is None else label.select("id", F.col("to").alias("label"))
