"""Spatial keys, neighbour joins, boxes and ghost shells."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.vectors import lattice, min_image, morton


def offsets(half: bool = False) -> list[tuple[int, int, int]]:
    """The 27 neighbour offsets of a cell, or one of each opposite pair and the cell itself."""
    every = list(itertools.product((-1, 0, 1), repeat=3))
    return [o for o in every if o >= (0, 0, 0)] if half else every


def offset_array(half: bool = False) -> Column:
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("dx", "dy", "dz"), o)]) for o in offsets(half)])


def cell_of(df: DataFrame, box: float, cells: int) -> DataFrame:
    """Adds cx, cy, cz, kept inside the grid."""
    return df.withColumns({f"c{a}": lattice(F.col(a), box, cells) for a in "xyz"})


def neighbour_pairs(df: DataFrame, link: float, box: float) -> DataFrame:
    """(id1, id2, d2), id1 < id2, of all records within the linking length, periodic.

    An equi-join on grid cells as wide as the linking length: each record is sent to half its neighbours'
    cells, so a pair meets once, and records of other cells never meet. A grid of fewer than three cells a
    side would meet a pair twice, hence the distinct there.
    """
    n = max(1, int(box / link))
    at = cell_of(df.select("id", "x", "y", "z"), box, n)
    key = (F.col("cx") * n + F.col("cy")) * n + F.col("cz")
    left = at.select(F.col("id").alias("ida"), *[F.col(a).alias(f"{a}a") for a in "xyz"], "cx", "cy", "cz", F.explode(offset_array(n >= 3)).alias("o"))
    probe = [F.pmod(F.col(f"c{a}") + F.col(f"o.d{a}"), F.lit(n)) for a in "xyz"]
    own = (F.col("o.dx") == 0) & (F.col("o.dy") == 0) & (F.col("o.dz") == 0)
    left = left.select("ida", "xa", "ya", "za", own.alias("own"), ((probe[0] * n + probe[1]) * n + probe[2]).alias("cell"))
    both = left.join(at.select("id", "x", "y", "z", key.alias("cell")), "cell")
    d = [min_image(F.col(a) - F.col(f"{a}a"), box) for a in "xyz"]
    once = (~F.col("own") | (F.col("ida") < F.col("id"))) if n >= 3 else F.col("ida") < F.col("id")
    both = both.where(once).select("ida", "id", (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d2")).where(F.col("d2") <= F.lit(link) * F.lit(link))
    out = both.select(F.least("ida", "id").alias("id1"), F.greatest("ida", "id").alias("id2"), "d2")
    return out if n >= 3 else out.distinct()


def morton_key(box: float, x_first: bool = True, cells: int = 1024) -> Column:
    return morton(*[lattice(F.col(a), box, cells) for a in "xyz"], x_first=x_first)


def in_box(lo: tuple, hi: tuple) -> Column:
    """Half-open box; on raw columns these plain comparisons reach the Parquet scan."""
    ok = F.lit(True)
    for a, low, high in zip("xyz", lo, hi):
        ok = ok & (F.col(a) >= F.lit(low)) & (F.col(a) < F.lit(high))
    return ok


def in_shell(lo: tuple, hi: tuple, width: float) -> Column:
    """Within ``width`` of the box, but not in it."""
    wide = in_box(tuple(v - width for v in lo), tuple(v + width for v in hi))
    return wide & ~in_box(lo, hi)
