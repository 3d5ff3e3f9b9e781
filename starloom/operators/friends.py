"""Sets of records connected by a linking length, without ever making a row of a pair inside a cell.

1. Positions are quantised; cells have a diagonal of at most the linking length, so records of one cell are
   linked and only cells need to be connected. Hot cells shrink to one row here.
2. Coarse blocks of cells, each with a border of the neighbouring ones, drop the records that have no other
   record in reach. Only each block's least and greatest id travel, merged on the map side.
3. Adjacent cells are joined by way of wide cells: a cell goes to those of half the wide cells around its own that its
   records can reach, where it meets a bounded number of others. Bounding boxes of their records, in whole
   quantised units, decide most pairs: surely linked, or too far apart. Of the rest, small ones compare their records
   (at most PAIRS), larger ones are quantised again at half the side, until every pair is decided.
4. Minimum labels are propagated over linked cells to convergence.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.vectors import min_image, wrap
from starloom.operators.graph import connected_components
from starloom.operators.skew import join_hot
from starloom.runtime import Scratch, parallelism

AXES = ("x", "y", "z")
REACH = 2  # cells of side link / sqrt(3): two apart may be linked, three apart never
PAIRS = 4096
UNITS = 1 << 20  # quantised units along a wide cell
SPARSE = 0.05  # records expected in a block of evenly spread ones


class Grid:
    """Cells of a periodic box, ``w`` of them along a wide cell; numbers as columns."""

    def __init__(self, link: float, box: float):
        need = box * math.sqrt(3) / link * (1 + 1e-9)
        self.w = 4 if need > 8 else 2
        self.wides = math.ceil(need / self.w)
        if self.wides < 3 or box < 3 * link:
            raise ValueError("the box must be at least three linking lengths wide")
        self.n, self.box, self.link = self.wides * self.w, box, link
        self.unit = box / self.wides / UNITS
        self.reach2 = (link / self.unit) ** 2

    def units(self, a: str) -> Column:
        """Whole units along an axis."""
        return F.least(F.floor(F.col(a) * (1.0 / self.unit)), F.lit(self.wides * UNITS - 1)).cast("long")

    def along(self, a: str) -> Column:
        """Cell number along an axis."""
        return F.shiftright(self.units(a), (UNITS // self.w).bit_length() - 1).cast("int")

    def axes(self, c: str) -> list[Column]:
        """Cell numbers along the axes of a cell."""
        n = self.n
        return [F.expr(f"{c} div {n * n}"), F.expr(f"{c} div {n} % {n}"), F.expr(f"{c} % {n}")]

    def wide(self, axes: list[Column]) -> Column:
        return (axes[0] * self.wides + axes[1]) * self.wides + axes[2]


def placed(df: DataFrame, box: float) -> DataFrame:
    """(id, x, y, z) inside [0, box) of the rows with an id and finite coordinates."""
    ok = F.col("id").isNotNull()
    for a in AXES:
        ok = ok & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < F.lit(1e300))
    return df.where(ok).select("id", *[wrap(F.col(a), box).alias(a) for a in AXES])


def _blocks(points: DataFrame, g: Grid) -> tuple[DataFrame, DataFrame]:
    """The points (id, x, y, z, cx, cy, cz, with the numbers of their cell) with their block, and (block, rows) of the blocks
    that more than one id is in or borders on."""
    count = max(1, points.count())
    k = min(64, max(4, int((SPARSE * g.n**3 / count) ** (1 / 3))), max(1, g.n // 2))
    nb = max(1, g.n // k)
    own = [F.least(F.expr(f"CAST(c{a} div {k} AS INT)"), F.lit(nb - 1)) for a in AXES]
    number = lambda x, y, z: ((x.cast("long") * nb + y) * nb + z).alias("block")
    near = F.lit(False)
    for a in AXES:
        inside = F.col(f"c{a}") % k
        near = near | (inside < REACH) | (inside >= k - REACH) | (F.col(f"c{a}") >= nb * k - REACH)
    border = points.where(near).select("id", *[c.alias(f"b{a}") for c, a in zip(own, AXES)], *[f"c{a}" for a in AXES])
    for a in AXES:
        b, c = F.col(f"b{a}"), F.col(f"c{a}")
        low = F.when(c - b * k < REACH, F.pmod(b - 1, F.lit(nb)))
        high = F.when(F.when(b == nb - 1, F.lit(g.n)).otherwise((b + 1) * k) - c <= REACH, F.pmod(b + 1, F.lit(nb)))
        border = border.withColumn(f"b{a}", F.explode(F.array(b, low, high))).where(F.col(f"b{a}").isNotNull())
    copies = points.select(number(*own), "id").unionByName(border.select(number(*[F.col(f"b{a}") for a in AXES]), "id"))
    dense = copies.groupBy("block").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi")
    return points.select("id", *AXES, ((F.col("cx").cast("long") * g.n + F.col("cy")) * g.n + F.col("cz")).alias("cell"), number(*own)), dense.select("block", "rows")


def _decide(pairs: DataFrame, near: Column, far: Column, link2: float) -> DataFrame:
    """Pairs that may be linked, with ``sure`` where they are."""
    return pairs.where(near <= link2 * (1 + 1e-9)).withColumn("sure", far <= link2 * (1 - 1e-9))


def _bounds(points: DataFrame, *keys: str) -> DataFrame:
    ends = [f(a).alias(f"{s}{a}") for a in AXES for s, f in (("l", F.min), ("h", F.max))]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ends)


def _side(df: DataFrame, s: str) -> DataFrame:
    """Columns of one side of a pair, renamed."""
    return df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])


def _compare(pairs: DataFrame, points: DataFrame, keys: list[str], g: Grid) -> DataFrame:
    """Linked (cell_a, cell_b) of pairs with at most PAIRS record pairs each."""
    at = points.select(*keys, *AXES)
    both = pairs.select(*[f"{k}_{s}" for s in "ab" for k in keys]).join(_side(at, "a"), [f"{k}_a" for k in keys]).join(_side(at, "b"), [f"{k}_b" for k in keys])
    d = [min_image(F.col(f"{x}_b") - F.col(f"{x}_a"), g.box) for x in AXES]
    return both.where(d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= F.lit(g.link) * F.lit(g.link)).select("cell_a", "cell_b").distinct()


def _met(cells: DataFrame, g: Grid, scratch: Scratch) -> DataFrame:
    """(cell_a, cell_b, n_a, n_b, sure) of adjacent cells that may be linked. ``cells`` has (cell, n, and for each axis the
    bounds l, h of its records in units)."""
    wide = {a: F.expr(f"CAST(l{a} div {UNITS} AS INT)").alias(f"w{a}") for a in AXES}
    # the lower ends and the extents: most cells have one record, and zeros cost nothing on the way
    ends = [(F.col(f"l{a}") % UNITS).cast("double").alias(f"l{a}") for a in AXES] + [(F.col(f"h{a}") - F.col(f"l{a}")).cast("double").alias(f"e{a}") for a in AXES]
    each = cells.select("cell", F.least("n", F.lit(PAIRS + 1)).cast("int").alias("n"), *ends, *wide.values())
    steps = [o for o in itertools.product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    offsets = F.array(*[F.struct(*[F.lit(i).alias(f"d{a}") for a, i in zip(AXES, o)]) for o in steps])
    out = each.select("*", F.inline(offsets))
    gap = F.lit(0.0)  # from a cell's records to the wide cell it is sent to
    for a in AXES:
        q = F.when(F.col(f"d{a}") > 0, UNITS - 1.0 - F.col(f"l{a}") - F.col(f"e{a}")).when(F.col(f"d{a}") < 0, F.col(f"l{a}")).otherwise(F.lit(0.0))
        gap = gap + q * q
    out = out.where(gap <= g.reach2 * (1 + 1e-9))
    own = F.expr("dx = 0 AND dy = 0 AND dz = 0")
    to = g.wide([F.pmod(F.col(f"w{a}") + F.col(f"d{a}"), F.lit(g.wides)).cast("long") for a in AXES])
    seen = [(F.col(f"l{a}") - F.col(f"d{a}") * float(UNITS)).alias(f"l{a}_a") for a in AXES] + [F.col(f"e{a}").alias(f"e{a}_a") for a in AXES]
    out = out.select(F.col("cell").alias("cell_a"), F.col("n").alias("n_a"), *seen, F.when(own, F.col("cell")).otherwise(F.lit(-1)).alias("above"), to.alias("wide"))
    there = each.select(g.wide([F.col(f"w{a}").cast("long") for a in AXES]).alias("wide"), *[F.col(c).alias(f"{c}_b") for c in ("cell", "n", *[f"{s}{a}" for s in "le" for a in AXES])])
    near, far = F.lit(0.0), F.lit(0.0)
    for a in AXES:
        (la, ea), (lb, eb) = ((F.col(f"l{a}_{t}"), F.col(f"e{a}_{t}")) for t in "ab")
        # two units wider than they are: rounding never decides a pair
        q, r = F.greatest(F.lit(0.0), lb - la - ea - 2.0, la - lb - eb - 2.0), F.greatest(lb + eb - la, la + ea - lb) + 2.0
        near, far = near + q * q, far + r * r
    both = out.join(there, "wide").where(F.col("cell_b") > F.col("above"))
    return scratch.keep(_decide(both, near, far, g.reach2).select("cell_a", "cell_b", "n_a", "n_b", "sure"))


def _finer(large: DataFrame, points: DataFrame, g: Grid, scratch: Scratch) -> list[DataFrame]:
    """Linked (cell_a, cell_b) of undecided pairs with many records, quantised again at half the side each round."""
    side, n, link2 = g.box / g.n, g.n, g.link * g.link
    small = F.col("n_a").cast("long") * F.col("n_b") <= PAIRS
    zero = F.lit(0).cast("long")
    at, keys, found, level = points.withColumn("sub", zero), ["cell", "sub"], [], 0
    shift = [F.when(b - a < -n // 2, F.lit(g.box)).when(b - a > n // 2, F.lit(-g.box)).otherwise(0.0).alias(f"s{x}") for a, b, x in zip(g.axes("cell_a"), g.axes("cell_b"), AXES)]
    large = scratch.keep(large.select("cell_a", "cell_b", *shift, zero.alias("sub_a"), zero.alias("sub_b")))
    while large.limit(1).count():
        level += 1
        q, fine = 2**level, zero
        for a, c in zip(AXES, g.axes("cell")):
            inside = F.floor((F.col(a) - c * side) * F.lit(q / side)).cast("long")
            fine = fine * q + F.least(F.greatest(inside, F.lit(0)), F.lit(q - 1))
        busy = large.select(F.col("cell_a").alias("cell"), F.col("sub_a").alias("sub")).unionByName(large.select(F.col("cell_b").alias("cell"), F.col("sub_b").alias("sub"))).distinct()
        split = scratch.keep(at.join(busy, keys, "left_semi").withColumn("finer", fine))
        parts = _bounds(split, "cell", "sub", "finer")
        both = large.join(_side(parts, "a"), ["cell_a", "sub_a"]).join(_side(parts, "b"), ["cell_b", "sub_b"])
        near, far = F.lit(0.0), F.lit(0.0)
        for a in AXES:
            lb, hb = F.col(f"l{a}_b") + F.col(f"s{a}"), F.col(f"h{a}_b") + F.col(f"s{a}")
            gap = F.greatest(F.lit(0.0), lb - F.col(f"h{a}_a"), F.col(f"l{a}_a") - hb)
            wide = F.greatest(hb - F.col(f"l{a}_a"), F.col(f"h{a}_a") - lb)
            near, far = near + gap * gap, far + wide * wide
        nearer = scratch.keep(_decide(both, near, far, link2))
        sure = scratch.keep(nearer.where("sure").select("cell_a", "cell_b").distinct())
        found.append(sure)
        rest = nearer.join(sure, ["cell_a", "cell_b"], "left_anti").drop("sub_a", "sub_b").withColumnsRenamed({"finer_a": "sub_a", "finer_b": "sub_b"})
        at = split.drop("sub").withColumnRenamed("finer", "sub")
        found.append(_compare(rest.where(small), at, keys, g))
        large = scratch.keep(rest.where(~small).select("cell_a", "cell_b", *[f"s{a}" for a in AXES], "sub_a", "sub_b"))
    return found


def linked(df: DataFrame, link: float, box: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Points (id, x, y, z, cell) that may have another in reach, and labels (cell, label) of the cells linked to others.

    ``df`` has (id, x, y, z), any number of rows for an id. The box is periodic and at least three links wide.
    """
    g = Grid(link, box)
    spark = df.sparkSession
    at = scratch.keep(placed(df, box).select("id", *AXES, *[g.along(a).alias(f"c{a}") for a in AXES]))
    home, dense = _blocks(at, g)
    dense = scratch.keep(dense)
    hot = [r[0] for r in dense.where(F.col("rows") > F.greatest(F.lit(20_000), dense.agg(F.sum("rows")).scalar() / (4 * parallelism(spark)))).select("block").collect()]
    points = scratch.keep(join_hot(home, dense.select("block"), "block", hot, "inner").select("id", *AXES, "cell"))
    scratch.drop(at)
    units = points.select("cell", *[g.units(a).alias(a) for a in AXES])
    pairs = _met(_bounds(units, "cell"), g, scratch)
    small = F.col("n_a").cast("long") * F.col("n_b") <= PAIRS
    edges = [pairs.where("sure").select("cell_a", "cell_b"), _compare(pairs.where("not sure").where(small), points, ["cell"], g)]
    edges += _finer(pairs.where("not sure").where(~small), points, g, scratch)
    whole = edges[0]
    for e in edges[1:]:
        whole = whole.unionByName(e)
    labels = connected_components(whole.select(F.col("cell_a").alias("u"), F.col("cell_b").alias("v")), scratch)
    return points, labels.withColumnRenamed("id", "cell")


def groups(points: DataFrame, labels: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(label, id) without repeats, and (label, size, first) of the sets of at least ``least`` distinct ids."""
    rows = points.select("id", "cell").join(labels, "cell", "left").select(F.coalesce("label", "cell").alias("label"), "id")
    once = scratch.keep(rows.distinct())
    named = once.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).where(F.col("size") >= least)
    return once, scratch.keep(named)
