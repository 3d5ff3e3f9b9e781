"""Domains: block decomposition, owners, neighbours, ghosts, load balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.functions.vectors import lattice, morton, wrap
from starloom.operators.spatial import offset_array


def block_dims(n: int) -> tuple[int, int, int]:
    """Three factors of n as near to each other as possible, in ascending order."""
    best = (1, 1, n)
    for a in range(1, n + 1):
        if n % a == 0:
            for b in range(a, n // a + 1):
                if (n // a) % b == 0 and n // a // b >= b:
                    c = n // a // b
                    if c - a < best[2] - best[0]:
                        best = (a, b, c)
    return best


def block(a: str, blocks: int, box: float, shift: float = 0.0) -> Column:
    """Block number along one axis of a (shifted) coordinate: wrap, floor, keep inside."""
    return F.least(F.floor(wrap(F.col(a) + shift, box) / (box / blocks)), F.lit(blocks - 1)).cast("int")


def owner(dims: tuple[int, int, int], box: float) -> Column:
    """Rank of the block that holds a position."""
    at = [block(a, d, box) for a, d in zip("xyz", dims)]
    return ((at[0] * dims[1] + at[1]) * dims[2] + at[2]).cast("int")


def bounds(spark: SparkSession, dims: tuple[int, int, int], box: float) -> DataFrame:
    """(dom, xmin, xmax, ymin, ...) of all blocks."""
    i = [F.expr(f"id div {dims[1] * dims[2]}"), F.expr(f"id div {dims[2]} % {dims[1]}"), F.expr(f"id % {dims[2]}")]
    ends = [((c + up) * (box / d)).alias(f"{a}{n}") for c, d, a in zip(i, dims, "xyz") for up, n in ((0, "min"), (1, "max"))]
    return spark.range(dims[0] * dims[1] * dims[2]).select(F.col("id").cast("int").alias("dom"), *ends)


def neighbours(spark: SparkSession, dims: tuple[int, int, int]) -> DataFrame:
    """(dom, neighbour): the distinct blocks around each, periodic, itself left out."""
    i = [F.expr(f"id div {dims[1] * dims[2]}"), F.expr(f"id div {dims[2]} % {dims[1]}"), F.expr(f"id % {dims[2]}")]
    each = spark.range(dims[0] * dims[1] * dims[2]).select("id", *[c.alias(f"i{a}") for c, a in zip(i, "xyz")], F.explode(offset_array()).alias("o"))
    to = [F.pmod(F.col(f"i{a}") + F.col(f"o.d{a}"), F.lit(d)) for a, d in zip("xyz", dims)]
    return each.select(F.col("id").cast("int").alias("dom"), ((to[0] * dims[1] + to[1]) * dims[2] + to[2]).cast("int").alias("neighbour")).where("dom <> neighbour").distinct()


def exchange(df: DataFrame, dims: tuple[int, int, int], box: float) -> DataFrame:
    """Records with their owner, partitioned by it."""
    return df.withColumn("owner", owner(dims, box)).repartition("owner")


def ghosts(df: DataFrame, dims: tuple[int, int, int], box: float, width: float) -> DataFrame:
    """(id, owner, dom): owned records within ``width`` of a neighbouring domain (quirk Q20 is not reproduced)."""
    at = df.select("id", owner(dims, box).alias("owner"), *[F.array_distinct(F.array(*[block(a, n, box, i * width) for i in (-1, 0, 1)])).alias(f"b{a}") for a, n in zip("xyz", dims)])
    for a in "xyz":  # one axis after the other: most records stay a single row
        at = at.withColumn(f"b{a}", F.explode(f"b{a}"))
    rank = ((F.col("bx") * dims[1] + F.col("by")) * dims[2] + F.col("bz")).cast("int")
    return at.select("id", "owner", rank.alias("dom")).where("owner <> dom")


def loads(df: DataFrame, dims: tuple[int, int, int], box: float, most: float = 0.2) -> DataFrame:
    """One row: fewest and most records of a domain, empty ones included, and whether that calls for rebalancing."""
    n = df.select(owner(dims, box).alias("dom")).groupBy("dom").agg(F.count(F.lit(1)).alias("n"))
    every = bounds(df.sparkSession, dims, box).select("dom").join(n, "dom", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    out = every.agg(F.min("n").alias("fewest"), F.max("n").alias("most"), F.sum("n").alias("records"))
    return out.withColumn("rebalance", F.coalesce((F.col("most") - F.col("fewest")) > most * F.col("most"), F.lit(False)))


def density(df: DataFrame, box: float, n: int = 32) -> DataFrame:
    """(ix, iy, iz, n) of occupied cells, the top one kept inside."""
    return df.select(*[lattice(F.col(a), box, n).cast("int").alias(f"i{a}") for a in "xyz"]).groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"))


def morton_cells(df: DataFrame, box: float, n: int = 32) -> DataFrame:
    """(place, code, n): the occupied cells in Morton order. The window holds at most n**3 cells."""
    code = morton(*[F.col(f"i{a}").cast("long") for a in "xyz"], x_first=False)
    cells = density(df, box, n).select(code.alias("code"), "n")
    return cells.select(F.row_number().over(Window.orderBy("code")).alias("place"), "code", "n")


def deal(codes: list[int], counts: list[int], parts: int, cells: int) -> list[int]:
    """The first cell of each part, when cells are dealt out in order and a cell that would bring a part above the mean
    begins the next one. Cells that aren't listed are empty; one after a part above the mean begins the next as well."""
    target, begins, load, last = sum(counts) // parts, [0], 0, -1

    def move(at: int) -> bool:
        if len(begins) < parts:
            begins.append(at)
            return True
        return False

    for code, n in [*zip(codes, counts), (cells, 0)]:
        if load > target and code > last + 1 and move(last + 1):
            load = 0
        if code < cells:
            load = n if load + n > target and move(code) else load + n
        last = code
    return begins


def _dealt(df: DataFrame, box: float, parts: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(code, part) of all n**3 cells, dealt out greedily in Morton order, and (code, n) of the occupied ones. The driver
    deals out cell counts, at most n**3 whatever the number of records, and keeps where each part begins."""
    spark = df.sparkSession
    codes = density(df, box, n).select(morton(*[F.col(f"i{a}").cast("long") for a in "xyz"], x_first=False).alias("code"), "n")
    seen = codes.toPandas().sort_values("code")
    begins = deal(seen["code"].tolist(), seen["n"].tolist(), parts, n**3)
    first = spark.createDataFrame(list({code: part for part, code in enumerate(begins)}.items()), "code bigint, part int")
    counts = spark.createDataFrame(seen, "code bigint, n bigint")
    whole = spark.range(n**3).select(F.col("id").alias("code")).join(F.broadcast(first), "code", "left")
    return whole.select("code", F.max("part").over(Window.orderBy("code")).alias("part")), counts


def greedy(df: DataFrame, box: float, parts: int, n: int = 32) -> DataFrame:
    """(part, load, cells, xmin, xmax, ymin, ymax, zmin, zmax): Morton-ordered cells dealt out in turn, moving on when a cell
    would exceed the mean, and the box around each part's cells. Parts without cells have no row; an empty table
    gives the uniform blocks, with load and cells 0. The windows hold n**3 cells, however many records there are."""
    side = box / n
    if not df.limit(1).count():
        even = bounds(df.sparkSession, block_dims(parts), box)
        return even.select(F.col("dom").alias("part"), F.lit(0).cast("long").alias("load"), F.lit(0).cast("long").alias("cells"), *[f"{a}{e}" for a in "xyz" for e in ("min", "max")])
    dealt, codes = _dealt(df, box, parts, n)
    bits = range((n - 1).bit_length())
    along = [sum((F.shiftleft(F.shiftright("code", 3 * b + o).bitwiseAND(F.lit(1).cast("long")), b) for b in bits), F.lit(0).cast("long")) for o in range(3)]
    placed = dealt.join(codes, "code", "left").select("part", "n", *[i.alias(f"i{a}") for i, a in zip(along, "xyz")])
    sides = [e for a in "xyz" for e in ((F.min(f"i{a}") * side).alias(f"{a}min"), ((F.max(f"i{a}") + 1) * side).alias(f"{a}max"))]
    return placed.groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("load"), F.count(F.lit(1)).alias("cells"), *sides)


def rebalanced(df: DataFrame, box: float, parts: int, n: int = 32) -> DataFrame:
    """The records with their ``owner`` among greedily dealt parts, partitioned by it; up to 32**3 cells are broadcast."""
    dealt, _ = _dealt(df, box, parts, n)
    dealt = dealt.withColumnRenamed("part", "owner")
    code = morton(*[lattice(F.col(a), box, n) for a in "xyz"], x_first=False)
    return df.withColumn("code", code).join(F.broadcast(dealt) if n <= 32 else dealt, "code").drop("code").repartition("owner")
