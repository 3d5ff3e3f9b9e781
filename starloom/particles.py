"""Clean particle views over the tables: one row per id, usable coordinates, inside the box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.vectors import wrap
from starloom.operators.skew import latest
from starloom.runtime import table

L = 1000.0
COLUMNS = ("x", "y", "z", "vx", "vy", "vz", "mass")


def _usable(*cols: str):
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok


def particles(spark: SparkSession, d: str, where: Column | None = None) -> DataFrame:
    """(id, x, y, z, vx, vy, vz, mass): repeated rows once, coordinates wrapped, missing mass or velocity 0.

    Maxima instead of first values: repeats merge on the map side and the result doesn't depend on row order.
    ``where`` is a condition on the wrapped coordinates; repeats are equal, so it holds before they are merged and
    only the rows that meet it are shuffled.
    """
    df = table(spark, d, "particles").where(_usable("x", "y", "z") & F.col("id").isNotNull())
    if where is not None:
        df = df.withColumns({c: wrap(F.col(c), L) for c in "xyz"}).where(where)
    once = df.groupBy("id").agg(*[F.max(c).alias(c) for c in COLUMNS])
    rest = [F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(c) for c in COLUMNS[3:]]
    return once.select("id", *[wrap(F.col(c), L).alias(c) for c in "xyz"], *rest)


PARTICLES_SQL = """p0 AS (SELECT id, max(x) AS x, max(y) AS y, max(z) AS z, max(vx) AS vx, max(vy) AS vy, max(vz) AS vz, max(mass) AS mass
FROM particles WHERE id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z) GROUP BY id),
p AS (SELECT id, x - 1000.0::DOUBLE * floor(x / 1000.0::DOUBLE) AS x, y - 1000.0::DOUBLE * floor(y / 1000.0::DOUBLE) AS y, z - 1000.0::DOUBLE * floor(z / 1000.0::DOUBLE) AS z,
coalesce(CASE WHEN NOT isnan(vx) THEN vx END, 0) AS vx, coalesce(CASE WHEN NOT isnan(vy) THEN vy END, 0) AS vy,
coalesce(CASE WHEN NOT isnan(vz) THEN vz END, 0) AS vz, coalesce(CASE WHEN NOT isnan(mass) THEN mass END, 0) AS mass FROM p0)"""

UNIT = 1e12  # halo masses are counted in this many


def halo_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The present rows of halos as particles at their centres of mass, masses in units of 1e12."""
    now = latest(table(spark, d, "halos").select("halo_id", "comx", "comy", "comz", "vx", "vy", "vz", "mass", "loaded_at"), "halo_id", "loaded_at")
    return now.where(_usable("comx", "comy", "comz", "mass") & (F.col("mass") > 0)).select(
        F.col("halo_id").alias("id"), *[F.col(f"com{c}").alias(c) for c in "xyz"], "vx", "vy", "vz", (F.col("mass") / UNIT).alias("mass")
    )


HALOS_SQL = """p AS (SELECT halo_id AS id, comx AS x, comy AS y, comz AS z, vx, vy, vz, mass / 1e12 AS mass FROM
(SELECT *, row_number() OVER (PARTITION BY halo_id ORDER BY loaded_at DESC) AS rn FROM halos)
WHERE rn = 1 AND comx IS NOT NULL AND comy IS NOT NULL AND comz IS NOT NULL AND mass > 0 AND NOT isnan(mass))"""


def hosts(spark: SparkSession, d: str) -> DataFrame:
    """The host halos as particles; a fixed table of a few rows."""
    return table(spark, d, "host_halos").select(
        F.col("halo_id").alias("id"), *[F.col(f"com{c}").alias(c) for c in "xyz"], "vx", "vy", "vz", (F.col("mass") / UNIT).alias("mass")
    )


HOSTS_SQL = "p AS (SELECT halo_id AS id, comx AS x, comy AS y, comz AS z, vx, vy, vz, mass / 1e12 AS mass FROM host_halos)"
