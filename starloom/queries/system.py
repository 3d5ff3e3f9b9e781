"""Queries over sources, sinks and method choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.particles import HALOS_SQL, L, halo_bodies
from starloom.plans.methods import choose
from starloom.runtime import Scratch
from starloom.sources.generators import PRIME, random_particles
from starloom.sources.snapshots import FORMATS, export_snapshot, import_snapshot

CASES = [(500, False, False), (5000, True, False), (5000, False, True), (200000, True, True), (200000, False, False), (1000, False, False), (100000, True, False)]


def io_roundtrip(s, d):
    """The halos written and read in each format; ``copies`` counts the formats that gave a row back as it was."""
    scratch = Scratch(s, "io")
    b = scratch.keep(halo_bodies(s, d).select("id", "x", "y", "z", "mass"))
    out = None
    for fmt in FORMATS:
        export_snapshot(b, f"{scratch.base}/{fmt}", fmt, {"box": L})
        back = import_snapshot(s, f"{scratch.base}/{fmt}", b.schema, fmt)
        out = back if out is None else out.unionByName(back)
    return out.groupBy("id", "x", "y", "z", "mass").agg(F.count(F.lit(1)).alias("copies"))


def method_select(s, d):
    df = s.createDataFrame(CASES, "n bigint, gpu boolean, compiled boolean")
    return df.withColumn("method", choose(F.col("n"), F.col("gpu"), F.col("compiled")))


QUERIES = {
    "src_random": lambda s, d: random_particles(s, 10000, 100.0, 12345).select("id", *[F.round(c, 8).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")], "mass"),
    "io_roundtrip": io_roundtrip,
    "method_select": method_select,
}


def uniform_sql(seed: int, component: int) -> str:
    """The hashed deviate of the column i."""
    h = f"((i % {PRIME} * 48271 + {((seed + 1) * 69621 + component * 40692) % PRIME}) % {PRIME})"
    for step in (3, 7, 11):
        h = f"(SELECT (h * h % {PRIME} * {step} + h * 16807 + {component}) % {PRIME} AS h FROM (SELECT {h} AS h))"
    return f"(({h} + 0.5::DOUBLE) / {PRIME}.0::DOUBLE)"


SQL = {
    "src_random": "SELECT i AS id, "
    + ", ".join(f"round({uniform_sql(12345, c)} * 100, 8) AS {a}, round(sqrt(-2 * ln({uniform_sql(12345, 10 + 2 * c)})) * cos(2 * pi() * {uniform_sql(12345, 11 + 2 * c)}) * 100, 8) AS v{a}" for c, a in enumerate("xyz"))
    + ", 1.0::DOUBLE AS mass FROM range(10000) t(i)",
    "io_roundtrip": f"WITH {HALOS_SQL} SELECT id, x, y, z, mass, CAST(4 AS BIGINT) AS copies FROM p",
    "method_select": "SELECT n, gpu, compiled, CASE WHEN n < 1000 THEN 'DIRECT' WHEN n < 100000 THEN CASE WHEN gpu THEN 'TREE' ELSE 'DIRECT' END WHEN compiled THEN 'TENSORRT' ELSE 'TREE' END AS method FROM (VALUES "
    + ", ".join(f"(CAST({n} AS BIGINT), {g}, {c})" for n, g, c in CASES)
    + ") t(n, gpu, compiled)",
}
