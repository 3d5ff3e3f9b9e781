"""Leapfrog steps as projections, and a simulation as iterated DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.vectors import wrap
from starloom.operators import forces as fo
from starloom.runtime import Scratch

Field = Callable[[DataFrame], DataFrame]


def kick(df: DataFrame, dt: float, per: float = 1.0) -> DataFrame:
    """v += a dt, with accelerations ax, ay, az; ``per`` divides (the squared scale factor, if comoving)."""
    return df.withColumns({f"v{a}": F.col(f"v{a}") + F.col(f"a{a}") * (dt / per) for a in "xyz"})


def drift(df: DataFrame, dt: float, box: float | None = None) -> DataFrame:
    """x += v dt, back into the box."""
    at = {a: F.col(a) + F.col(f"v{a}") * dt for a in "xyz"}
    return df.withColumns({a: c if box is None else wrap(c, box) for a, c in at.items()})


def _with(df: DataFrame, field: Field) -> DataFrame:
    return df.drop("ax", "ay", "az").join(field(df).select("id", "ax", "ay", "az"), "id")


def kdk(df: DataFrame, dt: float, field: Field, box: float | None = None) -> DataFrame:
    """Kick, drift, kick. Accelerations are computed first (quirk Q10), and again after the drift."""
    half = drift(kick(_with(df, field), dt / 2), dt, box)
    return kick(_with(half, field), dt / 2).drop("ax", "ay", "az")


def run(bodies: DataFrame, steps: int, dt: float, eps: float, box: float | None = None, seen: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """(step, kinetic, potential, total, drift) of a system under its own gravity. Every step is written and
    read back, so plans stay short and finished steps survive lost executors."""
    spark = bodies.sparkSession
    scratch = Scratch(spark, "run")
    now, rows = scratch.keep(bodies), []
    for step in range(steps + 1):
        if step:
            now = scratch.keep(kdk(now, dt, lambda d: fo.direct(d, d, eps, box), box))
        e = fo.energies(now, eps, box).first()
        rows.append((step, float(e["kinetic"] or 0), float(e["potential"] or 0), float(e["total"] or 0)))
        if seen:
            seen(step, now)
    first = rows[0][3]
    out = [(*r, (r[3] - first) / abs(first) if first else 0.0) for r in rows]
    return spark.createDataFrame(out, "step int, kinetic double, potential double, total double, drift double")
