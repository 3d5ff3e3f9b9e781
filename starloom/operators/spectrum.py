"""Power spectra of grids, and what is derived from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.cosmology import tophat
from starloom.operators.grid import mode, transform


def modes(delta: DataFrame, n: int) -> DataFrame:
    """(ix, iy, iz, re, im) of a density contrast."""
    return transform(delta.select("ix", "iy", "iz", F.col("delta").alias("re"), F.lit(0.0).alias("im")), n)


def _binned(m: DataFrame, n: int) -> DataFrame:
    """Adds bin = int(|k| / dk) and mu2, without the mean and without bins from n/2 on."""
    k = [mode(F.col(f"i{a}"), n) for a in "xyz"]
    k2 = k[0] * k[0] + k[1] * k[1] + k[2] * k[2]
    return m.withColumn("k2", k2).where("k2 > 0").withColumns({"bin": F.floor(F.sqrt("k2")).cast("int"), "mu2": k[2] * k[2] / F.col("k2")}).where(F.col("bin") < n // 2)


def spectrum(m: DataFrame, n: int, box: float, shot: float | None = None, value: Column | None = None) -> DataFrame:
    """(bin, k, power, modes): mean squared amplitude times the volume, less the shot noise.

    All modes count once, as conjugate pairs count twice in half a grid. ``shot`` None is the noise of one
    record per cell (quirk Q1); pass volume / records for the noise of the records.
    """
    noise = box**3 / n**3 if shot is None else shot
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im") if value is None else value
    out = _binned(m, n).groupBy("bin").agg(F.avg(p).alias("mean"), F.count(F.lit(1)).alias("modes"))
    return out.select("bin", ((F.col("bin") + 0.5) * (2.0 * math.pi / box)).alias("k"), (F.col("mean") * box**3 - noise).alias("power"), "modes")


def cross(a: DataFrame, b: DataFrame, n: int, box: float) -> DataFrame:
    """Cross spectrum of two sets of modes; shot noise cancels."""
    other = b.select("ix", "iy", "iz", F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = a.join(other, ["ix", "iy", "iz"])
    return spectrum(both, n, box, 0.0, F.col("re") * F.col("re2") + F.col("im") * F.col("im2"))


def multipoles(m: DataFrame, n: int, box: float) -> DataFrame:
    """(bin, k, p0, p2, p4, modes): Legendre moments about the z axis, without shot noise."""
    p = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    mu2 = F.col("mu2")
    l2, l4 = (3.0 * mu2 - 1.0) / 2.0, (35.0 * mu2 * mu2 - 30.0 * mu2 + 3.0) / 8.0
    v = box**3
    out = _binned(m, n).groupBy("bin").agg(
        (F.avg(p) * v).alias("p0"), (F.avg(p * l2) * (5.0 * v)).alias("p2"), (F.avg(p * l4) * (9.0 * v)).alias("p4"), F.count(F.lit(1)).alias("modes")
    )
    return out.withColumn("k", (F.col("bin") + 0.5) * (2.0 * math.pi / box))


def with_errors(ps: DataFrame) -> DataFrame:
    return ps.where("modes > 0").withColumn("error", F.col("power") / F.sqrt("modes"))


def sigma(ps: DataFrame, r: float, box: float) -> DataFrame:
    """(as_published, sigma): with k**3 dk as published (quirk Q11), and with k**2 dk."""
    dk = 2.0 * math.pi / box
    k, w = F.col("k"), tophat(F.col("k") * r)
    base = F.col("power") * w * w * dk / (2.0 * math.pi**2)
    return ps.where("modes > 0").agg(F.sqrt(F.sum(base * k * k * k)).alias("as_published"), F.sqrt(F.sum(base * k * k)).alias("sigma"))


def slope(ps: DataFrame) -> DataFrame:
    """(bin, k, n_eff): d ln P / d ln k towards the next bin, where both powers are positive. One row a bin."""
    w = Window.orderBy("bin")
    nxt = ps.withColumns({"p2": F.lead("power").over(w), "k2": F.lead("k").over(w)}).where("p2 > 0 and power > 0")
    return nxt.select("bin", "k", (F.ln(F.col("p2") / F.col("power")) / F.ln(F.col("k2") / F.col("k"))).alias("n_eff"))
