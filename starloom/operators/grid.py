"""Grids as relations: coordinates, mass assignment, density contrast, discrete Fourier transform."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.runtime import parallelism

AXES = ("x", "y", "z")


def cells(spark: SparkSession, n: int) -> DataFrame:
    """(idx, ix, iy, iz) of all n**3 cells, z fastest."""
    i = F.col("id")
    return spark.range(n**3).select(
        i.alias("idx"), F.expr(f"CAST(id div {n * n} AS INT)").alias("ix"), F.expr(f"CAST(id div {n} % {n} AS INT)").alias("iy"), F.expr(f"CAST(id % {n} AS INT)").alias("iz")
    )


def centre(i: Column, n: int, box: float) -> Column:
    return (i + 0.5) * (box / n)


def mode(i: Column, n: int) -> Column:
    """Signed wave number of a grid index."""
    return F.when(i <= n // 2, i).otherwise(i - n)


def assign_ngp(df: DataFrame, n: int, box: float, weight: Column | None = None) -> DataFrame:
    """(ix, iy, iz, rho): weight in the cell that holds each record (floor on either side of 0, quirk Q21)."""
    w = F.col("mass") if weight is None else weight
    at = [F.pmod(F.floor(F.col(a) * (n / box)), F.lit(n)).cast("int").alias(f"i{a}") for a in AXES]
    return df.select(*at, w.alias("w")).groupBy("ix", "iy", "iz").agg(F.sum("w").alias("rho"))


def assign_cic(df: DataFrame, n: int, box: float, weight: Column | None = None) -> DataFrame:
    """(ix, iy, iz, rho): weight spread over the eight nearest grid points, periodic.

    The eight shares of a record are merged per cell before they leave its task.
    """
    w = F.col("mass") if weight is None else weight
    low = df.select(w.alias("w"), *[F.pmod(F.col(a) * (n / box), F.lit(float(n))).alias(f"g{a}") for a in AXES])
    low = low.select("w", *[F.floor(f"g{a}").alias(f"l{a}") for a in AXES], *[(F.col(f"g{a}") - F.floor(f"g{a}")).alias(f"f{a}") for a in AXES])
    shares = []
    for o in itertools.product((0, 1), repeat=3):
        part = F.col("w")
        for a, up in zip(AXES, o):
            part = part * (F.col(f"f{a}") if up else 1.0 - F.col(f"f{a}"))
        shares.append(F.struct(*[F.pmod(F.col(f"l{a}") + up, F.lit(n)).cast("int").alias(f"i{a}") for a, up in zip(AXES, o)], part.alias("w")))
    return low.select(F.inline(F.array(*shares))).groupBy("ix", "iy", "iz").agg(F.sum("w").alias("rho"))


def contrast(rho: DataFrame, n: int) -> DataFrame:
    """(ix, iy, iz, delta) over all n**3 cells, empty ones included (quirk Q22); 0 if there is no mass."""
    mean = rho.agg(F.coalesce(F.sum("rho"), F.lit(0.0)) / n**3).scalar()
    whole = cells(rho.sparkSession, n).drop("idx").join(rho, ["ix", "iy", "iz"], "left").withColumn("mean", mean)
    delta = F.when(F.col("mean") > 0, (F.coalesce("rho", F.lit(0.0)) - F.col("mean")) / F.col("mean")).otherwise(0.0)
    return whole.select("ix", "iy", "iz", delta.alias("delta"))


PENCILS = 1 << 18  # values in a group of pencils


def _along(a: str, n: int, inverse: bool) -> Callable[[pa.Table], pa.Table]:
    """The transform of a group of whole lines along one axis."""
    b, c = (f"i{x}" for x in AXES if x != a)

    def run(t: pa.Table) -> pa.Table:
        col = {x: t.column(x).to_numpy() for x in (f"i{a}", b, c, "re", "im")}
        line, at = np.unique(col[b].astype(np.int64) * n + col[c], return_inverse=True)
        v = np.zeros((len(line), n), complex)
        v[at, col[f"i{a}"]] = col["re"] + 1j * col["im"]
        v = np.fft.ifft(v, axis=1) * n if inverse else np.fft.fft(v, axis=1) / n
        i = {f"i{a}": np.tile(np.arange(n), len(line)), b: np.repeat(line // n, n), c: np.repeat(line % n, n)}
        return pa.table({**{f"i{x}": pa.array(i[f"i{x}"].astype(np.int32)) for x in AXES}, "re": v.real.ravel(), "im": v.imag.ravel()})

    return run


def transform(field: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """Discrete Fourier transform of (ix, iy, iz, re, im), one axis after the other, divided by n**3 forward.

    Each pass groups the lines along its axis, a bounded number of whole lines at a time, and transforms them as one
    array: three shuffles of at most n**3 rows. Cells without a row are 0; lines without any are not given.
    """
    lines = max(1, min(PENCILS // n, n * n // parallelism(field.sparkSession)))
    out = field.select("ix", "iy", "iz", F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    for a in AXES:
        b, c = (f"i{x}" for x in AXES if x != a)
        group = F.expr(f"(CAST({b} AS BIGINT) * {n} + {c}) div {lines}")
        out = out.groupBy(group.alias("g")).applyInArrow(_along(a, n, inverse), "ix int, iy int, iz int, re double, im double")
    return out
