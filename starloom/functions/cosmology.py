"""Background cosmology as column expressions.

Integrals are midpoint sums of a fixed number of steps, folded within a row: no join and no shuffle, so a
distance or an age is one projection over a table of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Speed of light in km/s; gravitational constant in Mpc (km/s)^2 per solar mass.
C_KMS = 299792.458
G_COSMO = 4.3009e-9


@dataclass(frozen=True)
class Cosmology:
    om: float = 0.31
    ol: float = 0.69
    ok: float = 0.0
    h: float = 0.67
    s8: float = 0.81
    ns: float = 0.965

    def __post_init__(self):
        self.validate()

    def validate(self) -> None:
        """Densities are not negative and add up to one."""
        if self.om < 0 or self.ol < 0 or abs(self.om + self.ol + self.ok - 1.0) > 1e-6:
            raise ValueError("densities must be non-negative and add up to 1")

    @property
    def h0(self) -> float:
        return 100.0 * self.h


def a_of(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + z)


def z_of(a: Column) -> Column:
    return F.lit(1.0) / a - F.lit(1.0)


def e2(c: Cosmology, a: Column) -> Column:
    """Squared expansion rate in units of today's."""
    out = F.lit(c.om) / (a * a * a) + F.lit(c.ol)
    return out + F.lit(c.ok) / (a * a) if c.ok else out


def hubble(c: Cosmology, a: Column) -> Column:
    return F.lit(c.h0) * F.sqrt(e2(c, a))


def adot(c: Cosmology, a: Column) -> Column:
    return a * hubble(c, a)


def addot(c: Cosmology, a: Column) -> Column:
    crit = 3.0 * c.h0**2 / (8.0 * math.pi * G_COSMO)
    return F.lit(-4.0 * math.pi * G_COSMO / 3.0) * a * (F.lit(c.om * crit) / (a * a * a) - F.lit(2.0 * c.ol * crit))


def omega_m(c: Cosmology, a: Column) -> Column:
    return F.lit(c.om) / (a * a * a) / e2(c, a)


def omega_l(c: Cosmology, a: Column) -> Column:
    return F.lit(c.ol) / e2(c, a)


def growth(c: Cosmology, a: Column) -> Column:
    """Approximate growth, not normalised today (quirk Q15 kept)."""
    m, lam = omega_m(c, a), omega_l(c, a)
    p = F.pow(m, F.lit(0.6))
    return a * p / (p + lam * (F.lit(1.0) + m / 70.0))


def growth_rate(c: Cosmology, a: Column) -> Column:
    return F.pow(omega_m(c, a), F.lit(0.55))


def integrate(f: Callable[[Column], Column], lo: Column, hi: Column, steps: int = 1000) -> Column:
    """Midpoint rule over ``steps`` steps, inside one row."""
    width = (hi - lo) / steps
    total = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda s, i: s + f(lo + (i + 0.5) * width))
    return total * width


def comoving(c: Cosmology, z: Column) -> Column:
    return integrate(lambda u: F.lit(C_KMS) / hubble(c, a_of(u)), F.lit(0.0), z)


def transverse(c: Cosmology, d: Column) -> Column:
    """Transverse from radial comoving distance, in the three curvatures."""
    if not c.ok:
        return d
    dh = C_KMS / c.h0
    r = math.sqrt(abs(c.ok))
    curve = F.sinh if c.ok > 0 else F.sin
    return F.lit(dh / r) * curve(d * (r / dh))


def angular_diameter(c: Cosmology, z: Column) -> Column:
    return transverse(c, comoving(c, z)) / (F.lit(1.0) + z)


def luminosity(c: Cosmology, z: Column) -> Column:
    return angular_diameter(c, z) * (F.lit(1.0) + z) * (F.lit(1.0) + z)


def age(c: Cosmology, a: Column) -> Column:
    """Cosmic time in Gyr."""
    return integrate(lambda u: F.lit(1.0) / (F.sqrt(e2(c, u)) * u), F.lit(0.0), a) * (9.778 / c.h)


def conformal(c: Cosmology, a: Column, as_published: bool = True) -> Column:
    """Conformal time; ``as_published`` keeps the additional 1/H0 of quirk Q16."""
    whole = integrate(lambda u: F.lit(1.0) / (hubble(c, u) * u * u), F.lit(0.0), a)
    return whole * (C_KMS / c.h0 if as_published else C_KMS)


def bbks(q: Column) -> Column:
    """Transfer function of Bardeen et al. 1986; the numbers are fixed values of that fit."""
    poly = F.lit(1.0) + 3.89 * q + F.pow(16.1 * q, F.lit(2.0)) + F.pow(5.46 * q, F.lit(3.0)) + F.pow(6.71 * q, F.lit(4.0))
    return F.log1p(2.34 * q) / (2.34 * q) * F.pow(poly, F.lit(-0.25))


def power(c: Cosmology, k: Column, z: Column) -> Column:
    """Unnormalised power with the units of q as published (quirk Q17)."""
    t, d = bbks(k / (c.om * c.h * c.h)), growth(c, a_of(z))
    return F.pow(k / 0.05, F.lit(c.ns - 1.0)) * t * t * d * d


def tophat(x: Column) -> Column:
    return F.when(x < 1e-6, F.lit(1.0)).otherwise(3.0 * (F.sin(x) - x * F.cos(x)) / (x * x * x))


def variance(c: Cosmology, r: Column) -> Column:
    """Variance in spheres of radius r, in a thousand logarithmic steps of k from 1e-4 to 1e2."""

    def f(lnk: Column) -> Column:
        k = F.exp(lnk)
        w = tophat(k * r)
        return power(c, k, F.lit(0.0)) * w * w * k * k * k / (2.0 * math.pi**2)

    return integrate(f, F.lit(math.log(1e-4)), F.lit(math.log(1e2)))


def linspace(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    """(i, a): n equally spaced values; a single value is ``lo``."""
    return spark.range(n).select(F.col("id").cast("int").alias("i"), (F.lit(lo) + F.col("id") * ((hi - lo) / max(1, n - 1))).alias("a"))


def evolve(c: Cosmology, a0: float, dt: Column, steps: Column) -> Column:
    """Scale factor after ``steps`` Euler steps a += a H(a) dt (quirk Q18 kept)."""
    return F.aggregate(F.sequence(F.lit(1), steps), F.lit(a0), lambda a, _: a + adot(c, a) * dt)


def summary(spark: SparkSession, c: Cosmology) -> DataFrame:
    one = F.lit(1.0)
    return spark.range(1).select(
        F.lit(c.om).alias("omega_m"), F.lit(c.ol).alias("omega_l"), F.lit(c.ok).alias("omega_k"), F.lit(c.h0).alias("h0"),
        F.round(age(c, one), 6).alias("age_gyr"), F.round(growth(c, one), 8).alias("growth_today"),
    )
