"""Generated particles. Deviates are integer hashes of id, seed and component: the same rows on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1


def uniform(i: Column, seed: int, component: int) -> Column:
    """A number in (0, 1) from an integer, by three quadratic steps modulo a prime."""
    h = (i % PRIME * 48271 + ((seed + 1) * 69621 + component * 40692) % PRIME) % PRIME
    for step in (3, 7, 11):
        h = (h * h % PRIME * step + h * 16807 + component) % PRIME
    return (h + 0.5) / float(PRIME)


def normal(i: Column, seed: int, component: int) -> Column:
    """A standard normal deviate from two uniform ones."""
    return F.sqrt(-2.0 * F.ln(uniform(i, seed, component))) * F.cos(2.0 * math.pi * uniform(i, seed, component + 1))


def random_particles(spark: SparkSession, n: int, box: float, seed: int, spread: float = 100.0, mass: float = 1.0) -> DataFrame:
    """n particles, uniform in the box, normal velocities, equal masses."""
    i = F.col("id")
    at = [(uniform(i, seed, c) * box).alias(a) for c, a in enumerate("xyz")]
    v = [(normal(i, seed, 10 + 2 * c) * spread).alias(f"v{a}") for c, a in enumerate("xyz")]
    return spark.range(n).select("id", *at, *v, F.lit(mass).alias("mass"))


def standard_particles(spark: SparkSession, n: int, box: float, seed: int, om: float) -> DataFrame:
    """n random particles with velocities of spread 100 times the root of the matter density."""
    return random_particles(spark, n, box, seed, 100.0 * math.sqrt(om))


def uniform_grid_points(spark: SparkSession, n: int, box: float, seed: int) -> DataFrame:
    """n**3 uniform points (a glass before it is relaxed)."""
    return random_particles(spark, n**3, box, seed).select("id", "x", "y", "z")
