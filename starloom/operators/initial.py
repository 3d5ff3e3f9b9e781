"""Initial conditions: tabulated power, Gaussian modes, displacements of first and second order.

``mode='reference'`` takes the real part of the Fourier value as the displacement at the same index (quirk
Q12); ``mode='physical'`` transforms back. Noise is a hash of the mode, so it is the same on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.cosmology import Cosmology, bbks
from starloom.functions.vectors import min_image, wrap
from starloom.operators.grid import cells, centre, mode, transform
from starloom.runtime import Scratch
from starloom.sources.generators import uniform

NOISE = 99991


@dataclass(frozen=True)
class Start:
    n: int = 8
    box: float = 100.0
    z: float = 49.0
    k_min: float = 1e-3
    k_max: float = 1e2
    points: int = 1000
    cosmo: Cosmology = field(default_factory=Cosmology)
    #: Power of a wave number, before normalisation; None is the one of the transfer function.
    power: Callable[[Column], Column] | None = None

    @property
    def step(self) -> float:
        return (math.log(self.k_max) - math.log(self.k_min)) / (self.points - 1)

    def growth(self) -> tuple[float, float, float]:
        """Growth, growth rate and a*H at the start."""
        c, a = self.cosmo, 1.0 / (1.0 + self.z)
        e2 = c.om / a**3 + c.ok / a**2 + c.ol
        m, lam = c.om / a**3 / e2, c.ol / e2
        return a * m**0.6 / (m**0.6 + lam * (1.0 + m / 70.0)), m**0.55, a * c.h0 * math.sqrt(e2)


def raw_power(s: Start, k: Column) -> Column:
    if s.power is not None:
        return s.power(k)
    t = bbks(k / (s.cosmo.om * s.cosmo.h))
    return F.pow(k, F.lit(s.cosmo.ns)) * t * t


def interpolated(s: Start, k: Column) -> Column:
    """Power between the logarithmic table points, linear in logarithms, constant beyond the ends. The table is
    equally spaced, so its two points are computed in place and nothing is joined."""
    at = (F.ln(k) - math.log(s.k_min)) / s.step
    i = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(s.points - 2))
    f = F.least(F.greatest(at - i, F.lit(0.0)), F.lit(1.0))
    lo, hi = (F.ln(raw_power(s, F.exp(F.lit(math.log(s.k_min)) + j * s.step))) for j in (i, i + 1))
    return F.exp(lo + (hi - lo) * f)


def sigma8(s: Start) -> Column:
    """Spread in spheres of 8, in 1000 logarithmic steps of the interpolated power, folded in one row."""
    lo, hi = math.log(1e-3), math.log(1e2)

    def term(i: Column) -> Column:
        k = F.exp(lo + (i + 0.5) * ((hi - lo) / 1000))
        x = k * 8.0
        w = 3.0 * (F.sin(x) - x * F.cos(x)) / (x * x * x)
        return interpolated(s, k) * w * w * k * k * k

    total = F.aggregate(F.sequence(F.lit(0), F.lit(999)), F.lit(0.0), lambda t, i: t + term(i))
    return F.sqrt(total * ((hi - lo) / 1000) / (2.0 * math.pi**2))


def norm(spark: SparkSession, s: Start) -> float:
    """Factor that brings sigma8 to its target: one number, from parameters alone."""
    return (s.cosmo.s8 / spark.range(1).select(sigma8(s)).first()[0]) ** 2


def table(spark: SparkSession, s: Start, factor: float = 1.0) -> DataFrame:
    k = F.exp(F.lit(math.log(s.k_min)) + F.col("id") * s.step)
    return spark.range(s.points).select(F.col("id").cast("int").alias("i"), k.alias("k"), (raw_power(s, k) * factor).alias("p"))


def noise(c: int) -> Column:
    """A deviate of mean 0 and variance 1 from the mode's indices: four hashed uniform ones added up."""
    total = F.lit(0.0)
    for j in range(4 * c + 1, 4 * c + 5):
        h = (F.col("ix") * (7919 * j + 13) + F.col("iy") * (10473 * j + 7) + F.col("iz") * (12997 * j + 3) + 31 * j * j) % NOISE
        total = total + ((h * h * 7 + h * j) % NOISE) / float(NOISE)
    return (total - 2.0) * math.sqrt(3.0)


def gaussian(spark: SparkSession, s: Start, factor: float) -> DataFrame:
    """(ix, iy, iz, re, im) before the reality constraint; the mean is 0."""
    g = cells(spark, s.n).select(*[F.col(f"i{a}").cast("long").alias(f"i{a}") for a in "xyz"])
    k2 = sum((mode(F.col(f"i{a}"), s.n) * mode(F.col(f"i{a}"), s.n) for a in "xyz"), F.lit(0))
    k = F.sqrt(k2) * (2.0 * math.pi / s.box)
    amp = F.when(k2 > 0, F.sqrt(interpolated(s, k) * (factor * s.box**3 / 2.0))).otherwise(0.0)
    return g.select("ix", "iy", "iz", amp.alias("amp"), noise(0).alias("g0"), noise(1).alias("g1")).select("ix", "iy", "iz", (F.col("amp") * F.col("g0")).alias("re"), (F.col("amp") * F.col("g1")).alias("im"))


def hermitian(m: DataFrame, n: int) -> DataFrame:
    """Averages every mode with the conjugate of its mirror image; self-conjugate modes become real (Q14)."""
    mirror = m.select(*[((n - F.col(f"i{a}")) % n).alias(f"i{a}") for a in "xyz"], F.col("re").alias("re2"), F.col("im").alias("im2"))
    both = m.join(mirror, ["ix", "iy", "iz"])
    return both.select("ix", "iy", "iz", ((F.col("re") + F.col("re2")) / 2).alias("re"), ((F.col("im") - F.col("im2")) / 2).alias("im"))


def displacement(m: DataFrame, s: Start, growth: float, how: str = "reference") -> DataFrame:
    """(ix, iy, iz, px, py, pz): -i k / k^2 times the modes times growth."""
    k = [mode(F.col(f"i{a}"), s.n) * (2.0 * math.pi / s.box) for a in "xyz"]
    k2 = k[0] * k[0] + k[1] * k[1] + k[2] * k[2]
    unit = [F.when(k2 > 0, q / k2 * growth).otherwise(0.0) for q in k]
    if how == "reference":
        return m.select("ix", "iy", "iz", *[(u * F.col("im")).alias(f"p{a}") for u, a in zip(unit, "xyz")])
    out = None
    for u, a in zip(unit, "xyz"):
        one = transform(m.select("ix", "iy", "iz", (u * F.col("im")).alias("re"), (-u * F.col("re")).alias("im")), s.n, inverse=True)
        one = one.select("ix", "iy", "iz", (F.col("re") / s.n**3).alias(f"p{a}"))
        out = one if out is None else out.join(one, ["ix", "iy", "iz"])
    return out


def second_order(m: DataFrame, s: Start) -> DataFrame:
    """(ix, iy, iz, re, im): each mode coupled to its 26 neighbours with the F2 weight, summed where the sum of
    the wave vectors falls; negative components are rounded towards 0 (quirk Q13)."""
    n = s.n
    near = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(k).alias("dk")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)])
    one = m.select("ix", "iy", "iz", "re", "im", F.explode(near).alias("o"))
    one = one.select(*[F.col(f"i{a}").alias(f"a{a}") for a in "xyz"], F.col("re").alias("ra"), F.col("im").alias("ia"), *[F.pmod(F.col(f"i{a}") + F.col(f"o.d{d}"), F.lit(n)).alias(f"i{a}") for a, d in zip("xyz", "ijk")])
    both = one.join(m, ["ix", "iy", "iz"])
    p, q = [mode(F.col(f"a{a}"), n) for a in "xyz"], [mode(F.col(f"i{a}"), n) for a in "xyz"]
    both = both.withColumns({**{f"p{a}": v for a, v in zip("xyz", p)}, **{f"q{a}": v for a, v in zip("xyz", q)}})
    both = both.withColumns({"p2": F.expr("px * px + py * py + pz * pz").cast("double"), "q2": F.expr("qx * qx + qy * qy + qz * qz").cast("double")}).where("p2 > 0 and q2 > 0")
    cos = F.expr("px * qx + py * qy + pz * qz") / F.sqrt(F.col("p2") * F.col("q2"))
    both = both.withColumn("c", cos).withColumn("f2", 5.0 / 7.0 + 0.5 * F.col("c") * (F.sqrt(F.col("p2") / F.col("q2")) + F.sqrt(F.col("q2") / F.col("p2"))) + (2.0 / 7.0) * F.col("c") * F.col("c"))

    def target(a: str) -> Column:
        t = F.col(f"p{a}") + F.col(f"q{a}")
        t = F.when(t < 0, t + 1).otherwise(t)
        return F.when(t < 0, t + n).when(t >= n, t - n).otherwise(t)

    sums = both.select(*[target(a).alias(f"i{a}") for a in "xyz"], (F.col("f2") * (F.col("ra") * F.col("re") - F.col("ia") * F.col("im"))).alias("re"), (F.col("f2") * (F.col("ra") * F.col("im") + F.col("ia") * F.col("re"))).alias("im"))
    return sums.groupBy("ix", "iy", "iz").agg((F.sum("re") / n**3).alias("re"), (F.sum("im") / n**3).alias("im"))


def move(psi: DataFrame, s: Start, factor: float = 1.0) -> DataFrame:
    """(idx, x, y, z): grid points moved by factor * psi, inside the box."""
    n = s.n
    idx = (F.col("ix") * n + F.col("iy")) * n + F.col("iz")
    return psi.select(idx.alias("idx"), *[wrap(centre(F.col(f"i{a}"), n, s.box) + F.col(f"p{a}") * factor, s.box).alias(a) for a in "xyz"])


def lpt2(m: DataFrame, s: Start, how: str = "reference") -> DataFrame:
    """Positions of first and second order; the reference mode applies the growth twice (quirk Q13)."""
    d = s.growth()[0]
    first = displacement(m, s, d, how)
    second = displacement(second_order(m, s), s, 1.0, how).select("ix", "iy", "iz", *[F.col(f"p{a}").alias(f"s{a}") for a in "xyz"])
    both = first.join(second, ["ix", "iy", "iz"], "left")
    d1 = d if how == "reference" else 1.0
    return move(both.select("ix", "iy", "iz", *[(F.col(f"p{a}") * d1 + F.coalesce(f"s{a}", F.lit(0.0)) * (d * d)).alias(f"p{a}") for a in "xyz"]), s)


def subsample(grid: DataFrame, total: int, want: int) -> DataFrame:
    """Every (total // want)-th grid point, at most ``want``: the sampling operator, its limit is the feature."""
    skip = max(1, total // want)
    return grid.where((F.col("idx") % skip == 0) & (F.col("idx") < skip * want))


def resampled(grid: DataFrame, total: int, want: int, seed: int = 0) -> DataFrame:
    """(id, idx): ``want`` grid points, every (total // want)-th first; what is still missing is drawn by a hash."""
    skip = max(1, total // want)
    even = min(want, -(-total // skip))
    i = F.col("id")
    drawn = F.floor(uniform(i, seed, 77) * total).cast("long")
    return grid.sparkSession.range(want).select("id", F.when(i < even, i * skip).otherwise(drawn).alias("idx"))


def particles(spark: SparkSession, s: Start, want: int, order: int = 1, how: str = "reference", seed: int = 0) -> DataFrame:
    """(id, x, y, z, vx, vy, vz, mass): ``want`` particles of mass 1 from the grid of a start, displaced to first or second
    order, with the first-order velocities a H f times the displacement."""
    scratch = Scratch(spark, "start")
    d, rate, ah = s.growth()
    m = scratch.keep(hermitian(gaussian(spark, s, norm(spark, s)), s.n))
    psi = scratch.keep(displacement(m, s, d, how))
    at = move(psi, s) if order == 1 else lpt2(m, s, how)
    idx = (F.col("ix") * s.n + F.col("iy")) * s.n + F.col("iz")
    v = psi.select(idx.alias("idx"), *[(F.col(f"p{a}") * (ah * rate)).alias(f"v{a}") for a in "xyz"])
    points = resampled(at, s.n**3, want, seed).join(at, "idx").join(v, "idx")
    return points.select("id", "x", "y", "z", "vx", "vy", "vz", F.lit(1.0).alias("mass"))


def rms(bodies: DataFrame, s: Start) -> DataFrame:
    """(n, rms_displacement, rms_velocity) of particles whose id is their grid point, against the grid."""
    n = s.n
    at = [F.expr(f"id div {n * n}"), F.expr(f"id div {n} % {n}"), F.expr(f"id % {n}")]
    d = [min_image(F.col(a) - centre(i, n, s.box), s.box) for a, i in zip("xyz", at)]
    v = [F.col(f"v{a}") for a in "xyz"]
    square = lambda q: q[0] * q[0] + q[1] * q[1] + q[2] * q[2]
    return bodies.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(square(d))).alias("rms_displacement"), F.sqrt(F.avg(square(v))).alias("rms_velocity"))


def compare_orders(first: DataFrame, second: DataFrame, box: float) -> DataFrame:
    """(n, mean, largest): distances between the same particles displaced to first and to second order."""
    other = second.select("id", *[F.col(a).alias(f"o{a}") for a in "xyz"])
    d = [min_image(F.col(f"o{a}") - F.col(a), box) for a in "xyz"]
    r = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return first.join(other, "id").agg(F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.max(r).alias("largest"))


def check_power(spark: SparkSession, s: Start) -> DataFrame:
    """(points, positive, falling, sigma8): whether the tabulated power is positive, falls at its end, and its sigma8."""
    f = norm(spark, s)
    t = table(spark, s, f)
    last = F.max(F.when(F.col("i") == s.points - 1, F.col("p"))) < F.max("p")
    return t.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("p") > 0).alias("positive"), last.alias("falling")).withColumn("sigma8", sigma8(s) * math.sqrt(f))
