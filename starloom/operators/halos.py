"""Halo catalogues: friends of friends, properties, mass function, spherical overdensity, links over time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.vectors import min_image
from starloom.operators.friends import groups, linked
from starloom.operators.graph import connected_components
from starloom.operators.skew import lookup
from starloom.operators.spatial import neighbour_pairs
from starloom.runtime import Scratch


def fof_members(df: DataFrame, link: float, box: float, least: int) -> DataFrame:
    """(halo_id, id) of connected sets of at least ``least`` records; halo_id is the smallest id.

    True connected components (quirk Q2 is not reproduced). Cells of a clump are connected as cells, so no pair of
    records within a cell becomes a row; only boxes under seven linking lengths wide take the pairs themselves.
    """
    scratch = Scratch(df.sparkSession, "fof")
    if box < 7 * link:
        pairs = neighbour_pairs(df, link, box).select(F.col("id1").alias("u"), F.col("id2").alias("v"))
        alone = df.select(F.col("id").alias("u"), F.col("id").alias("v"))
        labels = connected_components(pairs.unionByName(alone), scratch).select("label", "id")
        named = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).where(F.col("size") >= least)
        return labels.join(named, "label").select(F.col("first").alias("halo_id"), "id")
    once, named = groups(*linked(df.select("id", "x", "y", "z"), link, box, scratch), max(2, least), scratch)
    found = once.join(named, "label").select(F.col("first").alias("halo_id"), "id")
    if least <= 1:
        return df.select("id").join(found, "id", "left").select(F.coalesce("halo_id", "id").alias("halo_id"), "id")
    return found


def properties(members: DataFrame, particles: DataFrame, box: float | None = None) -> DataFrame:
    """Mass, centre, mean velocity, virial radius, peak circular velocity, angular momentum and spin per halo.

    Two aggregations, the second about the centre of mass; both merge on the map side. With ``box`` positions
    are first unwrapped around the halo's first member; without it they are taken as they are (quirk Q3).
    """
    rows = members.join(particles, "id")
    if box is not None:
        first = rows.groupBy("halo_id").agg(F.min(F.struct("id", "x", "y", "z")).alias("f"))
        rows = lookup(rows, first, "halo_id", how="inner")
        rows = rows.withColumns({a: F.col(f"f.{a}") + min_image(F.col(a) - F.col(f"f.{a}"), box) for a in "xyz"}).drop("f")
    m = F.col("mass")
    mass = F.when(F.sum("mass") > 0, F.sum("mass"))
    centre = rows.groupBy("halo_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mtot"), *[(F.sum(m * F.col(a)) / mass).alias(f"com{a}") for a in "xyz"], *[(F.sum(m * F.col(f"v{a}")) / mass).alias(f"cv{a}") for a in "xyz"]
    )
    about = lookup(rows, centre, "halo_id", how="inner")
    r = [F.col(a) - F.col(f"com{a}") for a in "xyz"]
    v = [F.col(f"v{a}") - F.col(f"cv{a}") for a in "xyz"]
    about = about.select("halo_id", "n", "mtot", *[f"com{a}" for a in "xyz"], *[f"cv{a}" for a in "xyz"], m.alias("m"), *[e.alias(f"r{a}") for e, a in zip(r, "xyz")], *[e.alias(f"w{a}") for e, a in zip(v, "xyz")])
    rr = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz"))
    spin = [F.sum(F.col("m") * (F.col(f"r{b}") * F.col(f"w{c}") - F.col(f"r{c}") * F.col(f"w{b}"))).alias(f"l{a}") for a, b, c in ("xyz", "yzx", "zxy")]
    out = about.groupBy("halo_id", "n", "mtot", *[f"com{a}" for a in "xyz"], *[f"cv{a}" for a in "xyz"]).agg(F.coalesce(F.max(F.when(rr > 0, F.sqrt(F.col("mtot") / rr))), F.lit(0.0)).alias("v_max"), *spin)
    out = out.withColumn("r_vir", virial_radius(F.col("mtot")))
    size = F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly") + F.col("lz") * F.col("lz"))
    down = F.lit(math.sqrt(2.0)) * F.col("mtot") * F.col("v_max") * F.col("r_vir")
    return out.withColumn("spin", F.when(down > 0, size / down).otherwise(0.0))


def virial_radius(mass: Column, delta: float = 200.0, rho: float = 1.0) -> Column:
    return F.pow(mass * (3.0 / (4.0 * math.pi * delta * rho)), F.lit(1.0 / 3.0))


def mass_function(halos: DataFrame, mass: str, edges: list[float], volume: float) -> DataFrame:
    """(bin, lo, hi, n, density): halos in [lo, hi) per mass and volume; empty bins have 0."""
    spark = halos.sparkSession
    bins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double")
    at = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:])))):
        at = F.when((F.col(mass) >= a) & (F.col(mass) < b), F.lit(i)).otherwise(at)
    n = halos.select(at.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    out = bins.join(n, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("density", F.col("n") / ((F.col("hi") - F.col("lo")) * volume))


def enclosed(centres: DataFrame, particles: DataFrame, radius: float, box: float | None = None) -> DataFrame:
    """(halo_id, n, m_in): mass within ``radius`` (or the column r, at most ``radius``) of each centre.

    A cell join: centres go to the 27 cells around them, so neither side is broadcast.
    """
    own = "r" in centres.columns
    cell = [F.floor(F.col(a) / radius).cast("long") for a in "xyz"]
    c = centres.select("halo_id", *[F.col(f"com{a}").alias(f"q{a}") for a in "xyz"], (F.col("r") if own else F.lit(radius)).alias("r"))
    near = c.select("*", F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("dx", "dy", "dz"), (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])).alias("o"))
    n = None if box is None else max(1, int(box / radius))
    if n is not None:
        cell = [F.least(F.floor(F.col(a) * (n / box)).cast("long"), F.lit(n - 1)) for a in "xyz"]
        keys = [F.pmod(F.least(F.floor(F.col(f"q{a}") * (n / box)).cast("long"), F.lit(n - 1)) + F.col(f"o.d{a}").cast("long"), F.lit(n)) for a in "xyz"]
    else:
        keys = [(F.floor(F.col(f"q{a}") / radius) + F.col(f"o.d{a}")).cast("long") for a in "xyz"]
    near = near.select("halo_id", "qx", "qy", "qz", "r", *[k.alias(f"k{a}") for k, a in zip(keys, "xyz")]).distinct()
    pts = particles.select("x", "y", "z", "mass", *[k.alias(f"k{a}") for k, a in zip(cell, "xyz")])
    d = [F.col(a) - F.col(f"q{a}") if box is None else min_image(F.col(a) - F.col(f"q{a}"), box) for a in "xyz"]
    inside = near.join(pts, ["kx", "ky", "kz"]).where(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= F.col("r"))
    return inside.groupBy("halo_id").agg(F.count(F.lit(1)).alias("n_in"), F.sum("mass").alias("m_in"))


def _reachable(steps: int) -> np.ndarray:
    """All factors that up to ``steps`` multiplications by 0.9 or 1.1 can make."""
    return np.unique(np.array([0.9**i * 1.1**j for i in range(steps + 1) for j in range(steps + 1 - i)]))


def so_radii(halos: DataFrame, particles: DataFrame, density: float, factor: float = 200.0, reach: float = 2.0, steps: int = 50) -> DataFrame:
    """(halo_id, r_so, m_so): radius at which the mean density within is ``factor`` times ``density``, by up to 50
    steps of 0.9 and 1.1, or to one percent, starting at r_vir.

    Only r_vir times a known set of factors can be tried, so masses are first summed into the shells between
    those radii, merged on the map side; the search then reads at most as many shells a halo as there are factors.
    Particles are joined within ``reach`` times r_vir. Halos whose search leaves that radius are searched again
    within the largest one that 50 steps can reach, so the bound costs nothing in exactness.
    """
    target, widest, radii = factor * density, 1.1**steps, _reachable(steps)

    @F.pandas_udf("int")
    def shell(d: pd.Series, r0: pd.Series) -> pd.Series:  # a distance equal to a radius, but for rounding, is within it
        return pd.Series(np.searchsorted(radii * (1 + 1e-12), d.to_numpy() / r0.to_numpy()).astype(np.int32))

    def search(some: DataFrame, bound: float) -> DataFrame:
        limit = F.greatest(F.col("r_vir") * bound, F.lit(1e-9))
        near = enclosed_distances(some.select("halo_id", "comx", "comy", "comz", "r_vir", limit.alias("r")), particles)
        sums = near.where("r_vir > 0").select("halo_id", shell("d", "r_vir").alias("shell"), "mass").groupBy("halo_id", "shell").agg(F.sum("mass").alias("mass"))
        alone = some.select("halo_id", F.lit(len(radii)).alias("shell"), F.lit(0.0).alias("mass"))
        rows = sums.unionByName(alone).join(some.select("halo_id", F.col("r_vir").alias("r0")), "halo_id")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            m = np.cumsum(np.bincount(pdf["shell"], pdf["mass"], len(radii) + 1))
            r0 = float(pdf["r0"].iloc[0])

            def within(x: float) -> float:
                return float(m[min(np.searchsorted(radii, x * (1 - 1e-9)), len(radii))])

            f = most = 1.0
            for _ in range(steps if r0 > 0 else 0):
                rho = within(f) / (4.0 / 3.0 * math.pi * (r0 * f) ** 3)
                if abs(rho - target) / target < 0.01:
                    break
                f *= 0.9 if rho > target else 1.1
                most = max(most, f)
            return pd.DataFrame({"halo_id": [int(pdf["halo_id"].iloc[0])], "r_so": [r0 * f], "m_so": [within(f) if r0 > 0 else 0.0], "left": [bool(most > bound)]})

        return rows.groupBy("halo_id").applyInPandas(run, "halo_id bigint, r_so double, m_so double, left boolean")

    scratch = Scratch(halos.sparkSession, "radii")
    first = scratch.keep(search(halos, reach))
    again = halos.join(first.where("left").select("halo_id"), "halo_id", "left_semi")
    return first.where("not left").unionByName(search(again, widest)).drop("left")


def enclosed_distances(centres: DataFrame, particles: DataFrame) -> DataFrame:
    """(halo_id, d, mass, and the other columns of the centres but their place) of the particles within each centre's own
    radius r. Radii are rounded up to powers of two, and a centre meets the particles in cells of that side: at
    most 27 cells whatever its radius. Particles have one copy for each power that occurs, of which there are few."""
    power = F.ceil(F.log2("r")).cast("int")
    leveled = centres.withColumn("k", power)
    powers = [r[0] for r in leveled.select("k").distinct().collect()]
    if not powers:
        powers = [0]
    side = F.pow(F.lit(2.0), F.col("k").cast("double"))
    c = leveled
    for a in "xyz":
        c = c.withColumn(f"k{a}", F.explode(F.sequence(*[F.floor((F.col(f"com{a}") + s * F.col("r")) / side).cast("long") for s in (-1, 1)])))
    pts = particles.select("x", "y", "z", "mass", F.explode(F.array(*[F.lit(p) for p in powers])).alias("k"))
    pts = pts.select("*", *[F.floor(F.col(a) / side).cast("long").alias(f"k{a}") for a in "xyz"])
    d = [F.col(a) - F.col(f"com{a}") for a in "xyz"]
    both = c.join(pts, ["k", "kx", "ky", "kz"]).withColumn("d", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    rest = [x for x in centres.columns if x not in ("comx", "comy", "comz", "r")]
    return both.where(F.col("d") <= F.col("r")).select(*rest, "d", "mass")


def nfw_fit(members: DataFrame, particles: DataFrame, centres: DataFrame, box: float | None = None) -> DataFrame:
    """(halo_id, n, beyond, r_max, rs, concentration, rms): NFW profile fitted to each halo's cumulative mass by grid
    search over the concentration r_vir / rs.

    The profile reaches to the outermost member, r_max; ``beyond`` of the members lie outside r_vir, a column of
    ``centres``. With ``box`` distances are periodic. They are first counted into 64 shells a halo, so a halo of any
    size is a bounded group.
    """
    shells = 64
    rows = lookup(members.join(particles.select("id", "x", "y", "z", "mass"), "id"), centres.select("halo_id", "comx", "comy", "comz", "r_vir"), "halo_id", how="inner")
    d = [F.col(a) - F.col(f"com{a}") for a in "xyz"]
    d = d if box is None else [min_image(q, box) for q in d]
    rows = rows.select("halo_id", "r_vir", "mass", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d"))
    rows = lookup(rows, rows.groupBy("halo_id").agg(F.max("d").alias("r_max")), "halo_id", how="inner")
    shell = F.when(F.col("r_max") > 0, F.least(F.floor(F.col("d") / F.col("r_max") * shells), F.lit(shells - 1))).otherwise(0).cast("int")
    prof = rows.withColumn("shell", shell).groupBy("halo_id", "r_vir", "r_max", "shell").agg(F.sum("mass").alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > F.col("r_vir")).alias("beyond"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros(shells)
        m[pdf["shell"].to_numpy()] = pdf["m"].to_numpy()
        size, r_max = float(pdf["r_vir"].iloc[0]), float(pdf["r_max"].iloc[0])
        r = (np.arange(shells) + 1.0) / shells * (r_max or size) / size
        m = np.cumsum(m) / max(m.sum(), 1e-300)
        best = (np.inf, 1.0)
        for c in np.geomspace(0.5, 50.0, 60):
            mu = np.log1p(c * r) - c * r / (1 + c * r)
            best = min(best, (float(np.sqrt(np.mean((m - mu / mu[-1]) ** 2))), float(c)))
        row = {"halo_id": int(pdf["halo_id"].iloc[0]), "n": int(pdf["n"].sum()), "beyond": int(pdf["beyond"].sum()), "r_max": r_max, "rs": size / best[1], "concentration": best[1], "rms": best[0]}
        return pd.DataFrame([row])

    return prof.groupBy("halo_id").applyInPandas(run, "halo_id bigint, n bigint, beyond bigint, r_max double, rs double, concentration double, rms double")


def merger_links(membership: DataFrame) -> DataFrame:
    """(snap, halo_id, next_halo, shared): for every halo of a snapshot the halo of the next one that shares
    most members, ties to the smaller id.

    Memberships are joined on (id, snap), at most a few rows each, so a hot halo is spread over its members.
    """
    m = membership.where((F.col("halo_id") > 0) & F.col("id").isNotNull() & F.col("snap").isNotNull()).select("halo_id", "id", "snap").distinct()
    after = m.select("id", (F.col("snap") - 1).alias("snap"), F.col("halo_id").alias("next_halo"))
    shared = m.join(after, ["id", "snap"]).groupBy("snap", "halo_id", "next_halo").agg(F.count(F.lit(1)).alias("shared"))
    w = Window.partitionBy("snap", "halo_id").orderBy(F.col("shared").desc(), "next_halo")
    return shared.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
