"""Queries over column functions: vectors, cosmology, theory."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from starloom.functions import cosmology as co
from starloom.functions import theory as th
from starloom.functions import vectors as ve
from starloom.operators.skew import latest
from starloom.particles import HALOS_SQL, L, PARTICLES_SQL, halo_bodies, particles
from starloom.runtime import table

C = co.Cosmology()
Z7, Z5 = [0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 10.0], [0.1, 0.5, 1.0, 2.0, 3.0]
CURVED = {"flat": C, "open": co.Cosmology(ol=0.59, ok=0.1), "closed": co.Cosmology(ol=0.79, ok=-0.1)}
K5 = [1e-3, 1e-2, 0.1, 1.0, 10.0]


def values(spark, name, xs):
    return spark.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in xs])).alias(name))


def _values_sql(name, xs):
    return f"(SELECT unnest([{', '.join(f'{x!r}::DOUBLE' for x in map(float, xs))}]) AS {name})"


def nodes_z(spark, d):
    """(halo_id, z) of the present merger nodes with a positive redshift."""
    now = latest(table(spark, d, "merger_nodes").select("halo_id", "redshift", "loaded_at"), "halo_id", "loaded_at")
    return now.where((F.col("redshift") > 0) & ~F.isnan("redshift")).select("halo_id", F.col("redshift").alias("z"))


NODES_Z = """n AS (SELECT halo_id, redshift AS z, 1.0::DOUBLE / (1.0::DOUBLE + redshift) AS a FROM (SELECT halo_id, redshift, row_number() OVER
(PARTITION BY halo_id ORDER BY loaded_at DESC) AS rn FROM merger_nodes) WHERE rn = 1 AND redshift > 0 AND NOT isnan(redshift))"""
E2 = "(0.31::DOUBLE / (a * a * a) + 0.69::DOUBLE)"
H0 = "67.0::DOUBLE"
OM, OL = f"(0.31::DOUBLE / (a * a * a) / {E2})", f"(0.69::DOUBLE / {E2})"
GROWTH = f"(a * pow({OM}, 0.6) / (pow({OM}, 0.6) + {OL} * (1.0 + {OM} / 70.0)))"


def _at_nodes(f):
    return lambda s, d: nodes_z(s, d).select("halo_id", *f(co.a_of(F.col("z"))))


def vec_ops(s, d):
    p, r, v = particles(s, d), ve.vec(), ve.vec("v")
    c = ve.cross(r, v)
    return p.select("id", ve.dot(r, v).alias("dot"), F.round(ve.length(v), 9).alias("speed"), *[c[i].alias(f"l{n}") for i, n in enumerate("xyz")])


def min_image(s, d):
    h = [F.lit(L / 2) - F.col(a) for a in "xyz"]
    e = [ve.min_image(2 * q, L) for q in h]
    return particles(s, d).select("id", *[q.alias(f"d{a}") for q, a in zip(e, "xyz")])


def wrap_box(s, d):
    df = table(s, d, "particles")
    return df.select("id", *[ve.wrap(F.when(~F.isnan(a), F.col(a)), L).alias(a) for a in "xyz"])


def cosmo_distances(s, d):
    out = None
    for name, c in CURVED.items():
        z = F.col("z")
        part = values(s, "z", Z5).select(
            F.lit(name).alias("curvature"), "z", F.round(co.comoving(c, z), 6).alias("comoving"),
            F.round(co.angular_diameter(c, z), 6).alias("angular"), F.round(co.luminosity(c, z), 6).alias("luminosity"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def _distances_sql():
    parts = []
    for name, c in CURVED.items():
        e2 = f"({c.om!r}::DOUBLE * pow(1 + u, 3) + {c.ok!r}::DOUBLE * pow(1 + u, 2) + {c.ol!r}::DOUBLE)"
        dh, r = co.C_KMS / c.h0, math.sqrt(abs(c.ok))
        t = "dc" if not c.ok else f"{dh / r!r}::DOUBLE * {'sinh' if c.ok > 0 else 'sin'}(dc * {r / dh!r}::DOUBLE)"
        parts.append(f"""SELECT '{name}' AS curvature, z, round(dc, 6) AS comoving, round({t} / (1 + z), 6) AS angular, round(({t}) * (1 + z), 6) AS luminosity
FROM (SELECT z, sum({co.C_KMS}::DOUBLE / ({H0} * sqrt({e2}))) * z / 1000 AS dc FROM (SELECT z, (i + 0.5) * z / 1000 AS u FROM {_values_sql('z', Z5)}, range(1000) t(i)) GROUP BY z)""")
    return " UNION ALL ".join(parts)


def theory_hmf(s, d):
    """Mass functions at sigma of every present halo's mass under a power law."""
    sig = F.pow(F.col("mass"), F.lit(-0.25)) * 2.0
    h = halo_bodies(s, d).withColumn("sigma", sig)
    c = F.col("sigma")
    return h.select("id", *[F.round(e, 8).alias(n) for n, e in (("ps", th.press_schechter(c)), ("st", th.sheth_tormen(c)), ("bias", th.linear_bias(c)))])


def theory_hod(s, d):
    lm = F.log10(F.col("mass") * 1e12)
    return halo_bodies(s, d).select("id", F.round(th.centrals(lm, 12.0, 0.3), 9).alias("centrals"), F.round(th.satellites(lm, 12.0, 13.0, 1.0), 9).alias("satellites"))


def theory_bbks(s, d):
    k = F.col("k")
    return values(s, "k", K5).select("k", F.round(th.bbks(k / (0.31 * 0.67)), 10).alias("transfer"))


_BB = "(ln(1 + 2.34 * q) / (2.34 * q) * pow(1 + 3.89 * q + pow(16.1 * q, 2) + pow(5.46 * q, 3) + pow(6.71 * q, 4), -0.25))"
_LNK = "ln(1e-4) + (i + 0.5) * (ln(1e2) - ln(1e-4)) / 1000"
_TH = "(3 * (sin(x) - x * cos(x)) / (x * x * x))"
_D0 = "(SELECT a * pow(m, 0.6) / (pow(m, 0.6) + l * (1 + m / 70.0)) FROM (SELECT 1.0::DOUBLE AS a, 0.31::DOUBLE AS m, 0.69::DOUBLE AS l))"


def _eh():
    c = {k: f"{v!r}::DOUBLE" for k, v in th.eh_scales(0.31, 0.049, 0.67).items()}
    return f"""SELECT k, round(pow(k, 0.965) * t * t * 0.6561 / 0.8 * 1e6, 6) AS power FROM (SELECT k, {c['fb']} * (s * f + {c['alpha']} * exp(-pow(ks / {c['beta']}, 1.4)) * (1 - f)) / (1 + pow(ks / 5.2, 2)) + (1 - {c['fb']}) * s AS t
FROM (SELECT k, ks, ln(1.8 * q) / (ln(1.8 * q) + pow(14.2 * q, 2)) AS s, 1 / (1 + pow(ks / 5.4, 4)) AS f FROM (SELECT k, k / (13.41 * {c['keq']}) AS q, k * {c['sound']} AS ks FROM {_values_sql('k', K5)})))"""


QUERIES = {
    "vec_ops": vec_ops,
    "min_image": min_image,
    "wrap_box": wrap_box,
    "cosmo_hubble": _at_nodes(lambda a: [F.round(co.hubble(C, a), 6).alias("h")]),
    "cosmo_adot": _at_nodes(lambda a: [F.round(co.adot(C, a), 6).alias("adot")]),
    "cosmo_addot": _at_nodes(lambda a: [F.round(co.addot(C, a), 4).alias("addot")]),
    "cosmo_growth": _at_nodes(lambda a: [F.round(co.growth(C, a), 9).alias("growth"), F.round(co.growth_rate(C, a), 9).alias("rate"), F.round(co.omega_m(C, a), 9).alias("om"), F.round(co.omega_l(C, a), 9).alias("ol")]),
    "cosmo_distances": cosmo_distances,
    "cosmo_linspace": lambda s, d: co.linspace(s, 0.25, 1.0, 13),
    "cosmo_conformal": lambda s, d: values(s, "a", [0.25, 0.5, 1.0]).select("a", F.round(co.conformal(C, F.col("a")), 6).alias("as_published"), F.round(co.conformal(C, F.col("a"), False), 6).alias("mpc")),
    "cosmo_age": lambda s, d: values(s, "z", Z7).select("z", F.round(co.age(C, co.a_of(F.col("z"))), 6).alias("age")),
    "cosmo_bbks_pk": lambda s, d: values(s, "k", K5).select("k", F.round(co.power(C, F.col("k"), F.lit(0.0)) * 1e6, 8).alias("power")),
    "cosmo_sigma_r": lambda s, d: values(s, "r", [4.0, 8.0, 16.0]).select("r", F.round(co.variance(C, F.col("r")) * 1e9, 6).alias("variance")),
    "cosmo_summary": lambda s, d: co.summary(s, C),
    "cosmo_scale_evolve": lambda s, d: values(s, "n", [1, 5, 20]).select(F.col("n").cast("int").alias("n"), F.round(co.evolve(C, 0.02, F.lit(1e-4), F.col("n").cast("int")), 10).alias("a")),
    "theory_windows": lambda s, d: values(s, "x", [1e-8, 0.1, 1.0, 3.0, 10.0]).select("x", F.round(th.tophat(F.col("x")), 9).alias("tophat"), F.round(th.gaussian(F.col("x")), 9).alias("gaussian")),
    "theory_growth": lambda s, d: nodes_z(s, d).select("halo_id", F.round(th.cpt_growth(F.col("z"), 0.31, 0.69), 9).alias("growth")),
    "theory_eh_pk": lambda s, d: values(s, "k", K5).select("k", F.round(th.eh_power(F.col("k"), 0.31, 0.049, 0.67, 0.965, 0.81) * 1e6, 6).alias("power")),
    "theory_bbks": theory_bbks,
    "theory_hmf": theory_hmf,
    "theory_hod": theory_hod,
    "window_kernels": lambda s, d: values(s, "k", [0.0, 0.1, 0.5, 1.0]).select("k", *[F.round(th.grid_window(F.col("k"), 2.0, o), 9).alias(n) for o, n in ((1, "ngp"), (2, "cic"), (3, "tsc"))]),
}

_ERF = "1.0"
for _i in range(th.TERMS, 0, -1):
    _ERF = f"(1 + 2 * e * e / {2 * _i + 1} * {_ERF})"
_ERF = f"(2 / sqrt(pi()) * e * exp(-e * e) * {_ERF})"

SQL = {
    "vec_ops": f"WITH {PARTICLES_SQL} SELECT id, x * vx + y * vy + z * vz AS dot, round(sqrt(vx * vx + vy * vy + vz * vz), 9) AS speed, y * vz - z * vy AS lx, z * vx - x * vz AS ly, x * vy - y * vx AS lz FROM p",
    "min_image": f"WITH {PARTICLES_SQL} SELECT id, " + ", ".join(f"CASE WHEN 2 * (500 - {a}) > 500 THEN 2 * (500 - {a}) - 1000 WHEN 2 * (500 - {a}) < -500 THEN 2 * (500 - {a}) + 1000 ELSE 2 * (500 - {a}) END AS d{a}" for a in "xyz") + " FROM p",
    "wrap_box": "SELECT id, " + ", ".join(f"CASE WHEN NOT isnan({a}) THEN {a} - 1000.0::DOUBLE * floor({a} / 1000.0::DOUBLE) END AS {a}" for a in "xyz") + " FROM particles",
    "cosmo_hubble": f"WITH {NODES_Z} SELECT halo_id, round({H0} * sqrt({E2}), 6) AS h FROM n",
    "cosmo_adot": f"WITH {NODES_Z} SELECT halo_id, round(a * ({H0} * sqrt({E2})), 6) AS adot FROM n",
    "cosmo_addot": f"WITH {NODES_Z}, c AS (SELECT 3.0::DOUBLE * pow({H0}, 2) / (8 * pi() * 4.3009e-9) AS crit) SELECT halo_id, round(-4 * pi() * 4.3009e-9 / 3 * a * (0.31::DOUBLE * crit / (a * a * a) - 2 * 0.69::DOUBLE * crit), 4) AS addot FROM n, c",
    "cosmo_growth": f"WITH {NODES_Z} SELECT halo_id, round({GROWTH}, 9) AS growth, round(pow({OM}, 0.55), 9) AS rate, round({OM}, 9) AS om, round({OL}, 9) AS ol FROM n",
    "cosmo_distances": _distances_sql(),
    "cosmo_linspace": "SELECT CAST(i AS INT) AS i, 0.25::DOUBLE + i * (0.75::DOUBLE / 12) AS a FROM range(13) t(i)",
    "cosmo_conformal": f"""SELECT a, round(s * a / 1000 * {co.C_KMS}::DOUBLE / {H0}, 6) AS as_published, round(s * a / 1000 * {co.C_KMS}::DOUBLE, 6) AS mpc FROM (SELECT a, sum(1 / ({H0} * sqrt(0.31::DOUBLE / (u * u * u) + 0.69::DOUBLE) * u * u)) AS s
FROM (SELECT a, (i + 0.5) * a / 1000 AS u FROM {_values_sql('a', [0.25, 0.5, 1.0])}, range(1000) t(i)) GROUP BY a)""",
    "cosmo_age": f"""SELECT z, round(sum(1 / (sqrt(0.31::DOUBLE / (u * u * u) + 0.69::DOUBLE) * u)) / (1 + z) / 1000 * 9.778::DOUBLE / 0.67::DOUBLE, 6) AS age FROM (SELECT z, (i + 0.5) / (1 + z) / 1000 AS u FROM {_values_sql('z', Z7)}, range(1000) t(i)) GROUP BY z""",
    "cosmo_bbks_pk": f"SELECT k, round(pow(k / 0.05, -0.035) * {_BB} * {_BB} * {_D0} * {_D0} * 1e6, 8) AS power FROM (SELECT k, k / (0.31::DOUBLE * 0.67 * 0.67) AS q FROM {_values_sql('k', K5)})",
    "cosmo_sigma_r": f"""SELECT r, round(sum(pow(k / 0.05, -0.035) * {_BB} * {_BB} * {_D0} * {_D0} * {_TH} * {_TH} * k * k * k / (2 * pi() * pi())) * (ln(1e2) - ln(1e-4)) / 1000 * 1e9, 6) AS variance FROM
(SELECT r, k, k * r AS x, k / (0.31::DOUBLE * 0.67 * 0.67) AS q FROM (SELECT r, exp({_LNK}) AS k FROM {_values_sql('r', [4, 8, 16])}, range(1000) t(i))) GROUP BY r""",
    "cosmo_summary": f"""SELECT 0.31::DOUBLE AS omega_m, 0.69::DOUBLE AS omega_l, 0.0::DOUBLE AS omega_k, {H0} AS h0, round((SELECT sum(1 / (sqrt(0.31::DOUBLE / (u * u * u) + 0.69::DOUBLE) * u)) / 1000 * 9.778::DOUBLE / 0.67::DOUBLE FROM (SELECT (i + 0.5::DOUBLE) / 1000 AS u FROM range(1000) t(i))), 6) AS age_gyr, round({_D0}, 8) AS growth_today""",
    "cosmo_scale_evolve": f"WITH RECURSIVE e AS (SELECT 0 AS n, 0.02::DOUBLE AS a UNION ALL SELECT n + 1, a + a * ({H0} * sqrt({E2})) * 1e-4 FROM e WHERE n < 20) SELECT n, round(a, 10) AS a FROM e WHERE n IN (1, 5, 20)",
    "theory_windows": f"SELECT x, round(CASE WHEN x < 1e-6 THEN 1 ELSE {_TH} END, 9) AS tophat, round(exp(-x * x / 2), 9) AS gaussian FROM {_values_sql('x', [1e-8, 0.1, 1, 3, 10])}",
    "theory_growth": f"WITH {NODES_Z} SELECT halo_id, round(a * 2.5 * {OM} / (pow({OM}, 4.0::DOUBLE / 7) - {OL} + (1 + {OM} / 2) * (1 + {OL} / 70)), 9) AS growth FROM n",
    "theory_eh_pk": _eh(),
    "theory_bbks": f"SELECT k, round({_BB}, 10) AS transfer FROM (SELECT k, k / (0.31::DOUBLE * 0.67) AS q FROM {_values_sql('k', K5)})",
    "theory_hmf": f"""WITH {HALOS_SQL}, s AS (SELECT id, pow(mass, -0.25) * 2 AS s FROM p), n AS (SELECT id, s, 1.686 / s AS nu, 0.707 * 1.686 * 1.686 / (s * s) AS n2 FROM s)
SELECT id, round(sqrt(2 / pi()) * nu * exp(-nu * nu / 2), 8) AS ps, round(0.3222 * sqrt(2 * 0.707 / pi()) * (1 + pow(n2, -0.3)) * nu * exp(-n2 / 2), 8) AS st, round(1 + (nu * nu - 1) / 1.686, 8) AS bias FROM n""",
    "theory_hod": f"""WITH {HALOS_SQL}, m AS (SELECT id, log10(mass * 1e12::DOUBLE) AS lm FROM p), e AS (SELECT *, least(abs((lm - 12) / 0.3::DOUBLE), 6) AS e, CASE WHEN lm < 12 THEN -1 ELSE 1 END AS s FROM m)
SELECT id, round((1 + s * {_ERF}) / 2, 9) AS centrals, round(CASE WHEN pow(10.0::DOUBLE, lm) > 1e12 THEN (pow(10.0::DOUBLE, lm) - 1e12) / 1e13 ELSE 0 END, 9) AS satellites FROM e""",
    "window_kernels": f"SELECT k, round(s, 9) AS ngp, round(s * s, 9) AS cic, round(s * s * s, 9) AS tsc FROM (SELECT k, CASE WHEN k < 1e-6 THEN 1 ELSE sin(k) / k END AS s FROM {_values_sql('k', [0, 0.1, 0.5, 1])})",
}
