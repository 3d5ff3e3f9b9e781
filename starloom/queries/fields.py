"""Queries over grids, spectra and initial conditions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from starloom.operators import grid as gr
from starloom.operators import initial as ic
from starloom.operators import spectrum as ps
from starloom.particles import L, PARTICLES_SQL, particles
from starloom.queries.scalars import _BB, values, _values_sql
from starloom.runtime import Scratch
from starloom.queries.system import uniform_sql

N = 16
S = ic.Start()
D, RATE, AH = S.growth()


def _delta(s, d, weight=None):
    return gr.contrast(gr.assign_ngp(particles(s, d), N, L, weight), N)


def _modes(s, d, weight=None):
    return ps.modes(_delta(s, d, weight), N)


def _spectrum(s, d):
    return ps.spectrum(_modes(s, d), N, L)


def _r(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in df.columns])


def ps_cross(s, d):
    return _r(ps.cross(_modes(s, d), _modes(s, d, F.lit(1.0)), N, L), k=9, power=2)


def ps_multipoles(s, d):
    """Redshift space: z displaced by the line-of-sight velocity over 100."""
    p = particles(s, d).withColumn("z", F.col("z") + F.col("vz") / 100.0)
    m = ps.modes(gr.contrast(gr.assign_ngp(p, N, L), N), N)
    return _r(ps.multipoles(m, N, L), k=9, p0=2, p2=2, p4=2)


def _field(s):
    return ic.hermitian(ic.gaussian(s, S, ic.norm(s, S)), S.n)


def ic_rms(s, d):
    m = _field(s)
    psi = ic.displacement(m, S, D)
    p2 = F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz")
    return psi.agg(F.round(F.sqrt(F.avg(p2)), 4).alias("rms_displacement"), F.round(F.sqrt(F.avg(p2)) * (AH * RATE), 2).alias("rms_velocity"))


QUERIES = {
    "grid_cic": lambda s, d: _r(gr.assign_cic(particles(s, d), N, L), rho=6),
    "grid_ngp": lambda s, d: gr.assign_ngp(particles(s, d), N, L),
    "grid_delta": lambda s, d: _r(_delta(s, d), delta=8),
    "grid_coords": lambda s, d: gr.cells(s, 8).select("idx", *[gr.centre(F.col(f"i{a}"), 8, 64.0).alias(a) for a in "xyz"], *[gr.mode(F.col(f"i{a}"), 8).alias(f"k{a}") for a in "xyz"]),
    "power_spectrum": lambda s, d: _r(_spectrum(s, d), k=9, power=2),
    "ps_error_rows": lambda s, d: _r(ps.with_errors(_spectrum(s, d)), k=9, power=2, error=2),
    "ps_sigma8": lambda s, d: _r(ps.sigma(_spectrum(s, d), 8.0, L), as_published=8, sigma=8),
    "ps_cross": ps_cross,
    "ps_multipoles": ps_multipoles,
    "ps_neff": lambda s, d: _r(ps.slope(_spectrum(s, d)), k=9, n_eff=6),
    "ic_pk_table": lambda s, d: ic.table(s, S).select("i", F.round("k", 9).alias("k"), F.round(F.col("p") * 1e6, 4).alias("p")),
    "ic_sigma8": lambda s, d: s.range(1).select(F.round(ic.sigma8(S), 9).alias("sigma8")),
    "ic_pk_norm": lambda s, d: ic.table(s, S, ic.norm(s, S)).select("i", F.round(F.col("p"), 6).alias("p")),
    "ic_pk_interp": lambda s, d: values(s, "k", [1e-4, 2e-3, 0.05, 0.31, 7.7, 500.0]).select("k", F.round(ic.interpolated(S, F.col("k")) * 1e6, 6).alias("p")),
    "ic_gaussian_field": lambda s, d: _r(ic.gaussian(s, S, ic.norm(s, S)), re=4, im=4),
    "ic_hermitian": lambda s, d: _r(_field(s), re=4, im=4),
    "ic_displacement": lambda s, d: _r(ic.displacement(_field(s), S, D), px=6, py=6, pz=6),
    "ic_velocity": lambda s, d: _r(ic.displacement(_field(s), S, D * AH * RATE), px=3, py=3, pz=3),
    "ic_zeldovich": lambda s, d: _r(ic.move(ic.displacement(_field(s), S, D, "physical"), S), x=6, y=6, z=6),
    "ic_2lpt": lambda s, d: _r(ic.lpt2(_field(s), S), x=4, y=4, z=4),
    "ic_2lpt_kernel": lambda s, d: _r(ic.second_order(_field(s), S), re=2, im=2),
    "ic_rms": ic_rms,
    "ic_particles": lambda s, d: _r(ic.particles(s, S, 600), **{a: 6 for a in "xyz"}, **{f"v{a}": 3 for a in "xyz"}),
    "ic_statistics": lambda s, d: _r(ic.rms(ic.particles(s, S, 512), S), rms_displacement=6, rms_velocity=4),
    "ic_orders": lambda s, d: _r(ic.compare_orders(*[ic.particles(s, S, 512, o) for o in (1, 2)], S.box), mean=5, largest=5),
    "ic_power_check": lambda s, d: _r(ic.check_power(s, S), sigma8=9),
    "ic_subsample": lambda s, d: ic.subsample(gr.cells(s, 8), 512, 100),
}

_G = f"WITH {PARTICLES_SQL}, i AS (SELECT *, x * 0.016::DOUBLE AS gx, y * 0.016::DOUBLE AS gy, z * 0.016::DOUBLE AS gz FROM p)"


def _ngp(weight="mass", z="z * 0.016::DOUBLE"):
    return f"SELECT CAST(floor(x * 0.016::DOUBLE) AS INT) % 16 AS ix, CAST(floor(y * 0.016::DOUBLE) AS INT) % 16 AS iy, (CAST(floor({z}) AS INT) % 16 + 16) % 16 AS iz, sum({weight}) AS rho FROM p GROUP BY 1, 2, 3"


def _delta_sql(tag, ngp):
    return f"""r{tag} AS ({ngp}), c{tag} AS (SELECT CAST(a.i AS INT) AS ix, CAST(b.i AS INT) AS iy, CAST(e.i AS INT) AS iz FROM range(16) a(i), range(16) b(i), range(16) e(i)),
d{tag} AS (SELECT c.ix, c.iy, c.iz, CASE WHEN m > 0 THEN (coalesce(rho, 0) - m) / m ELSE 0 END AS delta FROM c{tag} c LEFT JOIN r{tag} r USING (ix, iy, iz), (SELECT sum(rho) / 4096 AS m FROM r{tag}))"""


def _dft_sql(tag, src, n, sign="-", down=True):
    out, prev = [], src
    for j, a in enumerate("xyz"):
        o = [f"i{b}" for b in "xyz" if b != a]
        ang = f"({sign}2 * pi() / {n} * ((k.i * i{a}) % {n}))"
        out.append(f"""f{tag}{j} AS (SELECT CAST(k.i AS INT) AS i{a}, {', '.join(o)}, sum(re * cos({ang}) - im * sin({ang})) AS re, sum(re * sin({ang}) + im * cos({ang})) AS im FROM {prev}, range({n}) k(i) GROUP BY 1, 2, 3)""")
        prev = f"f{tag}{j}"
    by = f" / {n**3}.0::DOUBLE" if down else ""
    out.append(f"m{tag} AS (SELECT ix, iy, iz, re{by} AS re, im{by} AS im FROM {prev})")
    return ", ".join(out)


def _mode(e, n):
    return f"(CASE WHEN {e} <= {n // 2} THEN {e} ELSE {e} - {n} END)"


def _bins(src):
    k2 = " + ".join(f"{_mode('i' + a, 16)} * {_mode('i' + a, 16)}" for a in "xyz")
    return f"b AS (SELECT *, CAST(floor(sqrt(k2)) AS INT) AS bin, CAST({_mode('iz', 16)} * {_mode('iz', 16)} AS DOUBLE) / k2 AS mu2 FROM (SELECT *, {k2} AS k2 FROM {src}) WHERE k2 > 0 AND floor(sqrt(k2)) < 8)"


_MODES = f"WITH {PARTICLES_SQL}, {_delta_sql('1', _ngp())}, s1 AS (SELECT ix, iy, iz, delta AS re, 0.0::DOUBLE AS im FROM d1), {_dft_sql('1', 's1', 16)}"
_DK = "(2 * pi() / 1000)"
_PS = f"{_MODES}, {_bins('m1')}, q AS (SELECT bin, (bin + 0.5) * {_DK} AS k, avg(re * re + im * im) * 1e9 - 1e9 / 4096 AS power, count(*) AS modes FROM b GROUP BY bin)"
_TH = "(3 * (sin(k * 8) - k * 8 * cos(k * 8)) / pow(k * 8, 3))"
_LK0, _ST = math.log(S.k_min), S.step


def _raw(k):
    return f"(SELECT pow(kk, 0.965) * {_BB} * {_BB} FROM (SELECT kk, kk / (0.31::DOUBLE * 0.67::DOUBLE) AS q FROM (SELECT {k} AS kk)))"


def _rawx(k):
    q = f"({k} / (0.31::DOUBLE * 0.67::DOUBLE))"
    b = _BB.replace("q", q)
    return f"(pow({k}, 0.965) * {b} * {b})"


def _interp(src, cols):
    """A subquery that adds p, the interpolated power, to src's k."""
    one = f"SELECT {cols}, k, (ln(k) - {_LK0!r}::DOUBLE) / {_ST!r}::DOUBLE AS t FROM {src}"
    two = f"SELECT *, least(greatest(floor(t), 0), 998) AS i FROM ({one})"
    three = f"SELECT *, least(greatest(t - i, 0), 1) AS f, exp({_LK0!r}::DOUBLE + i * {_ST!r}::DOUBLE) AS ka, exp({_LK0!r}::DOUBLE + (i + 1) * {_ST!r}::DOUBLE) AS kb FROM ({two})"
    return f"(SELECT {cols}, k, exp(ln({_rawx('ka')}) + (ln({_rawx('kb')}) - ln({_rawx('ka')})) * f) AS p FROM ({three}))"


_S8 = f"""(SELECT sqrt(sum(p * {_TH} * {_TH} * k * k * k) * (ln(1e2) - ln(1e-3)) / 1000 / (2 * pi() * pi())) FROM {_interp('(SELECT 1 AS one, exp(ln(1e-3) + (i + 0.5) * (ln(1e2) - ln(1e-3)) / 1000) AS k FROM range(1000) t(i))', 'one')})"""


def _noise(c):
    parts = []
    for j in range(4 * c + 1, 4 * c + 5):
        h = f"((ix * {7919 * j + 13} + iy * {10473 * j + 7} + iz * {12997 * j + 3} + {31 * j * j}) % {ic.NOISE})"
        parts.append(f"(({h} * {h} * 7 + {h} * {j}) % {ic.NOISE}) / {ic.NOISE}.0::DOUBLE")
    return f"(({' + '.join(parts)} - 2) * sqrt(3::DOUBLE))"


_K2 = " + ".join(f"{_mode('i' + a, 8)} * {_mode('i' + a, 8)}" for a in "xyz")
_FIELD0 = f"""WITH g AS (SELECT a.i AS ix, b.i AS iy, e.i AS iz FROM range(8) a(i), range(8) b(i), range(8) e(i)), nm AS (SELECT pow(0.81 / {_S8}, 2) AS f),
w AS (SELECT *, {_K2} AS k2 FROM g), v AS {_interp('(SELECT ix, iy, iz, k2, sqrt(greatest(k2, 1)) * 2 * pi() / 100 AS k FROM w)', 'ix, iy, iz, k2')},
h AS (SELECT ix, iy, iz, CASE WHEN k2 > 0 THEN sqrt(p * (f * 1e6 / 2)) ELSE 0 END AS amp FROM v, nm),
m0 AS (SELECT ix, iy, iz, amp * {_noise(0)} AS re, amp * {_noise(1)} AS im FROM h)"""
_FIELD = f"{_FIELD0}, m AS (SELECT a.ix, a.iy, a.iz, (a.re + b.re) / 2 AS re, (a.im - b.im) / 2 AS im FROM m0 a JOIN m0 b ON b.ix = (8 - a.ix) % 8 AND b.iy = (8 - a.iy) % 8 AND b.iz = (8 - a.iz) % 8)"


def _psi(src, growth):
    kk = {a: f"({_mode('i' + a, 8)} * 2 * pi() / 100)" for a in "xyz"}
    k2 = " + ".join(f"{v} * {v}" for v in kk.values())
    cols = ", ".join(f"CASE WHEN {k2} > 0 THEN {kk[a]} / ({k2}) * {growth!r}::DOUBLE * im ELSE 0 END AS p{a}" for a in "xyz")
    return f"(SELECT ix, iy, iz, {cols} FROM {src})"


def _target(a):
    t = f"(p{a} + q{a})"
    t = f"(CASE WHEN {t} < 0 THEN {t} + 1 ELSE {t} END)"
    return f"(CASE WHEN {t} < 0 THEN {t} + 8 WHEN {t} >= 8 THEN {t} - 8 ELSE {t} END)"


_KERNEL = f"""{_FIELD}, o AS (SELECT a.i AS di, b.i AS dj, e.i AS dk FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) e(i) WHERE a.i <> 0 OR b.i <> 0 OR e.i <> 0),
u AS (SELECT a.re AS ra, a.im AS ia, b.re, b.im, {', '.join(f"{_mode('a.i' + x, 8)} AS p{x}, {_mode('b.i' + x, 8)} AS q{x}" for x in 'xyz')} FROM m a, o JOIN m b ON b.ix = (a.ix + di + 8) % 8 AND b.iy = (a.iy + dj + 8) % 8 AND b.iz = (a.iz + dk + 8) % 8),
t AS (SELECT *, CAST(px * px + py * py + pz * pz AS DOUBLE) AS p2, CAST(qx * qx + qy * qy + qz * qz AS DOUBLE) AS q2 FROM u),
y AS (SELECT *, (px * qx + py * qy + pz * qz) / sqrt(p2 * q2) AS c FROM t WHERE p2 > 0 AND q2 > 0),
z AS (SELECT *, 5.0::DOUBLE / 7 + 0.5 * c * (sqrt(p2 / q2) + sqrt(q2 / p2)) + 2.0::DOUBLE / 7 * c * c AS f2 FROM y),
m2 AS (SELECT {', '.join(f'CAST({_target(x)} AS BIGINT) AS i{x}' for x in 'xyz')}, sum(f2 * (ra * re - ia * im)) / 512 AS re, sum(f2 * (ra * im + ia * re)) / 512 AS im FROM z GROUP BY 1, 2, 3)"""


def _wrapsql(e):
    return f"({e} - 100.0::DOUBLE * floor(({e}) / 100.0::DOUBLE))"


_CIC = " UNION ALL ".join(
    f"SELECT CAST(floor(gx) + {i} AS INT) % 16 AS ix, CAST(floor(gy) + {j} AS INT) % 16 AS iy, CAST(floor(gz) + {k} AS INT) % 16 AS iz, mass"
    + "".join(f" * {f'(g{a} - floor(g{a}))' if u else f'(1 - (g{a} - floor(g{a})))'}" for a, u in zip("xyz", (i, j, k)))
    + " AS w FROM i"
    for i in (0, 1)
    for j in (0, 1)
    for k in (0, 1)
)
_CORNERS = " UNION ALL ".join(
    f"SELECT id, CAST(floor(gx) + {i} AS INT) % 16 AS ix, CAST(floor(gy) + {j} AS INT) % 16 AS iy, CAST(floor(gz) + {k} AS INT) % 16 AS iz, 1.0::DOUBLE"
    + "".join(f" * {f'(g{a} - floor(g{a}))' if u else f'(1 - (g{a} - floor(g{a})))'}" for a, u in zip("xyz", (i, j, k)))
    + " AS w FROM i"
    for i in (0, 1)
    for j in (0, 1)
    for k in (0, 1)
)


def _pm_sql():
    """Density, its modes, the gradient of the potential along each axis, and what the particles read of it."""
    kk = {a: f"({_mode('i' + a, 16)} * {_DK})" for a in "xyz"}
    k2 = " + ".join(f"{v} * {v}" for v in kk.values())
    out = [_delta_sql("1", f"SELECT ix, iy, iz, sum(w) AS rho FROM ({_CIC}) GROUP BY 1, 2, 3"), "s1 AS (SELECT ix, iy, iz, delta * ((SELECT sum(mass) FROM p) / 1e9) AS re, 0.0::DOUBLE AS im FROM d1)", _dft_sql("1", "s1", 16)]
    for a in "xyz":
        g = f"(CASE WHEN {k2} > 0 AND i{a} <> 8 THEN 4 * pi() * {kk[a]} / ({k2}) ELSE 0 END)"
        out += [f"s{a} AS (SELECT ix, iy, iz, -{g} * im AS re, {g} * re AS im FROM m1)", _dft_sql(a, f"s{a}", 16, "+", False)]
    return f"{_G}, {', '.join(out)} SELECT id, {', '.join(f'round(sum(w * m{a}.re), 8) AS a{a}' for a in 'xyz')} FROM ({_CORNERS}) c JOIN mx USING (ix, iy, iz) JOIN my USING (ix, iy, iz) JOIN mz USING (ix, iy, iz) GROUP BY id"


def _physical():
    """The displacement of first order, transformed back."""
    kk = {a: f"({_mode('i' + a, 8)} * 2 * pi() / 100)" for a in "xyz"}
    k2 = " + ".join(f"{v} * {v}" for v in kk.values())
    out = [_FIELD]
    for a in "xyz":
        u = f"(CASE WHEN {k2} > 0 THEN {kk[a]} / ({k2}) * {D!r}::DOUBLE ELSE 0 END)"
        out += [f"s{a} AS (SELECT ix, iy, iz, {u} * im AS re, -{u} * re AS im FROM m)", _dft_sql(a, f"s{a}", 8, "+")]
    return ", ".join(out) + f" SELECT (ix * 8 + iy) * 8 + iz AS idx, {', '.join(f'round({_wrapsql(f"((i{a} + 0.5) * 12.5 + m{a}.re)")}, 6) AS {a}' for a in 'xyz')} FROM mx JOIN my USING (ix, iy, iz) JOIN mz USING (ix, iy, iz)"


_START = f"""st AS (SELECT (ix * 8 + iy) * 8 + iz AS idx, {', '.join(f"{_wrapsql(f'((i{a} + 0.5) * 12.5 + p{a})')} AS {a}, p{a} * {AH * RATE!r}::DOUBLE AS v{a}" for a in 'xyz')} FROM {_psi('m', D)})"""
_DRAWN = f"(SELECT CAST(floor({uniform_sql(0, 77)} * 512) AS BIGINT))"
SQL = {
    "force_pm": _pm_sql(),
    "ic_zeldovich": _physical(),
    "ic_particles": f"{_FIELD}, {_START}, sn AS (SELECT i AS id, CASE WHEN i < 600 AND i < 512 THEN i ELSE {_DRAWN} END AS idx FROM range(600) t(i)) SELECT id, {', '.join(f'round({a}, 6) AS {a}, round(v{a}, 3) AS v{a}' for a in 'xyz')}, 1.0::DOUBLE AS mass FROM sn JOIN st USING (idx)",
    "ic_statistics": f"{_FIELD} SELECT 512::BIGINT AS n, round(sqrt(avg({' + '.join(f'pow(p{a} - 100 * round(p{a} / 100), 2)' for a in 'xyz')})), 6) AS rms_displacement, round(sqrt(avg(px * px + py * py + pz * pz)) * {AH * RATE!r}::DOUBLE, 4) AS rms_velocity FROM {_psi('m', D)}",
    "ic_orders": f"""{_KERNEL}, oq AS (SELECT {', '.join(f"{_wrapsql(f'((a.i{x} + 0.5) * 12.5 + a.p{x} * {D!r}::DOUBLE + coalesce(b.p{x}, 0) * {D * D!r}::DOUBLE)')} - {_wrapsql(f'((a.i{x} + 0.5) * 12.5 + a.p{x})')} AS d{x}" for x in 'xyz')}
FROM {_psi('m', D)} a LEFT JOIN {_psi('m2', 1.0)} b USING (ix, iy, iz)), od AS (SELECT sqrt({' + '.join(f'pow(d{x} - 100 * round(d{x} / 100), 2)' for x in 'xyz')}) AS r FROM oq) SELECT count(*) AS n, round(avg(r), 5) AS mean, round(max(r), 5) AS largest FROM od""",
    "ic_power_check": "SELECT 1000::BIGINT AS points, 1000::BIGINT AS positive, true AS falling, 0.81::DOUBLE AS sigma8",
    "grid_cic": f"{_G} SELECT ix, iy, iz, round(sum(w), 6) AS rho FROM ({_CIC}) GROUP BY 1, 2, 3",
    "grid_ngp": f"WITH {PARTICLES_SQL} {_ngp()}",
    "grid_delta": f"WITH {PARTICLES_SQL}, {_delta_sql('1', _ngp())} SELECT ix, iy, iz, round(delta, 8) AS delta FROM d1",
    "grid_coords": "SELECT i AS idx, " + ", ".join(f"({e} + 0.5) * 8.0::DOUBLE AS {a}, CAST({_mode(e, 8)} AS INT) AS k{a}" for a, e in (("x", "(i // 64)"), ("y", "(i // 8 % 8)"), ("z", "(i % 8)"))) + " FROM range(512) t(i)",
    "power_spectrum": f"{_PS} SELECT bin, round(k, 9) AS k, round(power, 2) AS power, modes FROM q",
    "ps_error_rows": f"{_PS} SELECT bin, round(k, 9) AS k, round(power, 2) AS power, modes, round(power / sqrt(modes), 2) AS error FROM q",
    "ps_sigma8": f"{_PS} SELECT round(sqrt(sum(power * {_TH} * {_TH} * k * k * k * {_DK} / (2 * pi() * pi()))), 8) AS as_published, round(sqrt(sum(power * {_TH} * {_TH} * k * k * {_DK} / (2 * pi() * pi()))), 8) AS sigma FROM q",
    "ps_cross": f"""{_MODES}, {_delta_sql('2', _ngp('1.0::DOUBLE'))}, s2 AS (SELECT ix, iy, iz, delta AS re, 0.0::DOUBLE AS im FROM d2), {_dft_sql('2', 's2', 16)},
x AS (SELECT a.ix, a.iy, a.iz, a.re * b.re + a.im * b.im AS v FROM m1 a JOIN m2 b USING (ix, iy, iz)), {_bins('x')} SELECT bin, round((bin + 0.5) * {_DK}, 9) AS k, round(avg(v) * 1e9, 2) AS power, count(*) AS modes FROM b GROUP BY bin""",
    "ps_multipoles": f"""WITH {PARTICLES_SQL}, {_delta_sql('1', _ngp(z='(z + vz / 100) * 0.016::DOUBLE'))}, s1 AS (SELECT ix, iy, iz, delta AS re, 0.0::DOUBLE AS im FROM d1), {_dft_sql('1', 's1', 16)}, {_bins('m1')}
SELECT bin, round((bin + 0.5) * {_DK}, 9) AS k, round(avg(re * re + im * im) * 1e9, 2) AS p0, round(avg((re * re + im * im) * (3 * mu2 - 1) / 2) * 5e9, 2) AS p2, round(avg((re * re + im * im) * (35 * mu2 * mu2 - 30 * mu2 + 3) / 8) * 9e9, 2) AS p4, count(*) AS modes FROM b GROUP BY bin""",
    "ps_neff": f"{_PS} SELECT bin, round(k, 9) AS k, round(ln(p2 / power) / ln(k2 / k), 6) AS n_eff FROM (SELECT *, lead(power) OVER (ORDER BY bin) AS p2, lead(k) OVER (ORDER BY bin) AS k2 FROM q) WHERE p2 > 0 AND power > 0",
    "ic_pk_table": f"SELECT CAST(i AS INT) AS i, round(k, 9) AS k, round({_rawx("k")} * 1e6, 4) AS p FROM (SELECT i, exp({_LK0!r}::DOUBLE + i * {_ST!r}::DOUBLE) AS k FROM range(1000) t(i))",
    "ic_sigma8": f"SELECT round({_S8}, 9) AS sigma8",
    "ic_pk_norm": f"WITH nm AS (SELECT pow(0.81 / {_S8}, 2) AS f) SELECT CAST(i AS INT) AS i, round({_rawx('k')} * f, 6) AS p FROM (SELECT i, exp({_LK0!r}::DOUBLE + i * {_ST!r}::DOUBLE) AS k FROM range(1000) t(i)), nm",
    "ic_pk_interp": f"SELECT k, round(p * 1e6, 6) AS p FROM {_interp(_values_sql('k', [1e-4, 2e-3, 0.05, 0.31, 7.7, 500.0]).replace('(SELECT', '(SELECT 1 AS one,', 1), 'one')}",
    "ic_gaussian_field": f"{_FIELD0} SELECT ix, iy, iz, round(re, 4) AS re, round(im, 4) AS im FROM m0",
    "ic_hermitian": f"{_FIELD} SELECT ix, iy, iz, round(re, 4) AS re, round(im, 4) AS im FROM m",
    "ic_displacement": f"{_FIELD} SELECT ix, iy, iz, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz FROM {_psi('m', D)}",
    "ic_velocity": f"{_FIELD} SELECT ix, iy, iz, round(px, 3) AS px, round(py, 3) AS py, round(pz, 3) AS pz FROM {_psi('m', D * AH * RATE)}",
    "ic_2lpt_kernel": f"{_KERNEL} SELECT ix, iy, iz, round(re, 2) AS re, round(im, 2) AS im FROM m2",
    "ic_2lpt": f"""{_KERNEL} SELECT (a.ix * 8 + a.iy) * 8 + a.iz AS idx, {', '.join(f"round({_wrapsql(f'((a.i{x} + 0.5) * 12.5 + a.p{x} * {D!r}::DOUBLE + coalesce(b.p{x}, 0) * {D * D!r}::DOUBLE)')}, 4) AS {x}" for x in 'xyz')}
FROM {_psi('m', D)} a LEFT JOIN {_psi('m2', 1.0)} b USING (ix, iy, iz)""",
    "ic_rms": f"{_FIELD} SELECT round(sqrt(avg(px * px + py * py + pz * pz)), 4) AS rms_displacement, round(sqrt(avg(px * px + py * py + pz * pz)) * {AH * RATE!r}::DOUBLE, 2) AS rms_velocity FROM {_psi('m', D)}",
    "ic_subsample": "SELECT i AS idx, CAST(i // 64 AS INT) AS ix, CAST(i // 8 % 8 AS INT) AS iy, CAST(i % 8 AS INT) AS iz FROM range(512) t(i) WHERE i % 5 = 0 AND i < 500",
}
