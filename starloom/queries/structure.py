"""Queries over space and halos."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import halos as ha
from starloom.operators import spatial as sp
from starloom.functions.vectors import spread_sql
from starloom.particles import HALOS_SQL, HOSTS_SQL, L, PARTICLES_SQL, halo_bodies, hosts, particles
from starloom.runtime import Scratch, table

LINK, LEAST = 0.2, 20
EDGES = [0.0, 25.0, 50.0, 100.0, 200.0, 400.0, 1000.0]


def fof(s, d):
    return ha.fof_members(particles(s, d), LINK, L, LEAST)


def fof_halos(s, d):
    return fof(s, d).groupBy("halo_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


def halo_properties(s, d):
    scratch = Scratch(s, "props")
    p = ha.properties(scratch.keep(fof(s, d)), scratch.keep(particles(s, d)))
    return p.select("halo_id", "n", *[F.round(c, k).alias(c) for c, k in [("mtot", 6), *[(f"com{a}", 5) for a in "xyz"], *[(f"cv{a}", 5) for a in "xyz"], ("v_max", 4), *[(f"l{a}", 3) for a in "xyz"], ("r_vir", 6), ("spin", 5)]])


def halo_totals(s, d):
    scratch = Scratch(s, "totals")
    rows = scratch.keep(fof(s, d)).join(particles(s, d), "id")
    return rows.agg(F.countDistinct("halo_id").alias("halos"), F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("mass"), F.lit(0.0)).alias("mass"))


def halo_mass_function(s, d):
    f = ha.mass_function(halo_bodies(s, d), "mass", EDGES, L**3)
    return f.select("bin", "lo", "hi", F.col("n").cast("long").alias("n"), F.round(F.col("density") * 1e12, 6).alias("density"))


def so_enclosed(s, d):
    centres = halo_bodies(s, d).select(F.col("id").alias("halo_id"), *[F.col(a).alias(f"com{a}") for a in "xyz"])
    inside = ha.enclosed(centres, particles(s, d), 5.0)
    return inside.select("halo_id", "n_in", F.round("m_in", 6).alias("m_in"))


def so_halos(s, d):
    scratch = Scratch(s, "so")
    p = scratch.keep(particles(s, d))
    h = scratch.keep(ha.properties(scratch.keep(fof(s, d)), p).select("halo_id", "comx", "comy", "comz", "r_vir"))
    return ha.so_radii(h, p, 1.0).select("halo_id", F.round("r_so", 6).alias("r_so"), F.round("m_so", 6).alias("m_so"))


def nfw(s, d):
    scratch = Scratch(s, "nfw")
    m, p = scratch.keep(fof(s, d)), scratch.keep(particles(s, d))
    h = ha.properties(m, p, box=L).select("halo_id", "comx", "comy", "comz", F.greatest(F.col("r_vir"), F.lit(1e-6)).alias("r_vir"))
    f = ha.nfw_fit(m, p, h, L)
    return f.select("halo_id", "n", "beyond", *[F.round(c, 6).alias(c) for c in ("r_max", "rs", "concentration", "rms")])


QUERIES = {
    "fof_cells": lambda s, d: sp.cell_of(particles(s, d), L, 5000).select("id", "cx", "cy", "cz"),
    "fof_pairs": lambda s, d: sp.neighbour_pairs(particles(s, d), LINK, L).select("id1", "id2", F.round("d2", 12).alias("d2")),
    "fof_halos": fof_halos,
    "halo_properties": halo_properties,
    "halo_totals": halo_totals,
    "halo_mass_function": halo_mass_function,
    "so_enclosed_mass": so_enclosed,
    "so_halos": so_halos,
    "nfw_fit": nfw,
    "merger_tree": lambda s, d: ha.merger_links(table(s, d, "membership")),
    "morton_gpu": lambda s, d: particles(s, d).select("id", sp.morton_key(L).alias("key")),
    "morton_mpi": lambda s, d: particles(s, d).select("id", sp.morton_key(L, False).alias("key")),
}

_IDX = [f"CAST(least(greatest(floor({a} / 1000.0::DOUBLE * 1024), 0), 1023) AS BIGINT)" for a in "xyz"]
_CELL = ", ".join(f"CAST(least(greatest(floor({a} / 1000.0::DOUBLE * 5000), 0), 4999) AS BIGINT) AS c{a}" for a in "xyz")


def _mi(e):
    return f"(CASE WHEN {e} > 500 THEN {e} - 1000 WHEN {e} < -500 THEN {e} + 1000 ELSE {e} END)"


PAIRS_SQL = f"""{PARTICLES_SQL}, c AS (SELECT *, {_CELL} FROM p),
o AS (SELECT a.i AS dx, b.i AS dy, e.i AS dz FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) e(i)),
g AS (SELECT c.*, (cx + dx + 5000) % 5000 AS kx, (cy + dy + 5000) % 5000 AS ky, (cz + dz + 5000) % 5000 AS kz FROM c, o),
q AS (SELECT g.id AS id1, c.id AS id2, {_mi('(c.x - g.x)')} AS ax, {_mi('(c.y - g.y)')} AS ay, {_mi('(c.z - g.z)')} AS az FROM g JOIN c ON g.kx = c.cx AND g.ky = c.cy AND g.kz = c.cz WHERE g.id < c.id),
f AS (SELECT id1, id2, ax * ax + ay * ay + az * az AS d2 FROM q WHERE ax * ax + ay * ay + az * az <= 0.2::DOUBLE * 0.2::DOUBLE)"""
MEMBERS_SQL = f"""{PAIRS_SQL}, u AS (SELECT id1 AS a, id2 AS b FROM f UNION ALL SELECT id2, id1 FROM f),
r AS (SELECT DISTINCT a AS s, a AS t FROM u UNION SELECT r.s, u.b FROM r JOIN u ON u.a = r.t),
k AS (SELECT s AS id, min(t) AS halo_id FROM r GROUP BY s), m AS (SELECT id, halo_id FROM (SELECT *, count(*) OVER (PARTITION BY halo_id) AS n FROM k) WHERE n >= 20)"""
_PROPS = f"""{MEMBERS_SQL}, w AS (SELECT m.halo_id, p.* FROM m JOIN p ON p.id = m.id),
z AS (SELECT halo_id, count(*) AS n, sum(mass) AS mtot, {', '.join(f'sum(mass * {a}) / nullif(sum(mass), 0) AS com{a}, sum(mass * v{a}) / nullif(sum(mass), 0) AS cv{a}' for a in 'xyz')} FROM w GROUP BY 1),
y AS (SELECT w.halo_id, w.mass AS m, {', '.join(f'w.{a} - com{a} AS r{a}, w.v{a} - cv{a} AS w{a}' for a in 'xyz')}, mtot FROM w JOIN z ON z.halo_id = w.halo_id),
x2 AS (SELECT halo_id, coalesce(max(CASE WHEN sqrt(rx * rx + ry * ry + rz * rz) > 0 THEN sqrt(mtot / sqrt(rx * rx + ry * ry + rz * rz)) END), 0) AS v_max,
sum(m * (ry * wz - rz * wy)) AS lx, sum(m * (rz * wx - rx * wz)) AS ly, sum(m * (rx * wy - ry * wx)) AS lz FROM y GROUP BY 1),
h AS (SELECT z.*, x2.* EXCLUDE (halo_id), pow(mtot * 3.0 / (4 * pi() * 200), 1.0 / 3::DOUBLE) AS r_vir FROM z JOIN x2 ON x2.halo_id = z.halo_id)"""
SQL = {
    "fof_cells": f"WITH {PARTICLES_SQL} SELECT id, {_CELL} FROM p",
    "fof_pairs": f"WITH {PAIRS_SQL} SELECT id1, id2, round(d2, 12) AS d2 FROM f",
    "fof_halos": f"WITH RECURSIVE {MEMBERS_SQL} SELECT halo_id, count(*) AS n, max(id) AS last_id FROM m GROUP BY 1",
    "halo_properties": f"""WITH RECURSIVE {_PROPS} SELECT halo_id, n, round(mtot, 6) AS mtot, {', '.join(f'round(com{a}, 5) AS com{a}, round(cv{a}, 5) AS cv{a}, round(l{a}, 3) AS l{a}' for a in 'xyz')}, round(v_max, 4) AS v_max, round(r_vir, 6) AS r_vir,
round(CASE WHEN sqrt(2) * mtot * v_max * r_vir > 0 THEN sqrt(lx * lx + ly * ly + lz * lz) / (sqrt(2) * mtot * v_max * r_vir) ELSE 0 END, 5) AS spin FROM h""",
    "halo_totals": f"WITH RECURSIVE {MEMBERS_SQL} SELECT count(DISTINCT halo_id) AS halos, count(*) AS members, coalesce(sum(mass), 0) AS mass FROM m JOIN p ON p.id = m.id",
    "halo_mass_function": f"""WITH {HALOS_SQL}, b AS (SELECT CAST(i - 1 AS INT) AS bin, e[i] AS lo, e[i + 1] AS hi FROM (SELECT unnest(range(1, {len(EDGES)})) AS i, {EDGES!r}::DOUBLE[] AS e))
SELECT bin, lo, hi, count(p.id) AS n, round(count(p.id) / ((hi - lo) * 1e9) * 1e12, 6) AS density FROM b LEFT JOIN p ON p.mass >= lo AND p.mass < hi GROUP BY 1, 2, 3""",
    "so_enclosed_mass": f"""WITH {HALOS_SQL.replace('p AS', 'h AS', 1)}, {PARTICLES_SQL} SELECT h.id AS halo_id, count(*) AS n_in, round(sum(p.mass), 6) AS m_in FROM h JOIN p
ON p.x BETWEEN h.x - 5 AND h.x + 5 AND sqrt((p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y) + (p.z - h.z) * (p.z - h.z)) <= 5 GROUP BY 1""",
    "so_halos": f"""WITH RECURSIVE {_PROPS}, d AS MATERIALIZED (SELECT h.halo_id, p.mass, sqrt((p.x - comx) * (p.x - comx) + (p.y - comy) * (p.y - comy) + (p.z - comz) * (p.z - comz)) AS d FROM h JOIN p ON p.x BETWEEN comx - 118 * r_vir AND comx + 118 * r_vir
WHERE sqrt((p.x - comx) * (p.x - comx) + (p.y - comy) * (p.y - comy) + (p.z - comz) * (p.z - comz)) <= greatest(118 * r_vir, 1e-9)),
s AS (SELECT halo_id, 0 AS i, r_vir AS r, false AS done FROM h UNION ALL SELECT s.halo_id, i + 1, CASE WHEN abs(v.rho - 200) / 200 < 0.01 THEN r WHEN v.rho > 200 THEN r * 0.9 ELSE r * 1.1 END, abs(v.rho - 200) / 200 < 0.01
FROM s, LATERAL (SELECT coalesce(sum(mass), 0) / (4.0 / 3 * pi() * s.r * s.r * s.r) AS rho FROM d WHERE d.halo_id = s.halo_id AND d.d <= s.r) v WHERE i < 50 AND NOT done),
l AS (SELECT halo_id, arg_max(r, i) AS r FROM s GROUP BY 1)
SELECT l.halo_id, round(l.r, 6) AS r_so, round(coalesce(sum(d.mass), 0), 6) AS m_so FROM l LEFT JOIN d ON d.halo_id = l.halo_id AND d.d <= l.r GROUP BY 1, l.r""",
    "nfw_fit": f"""WITH RECURSIVE {MEMBERS_SQL}, nw AS (SELECT m.halo_id, p.id, p.mass, p.x, p.y, p.z FROM m JOIN p ON p.id = m.id), nf AS (SELECT halo_id, {', '.join(f'arg_min({a}, id) AS f{a}' for a in 'xyz')} FROM nw GROUP BY 1),
nu AS (SELECT nw.halo_id, nw.mass, nw.x, nw.y, nw.z, {', '.join(f"f{a} + {_mi(f'({a} - f{a})')} AS u{a}" for a in 'xyz')} FROM nw JOIN nf ON nf.halo_id = nw.halo_id),
nh AS (SELECT halo_id, {', '.join(f'sum(mass * u{a}) / nullif(sum(mass), 0) AS c{a}' for a in 'xyz')}, greatest(pow(sum(mass) * 3.0 / (4 * pi() * 200), 1.0 / 3::DOUBLE), 1e-6) AS rv FROM nu GROUP BY 1),
ne AS (SELECT nu.halo_id, rv, mass, {', '.join(f"{_mi(f'({a} - c{a})')} AS d{a}" for a in 'xyz')} FROM nu JOIN nh ON nh.halo_id = nu.halo_id),
nd AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS d, max(sqrt(dx * dx + dy * dy + dz * dz)) OVER (PARTITION BY halo_id) AS rm FROM ne),
ns AS (SELECT halo_id, CASE WHEN rm > 0 THEN least(floor(d / rm * 64), 63) ELSE 0 END AS shell, sum(mass) AS m FROM nd GROUP BY 1, 2),
nt AS (SELECT halo_id, count(*) AS n, CAST(sum(CASE WHEN d > rv THEN 1 ELSE 0 END) AS BIGINT) AS beyond, any_value(rm) AS rm, any_value(rv) AS rv, sum(mass) AS mass FROM nd GROUP BY 1),
ng AS MATERIALIZED (SELECT nt.halo_id, i, (i + 1.0::DOUBLE) / 64 * CASE WHEN rm > 0 THEN rm ELSE rv END / rv AS r, coalesce(sum(ns.m) OVER (PARTITION BY nt.halo_id ORDER BY i), 0) / greatest(nt.mass, 1e-300) AS m FROM nt JOIN range(64) t(i) ON true LEFT JOIN ns ON ns.halo_id = nt.halo_id AND ns.shell = i),
nk AS (SELECT exp(ln(0.5) + i * (ln(50.0) - ln(0.5)) / 59) AS c FROM range(60) t(i)),
nv AS (SELECT halo_id, c, sqrt(avg(pow(m - (ln(1 + c * r) - c * r / (1 + c * r)) / (ln(1 + c * rl) - c * rl / (1 + c * rl)), 2))) AS rms FROM (SELECT *, max(r) OVER (PARTITION BY halo_id) AS rl FROM ng), nk GROUP BY 1, 2),
nb AS (SELECT halo_id, arg_min(c, rms) AS c, min(rms) AS rms FROM nv GROUP BY 1)
SELECT nt.halo_id, n, beyond, round(rm, 6) AS r_max, round(rv / c, 6) AS rs, round(c, 6) AS concentration, round(rms, 6) AS rms FROM nt JOIN nb ON nb.halo_id = nt.halo_id""",
    "merger_tree": """WITH m AS (SELECT DISTINCT halo_id, id, snap FROM membership WHERE halo_id > 0 AND id IS NOT NULL AND snap IS NOT NULL),
s AS (SELECT a.snap, a.halo_id, b.halo_id AS next_halo, count(*) AS shared FROM m a JOIN m b ON b.id = a.id AND b.snap = a.snap + 1 GROUP BY 1, 2, 3)
SELECT snap, halo_id, next_halo, shared FROM (SELECT *, row_number() OVER (PARTITION BY snap, halo_id ORDER BY shared DESC, next_halo) AS rn FROM s) WHERE rn = 1""",
    "morton_gpu": f"WITH {PARTICLES_SQL} SELECT id, {spread_sql(_IDX[0])} * 4 + {spread_sql(_IDX[1])} * 2 + {spread_sql(_IDX[2])} AS key FROM p",
    "morton_mpi": f"WITH {PARTICLES_SQL} SELECT id, {spread_sql(_IDX[0])} + {spread_sql(_IDX[1])} * 2 + {spread_sql(_IDX[2])} * 4 AS key FROM p",
}
