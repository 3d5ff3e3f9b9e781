"""Queries over forces, trees, steps and domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions.vectors import spread_sql
from starloom.operators import domain as dm
from starloom.operators import forces as fo
from starloom.operators import integrate as it
from starloom.operators import spatial as sp
from starloom.operators.skew import prefix_sums
from starloom.particles import HALOS_SQL, HOSTS_SQL, L, PARTICLES_SQL, halo_bodies, hosts, particles
from starloom.queries.structure import _IDX
from starloom.runtime import Scratch, table

EPS, DT = 0.1, 0.01
DIMS = (10, 5, 2)
LOW, HIGH, WIDTH = (0.0, 0.0, 0.0), (100.0, 200.0, 500.0), 10.0


def _r(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in df.columns])


A8 = {"ax": 8, "ay": 8, "az": 8}
A3 = ("ax", "ay", "az")


def force_direct(s, d):
    b = halo_bodies(s, d)
    return _r(fo.direct(b, b, EPS, L, A3), **A8)


def force_direct_mass(s, d):
    b = halo_bodies(s, d)
    a = fo.direct(b, b, EPS, L, A3).join(b.select("id", "mass"), "id")
    return a.select("id", *[F.round(F.col("mass") * F.col(f"a{x}"), 6).alias(f"f{x}") for x in "xyz"])


def force_potential(s, d):
    b = halo_bodies(s, d)
    return _r(fo.direct(b, b, EPS), **A8, phi=6)


def _ranked(s, b):
    """Rank by id, from range-partitioned prefix sums."""
    return prefix_sums(s, b.withColumn("one", F.lit(1).cast("long")), [], ["id"], "one", "rank", Scratch(s, "rank")).drop("one")


def force_sampled(s, d, theta=0.5):
    b = halo_bodies(s, d)
    every = max(1, int(1.0 / theta))
    return _r(fo.direct(b, _ranked(s, b).where(F.col("rank") % every == 0), 0.001**0.5, want=A3), **A8)


def force_allreduce(s, d):
    b = Scratch(s, "bodies").keep(halo_bodies(s, d))
    low, high = b.where(F.col("x") < 500), b.where(F.col("x") >= 500)
    parts = [fo.direct(low, low, EPS, L), fo.direct(high, high, EPS, L), fo.direct(low, high, EPS, L, mutual=True)]
    return _r(fo.all_reduce(*parts), **A8, phi=6)


def force_tree(periodic):
    return lambda s, d: _r(fo.tree_force(halo_bodies(s, d), L, periodic=periodic).drop("phi"), **A8)


def force_tree_particles(periodic):
    def run(s, d):
        p = Scratch(s, "bodies").keep(particles(s, d))
        return _r(fo.tree_force(p, L, periodic=periodic).drop("phi"), ax=6, ay=6, az=6)

    return run


def cmp_tree_direct(s, d):
    b = halo_bodies(s, d)
    return _r(fo.compare(fo.tree_force(b, L), fo.direct(b, b, 0.01, want=A3)), mean_error=7, max_error=6, correlation=7)


def tree_efficiency(s, d):
    return _r(fo.efficiency(fo.tree_force(halo_bodies(s, d), L)), efficiency=9)


def force_validation(s, d):
    b = halo_bodies(s, d)
    return fo.validate(fo.direct(b, b, EPS, L, A3), b).select("n", "unusable", "missing", (F.col("net") < 1e-9).alias("balanced"))


def tree_nodes(bodies):
    def run(s, d):
        n = fo.tree_nodes(bodies(s, d), L, 8, Scratch(s, "nodes"))[0]
        return _r(n, mass=6, comx=6, comy=6, comz=6)

    return run


def tree_stats(bodies):
    return lambda s, d: fo.tree_stats(fo.tree_nodes(bodies(s, d), L, 8, Scratch(s, "stats"))[0])


def pair_kernels(s, d):
    return _r(fo.pair_forces(hosts(s, d)), fx=6, fy=6, fz=6, potential=6)


def _sums(b):
    m, tot = F.col("mass"), F.sum("mass")
    spin = [F.round(F.sum(m * (F.col(p) * F.col(f"v{q}") - F.col(q) * F.col(f"v{p}"))), 3).alias(f"l{a}") for a, p, q in ("xyz", "yzx", "zxy")]
    return b.agg(F.count(F.lit(1)).alias("n"), F.round(tot, 6).alias("mass"), *[F.round(F.sum(m * F.col(x)) / tot, 6).alias(f"com{x}") for x in "xyz"], *[F.round(F.sum(m * F.col(f"v{x}")), 5).alias(f"p{x}") for x in "xyz"], *spin)


def _diagnostics(b, energies):
    e = energies.first()
    return _sums(b).withColumns({c: F.round(F.lit(e[c]), 3) for c in ("kinetic", "potential", "total")})


def system_diagnostics(s, d):
    b = hosts(s, d)
    return _diagnostics(b, fo.energies(b, EPS, L))


def _tree_energies(p):
    return fo.energies(p, EPS, L, fo.tree_force(p, L, eps=EPS, periodic=True))


def system_diagnostics_particles(s, d):
    p = Scratch(s, "bodies").keep(particles(s, d))
    return _diagnostics(p, _tree_energies(p))


def energy_particles(s, d):
    return _r(_tree_energies(Scratch(s, "bodies").keep(particles(s, d))), kinetic=3, potential=3, total=3)


def _field(s, d):
    h = hosts(s, d)
    return lambda df: fo.direct(df, h, EPS, L)


def step_kick(s, d):
    p = particles(s, d)
    a = it.kick(p.join(_field(s, d)(p), "id"), DT)
    return a.select("id", *[F.round(f"v{x}", 8).alias(f"v{x}") for x in "xyz"])


def step_kdk(s, d):
    out = it.kdk(particles(s, d), DT, _field(s, d), L)
    return out.select("id", *[F.round(x, 7).alias(x) for x in "xyz"], *[F.round(f"v{x}", 7).alias(f"v{x}") for x in "xyz"])


def particle_stats(s, d):
    p, m = particles(s, d), F.col("mass")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass")]
    for x in "xyz":
        aggs += [F.round(F.sum(m * F.col(x)) / F.sum("mass"), 6).alias(f"com{x}"), F.min(x).alias(f"min{x}"), F.max(x).alias(f"max{x}"), F.round(F.sqrt(F.avg(F.col(f"v{x}") * F.col(f"v{x}"))), 6).alias(f"rms{x}")]
    return p.agg(*aggs)


def validate_ic(s, d):
    """Counts of rows that initial conditions must not have, over the raw table."""
    p = table(s, d, "particles")
    bad = F.lit(False)
    out = F.lit(False)
    for x in "xyz":
        bad = bad | F.col(x).isNull() | F.isnan(x)
        out = out | (~F.isnan(x) & ((F.col(x) < 0) | (F.col(x) >= L)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return p.agg(F.count(F.lit(1)).alias("n"), n(bad).alias("unusable"), n(out).alias("outside"), n(F.col("mass").isNull() | F.isnan("mass") | (F.col("mass") <= 0)).alias("bad_mass"), (F.count("id") - F.countDistinct("id")).alias("repeated"))


def morton_sort(s, d):
    keyed = particles(s, d).select("id", sp.morton_key(L).alias("key"), F.lit(1).cast("long").alias("one"))
    return prefix_sums(s, keyed, [], ["key", "id"], "one", "place", Scratch(s, "sort")).drop("one")


def morton_prefix(s, d):
    at = Scratch(s, "prefix").keep(morton_sort(s, d))
    nxt = at.select((F.col("place") - 1).alias("place"), F.col("key").alias("next"))
    x = F.col("key").bitwiseXOR(F.col("next"))
    return at.join(nxt, "place").select("id", "place", F.when(x == 0, 30).otherwise(30 - F.length(F.bin(x))).cast("int").alias("common"))


QUERIES = {
    "force_direct": force_direct,
    "force_direct_mass": force_direct_mass,
    "force_potential": force_potential,
    "force_sampled": force_sampled,
    "force_allreduce": force_allreduce,
    "force_tree": force_tree(False),
    "force_tree_periodic": force_tree(True),
    "force_tree_particles": force_tree_particles(False),
    "force_tree_periodic_particles": force_tree_particles(True),
    "force_pm": lambda s, d: _r(fo.mesh_force(Scratch(s, "bodies").keep(particles(s, d)), 16, L), **A8),
    "cmp_tree_direct": cmp_tree_direct,
    "tree_efficiency": tree_efficiency,
    "force_validation": force_validation,
    "exchange_rebalanced": lambda s, d: dm.rebalanced(particles(s, d), L, 8).groupBy("owner").agg(F.count(F.lit(1)).alias("load")),
    "tree_nodes": tree_nodes(halo_bodies),
    "tree_nodes_particles": tree_nodes(particles),
    "tree_stats": tree_stats(halo_bodies),
    "tree_stats_particles": tree_stats(particles),
    "pair_kernels": pair_kernels,
    "energy": lambda s, d: _r(fo.energies(halo_bodies(s, d), EPS, L), kinetic=3, potential=3, total=3),
    "energy_drift": lambda s, d: _r(it.run(hosts(s, d), 2, DT, EPS, L), kinetic=3, potential=3, total=3, drift=9),
    "energy_particles": energy_particles,
    "system_diagnostics": system_diagnostics,
    "system_diagnostics_particles": system_diagnostics_particles,
    "step_kick": step_kick,
    "step_drift": lambda s, d: it.drift(particles(s, d), 0.5, L).select("id", "x", "y", "z"),
    "step_kdk": step_kdk,
    "particle_stats": particle_stats,
    "validate_ic": validate_ic,
    "morton_sort": morton_sort,
    "morton_prefix": morton_prefix,
    "filter_local_box": lambda s, d: particles(s, d, sp.in_box(LOW, HIGH)).select("id", "x", "y", "z"),
    "filter_ghost_shell": lambda s, d: particles(s, d, sp.in_shell(LOW, HIGH, WIDTH)).select("id", "x", "y", "z"),
    "domain_owner": lambda s, d: particles(s, d).select("id", dm.owner(DIMS, L).alias("owner")),
    "domain_bounds": lambda s, d: dm.bounds(s, DIMS, L),
    "domain_neighbors": lambda s, d: dm.neighbours(s, DIMS),
    "domain_density": lambda s, d: dm.density(particles(s, d), L),
    "domain_morton_cells": lambda s, d: dm.morton_cells(particles(s, d), L),
    "domain_greedy": lambda s, d: dm.greedy(particles(s, d), L, 8),
    "exchange_particles": lambda s, d: dm.exchange(particles(s, d), DIMS, L).select("id", "owner", "mass"),
    "ghost_exchange": lambda s, d: dm.ghosts(particles(s, d), DIMS, L, WIDTH),
    "load_balance": lambda s, d: dm.loads(particles(s, d), DIMS, L),
}


def _mi(e):
    return f"(CASE WHEN {e} > 500 THEN {e} - 1000 WHEN {e} < -500 THEN {e} + 1000 ELSE {e} END)"


def _pull(t, src, eps2, box=True, where="s.id <> t.id"):
    d = [_mi(f"(s.{a} - t.{a})") if box else f"(s.{a} - t.{a})" for a in "xyz"]
    return f"""(SELECT id, sum(m * dx / (r2 * sqrt(r2))) AS ax, sum(m * dy / (r2 * sqrt(r2))) AS ay, sum(m * dz / (r2 * sqrt(r2))) AS az, -sum(m / sqrt(r2)) AS phi FROM
(SELECT id, m, dx, dy, dz, dx * dx + dy * dy + dz * dz + {eps2}::DOUBLE AS r2 FROM (SELECT t.id, s.mass AS m, {d[0]} AS dx, {d[1]} AS dy, {d[2]} AS dz FROM {t} t JOIN {src} s ON {where})) GROUP BY id)"""


_A8 = "round(ax, 8) AS ax, round(ay, 8) AS ay, round(az, 8) AS az"
_E = f"(SELECT sum(mass * (vx * vx + vy * vy + vz * vz) / 2) AS k, sum(mass * phi / 2) AS u FROM {{b}} JOIN {_pull('{b}', '{b}', 0.1 * 0.1)} USING (id))"
_KEY20 = "(" + " + ".join(f"((((CAST(least(greatest(floor({a} / 1000.0::DOUBLE * 1048576), 0), 1048575) AS BIGINT)) >> {b}) & 1) << {3 * b + o})" for a, o in (("x", 2), ("y", 1), ("z", 0)) for b in range(20)) + ")"
_NODES = f"""{HALOS_SQL}, k AS (SELECT *, {_KEY20} AS key FROM p), a AS (SELECT k.*, CAST(l.i AS INT) AS level, key >> (3 * (20 - l.i)) AS cell FROM k, range(21) l(i)),
g AS (SELECT level, cell, count(*) AS n, sum(mass) AS mass, sum(mass * x) / sum(mass) AS comx, sum(mass * y) / sum(mass) AS comy, sum(mass * z) / sum(mass) AS comz, 1000.0::DOUBLE / pow(2, level) AS size, count(*) <= 8 OR level = 20 AS is_leaf FROM a GROUP BY 1, 2),
nodes AS (SELECT g.* FROM g LEFT JOIN g u ON u.level = g.level - 1 AND u.cell = g.cell >> 3 WHERE g.level = 0 OR NOT u.is_leaf)"""


def _tree(periodic):
    d = [_mi(f"(n.com{a} - f.{a})") if periodic else f"(n.com{a} - f.{a})" for a in "xyz"]
    e = [_mi(f"(s.{a} - h.{a})") if periodic else f"(s.{a} - h.{a})" for a in "xyz"]
    far = "size * size < 0.25 * (r2 + 0.01 * 0.01)" if periodic else "size < 0.5 * sqrt(r2)"
    return f"""{_NODES}, f AS (SELECT id, x, y, z, 0 AS level, CAST(0 AS BIGINT) AS cell, false AS far, false AS leaf, true AS start, 0.0::DOUBLE AS m, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, 0.0::DOUBLE AS dz FROM p
UNION ALL SELECT id, x, y, z, level, cell, {far} AND NOT is_leaf, is_leaf, false, mass, dx, dy, dz FROM (SELECT f.id, f.x, f.y, f.z, n.level, n.cell, n.mass, n.size, n.is_leaf, {d[0]} AS dx, {d[1]} AS dy, {d[2]} AS dz,
{d[0]} * {d[0]} + {d[1]} * {d[1]} + {d[2]} * {d[2]} AS r2 FROM f JOIN nodes n ON (f.start AND n.level = 0) OR (NOT f.start AND NOT f.far AND NOT f.leaf AND n.level = f.level + 1 AND n.cell >> 3 = f.cell))),
c AS (SELECT id, m, dx, dy, dz FROM f WHERE far UNION ALL SELECT h.id, s.mass, {e[0]}, {e[1]}, {e[2]} FROM f h JOIN a s ON s.level = h.level AND s.cell = h.cell AND s.id <> h.id WHERE h.leaf),
w AS (SELECT *, dx * dx + dy * dy + dz * dz + 0.01 * 0.01::DOUBLE AS r2 FROM c),
t AS (SELECT id, sum(m * dx / (r2 * sqrt(r2))) AS ax, sum(m * dy / (r2 * sqrt(r2))) AS ay, sum(m * dz / (r2 * sqrt(r2))) AS az, count(*) AS terms FROM w GROUP BY id)"""


def _owner(sh=("0", "0", "0")):
    w = [f"({a} + {s}::DOUBLE - 1000.0::DOUBLE * floor(({a} + {s}::DOUBLE) / 1000.0::DOUBLE))" for a, s in zip("xyz", sh)]
    at = [f"CAST(least(floor({v} / {L / n!r}::DOUBLE), {n - 1}) AS INT)" for v, n in zip(w, DIMS)]
    return f"(({at[0]} * 5 + {at[1]}) * 2 + {at[2]})"


_CELLS = "SELECT {} FROM p GROUP BY 1, 2, 3"


def _density(n):
    return "SELECT " + ", ".join(f"CAST(least(greatest(floor({a} / 1000.0::DOUBLE * {n}), 0), {n - 1}) AS INT) AS i{a}" for a in "xyz") + ", count(*) AS n FROM p GROUP BY 1, 2, 3"


_CODE = f"{spread_sql('CAST(ix AS BIGINT)')} + {spread_sql('CAST(iy AS BIGINT)')} * 2 + {spread_sql('CAST(iz AS BIGINT)')} * 4"
def _deal_sql(parts, cells):
    """CTEs after m (code, n, target): each part begins at the first cell that brings the one before it above the mean."""
    out = ["u AS MATERIALIZED (SELECT *, sum(n) OVER (ORDER BY code) AS upto FROM m)", "s1 AS (SELECT min(code) AS first FROM u WHERE upto > target)"]
    for i in range(2, parts):
        out.append(f"s{i} AS (SELECT min(u.code) AS first FROM u, (SELECT code AS at, upto - n AS base FROM u JOIN s{i - 1} ON code = first) b WHERE u.code > b.at AND u.upto > b.base + u.target)")
    begins = " UNION ALL ".join(["SELECT 0 AS part, 0 AS first", *[f"SELECT {i}, first FROM s{i} WHERE first IS NOT NULL" for i in range(1, parts)]])
    return ", ".join([*out, f"b AS ({begins})", "g AS (SELECT u.code, any_value(u.n) AS n, max(b.part) AS part FROM u JOIN b ON b.first <= u.code GROUP BY 1)"])


def _unspread(o):
    return "(" + " + ".join(f"(((code >> {3 * b + o}) & 1) << {b})" for b in range(5)) + ")"


_BOX = "x >= 0 AND x < 100 AND y >= 0 AND y < 200 AND z >= 0 AND z < 500"
_WIDE = "x >= -10 AND x < 110 AND y >= -10 AND y < 210 AND z >= -10 AND z < 510"


def _w(e):
    return f"({e} - 1000.0::DOUBLE * floor(({e}) / 1000.0::DOUBLE))"


def _kdk_sql(src, out, sources, self_=False):
    """CTEs that step src once under the pull of sources (or of itself, moving)."""
    p1, p2 = _pull(src, sources or src, 0.1 * 0.1), _pull(f"{out}h", sources or f"{out}h", 0.1 * 0.1)
    moved = ", ".join(_w(f"s.{a} + (s.v{a} + b.a{a} * 0.005::DOUBLE) * 0.01::DOUBLE") + f" AS {a}" for a in "xyz")
    return f"""{out}h AS MATERIALIZED (SELECT s.id, s.mass, {moved}, {', '.join(f's.v{a} + b.a{a} * 0.005::DOUBLE AS v{a}' for a in 'xyz')} FROM {src} s JOIN {p1} b ON b.id = s.id),
{out} AS MATERIALIZED (SELECT s.id, s.mass, s.x, s.y, s.z, {', '.join(f's.v{a} + b.a{a} * 0.005::DOUBLE AS v{a}' for a in 'xyz')} FROM {out}h s JOIN {p2} b ON b.id = s.id)"""


SQL = {
    "force_direct": f"WITH {HALOS_SQL} SELECT id, {_A8} FROM {_pull('p', 'p', 0.1 * 0.1)}",
    "force_direct_mass": f"WITH {HALOS_SQL} SELECT id, round(mass * ax, 6) AS fx, round(mass * ay, 6) AS fy, round(mass * az, 6) AS fz FROM p JOIN {_pull('p', 'p', 0.1 * 0.1)} USING (id)",
    "force_potential": f"WITH {HALOS_SQL} SELECT id, {_A8}, round(phi, 6) AS phi FROM {_pull('p', 'p', 0.1 * 0.1, False)}",
    "force_sampled": f"WITH {HALOS_SQL}, q AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rank FROM p) WHERE rank % 2 = 0) SELECT id, {_A8} FROM {_pull('p', 'q', 0.001, False)}",
    "force_allreduce": f"WITH {HALOS_SQL} SELECT id, {_A8}, round(phi, 6) AS phi FROM {_pull('p', 'p', 0.1 * 0.1)}",
    "force_tree": f"WITH RECURSIVE {_tree(False)} SELECT id, {_A8}, terms FROM t",
    "force_tree_periodic": f"WITH RECURSIVE {_tree(True)} SELECT id, {_A8}, terms FROM t",
    "cmp_tree_direct": f"""WITH RECURSIVE {_tree(False)}, v AS (SELECT t.ax, t.ay, t.az, b.ax AS ux, b.ay AS uy, b.az AS uz FROM t JOIN {_pull('p', 'p', 0.01 * 0.01, False)} b ON b.id = t.id)
SELECT count(*) AS n, round(avg(sqrt((ax - ux) * (ax - ux) + (ay - uy) * (ay - uy) + (az - uz) * (az - uz)) / sqrt(ux * ux + uy * uy + uz * uz)), 7) AS mean_error, round(max(sqrt((ax - ux) * (ax - ux) + (ay - uy) * (ay - uy) + (az - uz) * (az - uz)) / sqrt(ux * ux + uy * uy + uz * uz)), 6) AS max_error,
round(sum(ax * ux + ay * uy + az * uz) / sqrt(sum(ax * ax + ay * ay + az * az) * sum(ux * ux + uy * uy + uz * uz)), 7) AS correlation FROM v WHERE ux * ux + uy * uy + uz * uz > 0""",
    "tree_efficiency": f"WITH RECURSIVE {_tree(False)} SELECT count(*) AS bodies, CAST(sum(terms) AS BIGINT) AS terms, round(sum(terms) / (count(*)::DOUBLE * count(*)), 9) AS efficiency FROM t",
    "force_validation": f"WITH {HALOS_SQL} SELECT count(*) AS n, 0::BIGINT AS unusable, 0::BIGINT AS missing, true AS balanced FROM p",
    "tree_nodes": f"WITH {_NODES} SELECT level, cell, n, round(mass, 6) AS mass, round(comx, 6) AS comx, round(comy, 6) AS comy, round(comz, 6) AS comz, size, is_leaf FROM nodes",
    "tree_stats": f"WITH {_NODES} SELECT max(level) AS depth, count(*) AS nodes, CAST(sum(CAST(is_leaf AS INT)) AS BIGINT) AS leaves, max(CASE WHEN level = 0 THEN n END) AS bodies FROM nodes",
    "pair_kernels": f"""WITH {HOSTS_SQL}, d AS (SELECT a.id AS id1, b.id AS id2, a.mass * b.mass AS mm, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM p a JOIN p b ON a.id < b.id), r AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM d)
SELECT id1, id2, {', '.join(f'round(mm / ((d2 + 0.0001) * sqrt(d2 + 0.0001)) * d{a}, 6) AS f{a}' for a in 'xyz')}, round(-mm / greatest(sqrt(d2), 0.01), 6) AS potential FROM r""",
    "energy": f"WITH {HALOS_SQL} SELECT round(k, 3) AS kinetic, round(u, 3) AS potential, round(k + u, 3) AS total FROM {_E.format(b='p')}",
    "energy_drift": f"""WITH {HOSTS_SQL}, {_kdk_sql('p', 's1', None)}, {_kdk_sql('s1', 's2', None)}, e AS (SELECT 0 AS step, k, u FROM {_E.format(b='p')} UNION ALL SELECT 1, k, u FROM {_E.format(b='s1')} UNION ALL SELECT 2, k, u FROM {_E.format(b='s2')})
SELECT step, round(k, 3) AS kinetic, round(u, 3) AS potential, round(k + u, 3) AS total, round((k + u - first_value(k + u) OVER (ORDER BY step)) / abs(first_value(k + u) OVER (ORDER BY step)), 9) AS drift FROM e""",
    "system_diagnostics": f"""WITH {HOSTS_SQL} SELECT count(*) AS n, round(sum(mass), 6) AS mass, {', '.join(f'round(sum(mass * {a}) / sum(mass), 6) AS com{a}, round(sum(mass * v{a}), 5) AS p{a}' for a in 'xyz')},
{', '.join(f'round(sum(mass * ({b} * v{c} - {c} * v{b})), 3) AS l{a}' for a, b, c in ('xyz', 'yzx', 'zxy'))}, any_value(kinetic) AS kinetic, any_value(potential) AS potential, any_value(total) AS total
FROM p, (SELECT round(k, 3) AS kinetic, round(u, 3) AS potential, round(k + u, 3) AS total FROM {_E.format(b='p')})""",
    "step_kick": f"WITH {PARTICLES_SQL}, {HOSTS_SQL.replace('p AS', 'h AS', 1)} SELECT id, {', '.join(f'round(v{a} + a{a} * 0.01::DOUBLE, 8) AS v{a}' for a in 'xyz')} FROM p JOIN {_pull('p', 'h', 0.1 * 0.1)} USING (id)",
    "step_drift": f"WITH {PARTICLES_SQL} SELECT id, " + ", ".join(f"{_w(f'{a} + v{a} * 0.5::DOUBLE')} AS {a}" for a in "xyz") + " FROM p",
    "step_kdk": f"WITH {PARTICLES_SQL}, {HOSTS_SQL.replace('p AS', 'h AS', 1)}, {_kdk_sql('p', 's1', 'h')} SELECT id, {', '.join(f'round({a}, 7) AS {a}, round(v{a}, 7) AS v{a}' for a in 'xyz')} FROM s1",
    "particle_stats": f"WITH {PARTICLES_SQL} SELECT count(*) AS n, sum(mass) AS mass, {', '.join(f'round(sum(mass * {a}) / sum(mass), 6) AS com{a}, min({a}) AS min{a}, max({a}) AS max{a}, round(sqrt(avg(v{a} * v{a})), 6) AS rms{a}' for a in 'xyz')} FROM p",
    "validate_ic": "SELECT count(*) AS n, " + ", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, c in (("unusable", " OR ".join(f"{a} IS NULL OR isnan({a})" for a in "xyz")), ("outside", " OR ".join(f"(NOT isnan({a}) AND ({a} < 0 OR {a} >= 1000))" for a in "xyz")), ("bad_mass", "mass IS NULL OR isnan(mass) OR mass <= 0"))) + ", count(id) - count(DISTINCT id) AS repeated FROM particles",
    "morton_sort": f"WITH {PARTICLES_SQL}, k AS (SELECT id, {spread_sql(_IDX[0])} * 4 + {spread_sql(_IDX[1])} * 2 + {spread_sql(_IDX[2])} AS key FROM p) SELECT id, key, row_number() OVER (ORDER BY key, id) - 1 AS place FROM k",
    "morton_prefix": f"""WITH {PARTICLES_SQL}, k AS (SELECT id, {spread_sql(_IDX[0])} * 4 + {spread_sql(_IDX[1])} * 2 + {spread_sql(_IDX[2])} AS key FROM p), r AS (SELECT id, key, row_number() OVER (ORDER BY key, id) - 1 AS place, lead(key) OVER (ORDER BY key, id) AS nxt FROM k)
SELECT id, place, CAST(CASE WHEN xor(key, nxt) = 0 THEN 30 ELSE 30 - length(bin(xor(key, nxt))) END AS INT) AS common FROM r WHERE nxt IS NOT NULL""",
    "filter_local_box": f"WITH {PARTICLES_SQL} SELECT id, x, y, z FROM p WHERE {_BOX}",
    "filter_ghost_shell": f"WITH {PARTICLES_SQL} SELECT id, x, y, z FROM p WHERE {_WIDE} AND NOT ({_BOX})",
    "domain_owner": f"WITH {PARTICLES_SQL} SELECT id, {_owner()} AS owner FROM p",
    "domain_bounds": "SELECT dom, xmin, xmax, ymin, ymax, zmin, zmax FROM domains",
    "domain_neighbors": "SELECT DISTINCT a.dom, b.dom AS neighbour FROM domains a JOIN domains b ON a.dom <> b.dom AND " + " AND ".join(f"((b.{x}min <= a.{x}max AND b.{x}max >= a.{x}min) OR (b.{x}min = 0 AND a.{x}max = 1000) OR (a.{x}min = 0 AND b.{x}max = 1000))" for x in "xyz"),
    "domain_density": f"WITH {PARTICLES_SQL} {_density(32)}",
    "domain_morton_cells": f"WITH {PARTICLES_SQL}, c AS ({_density(32)}) SELECT CAST(row_number() OVER (ORDER BY code) AS INT) AS place, code, n FROM (SELECT {_CODE} AS code, n FROM c)",
    "domain_greedy": f"""WITH {PARTICLES_SQL}, c AS ({_density(32)}), m AS MATERIALIZED (SELECT b.i AS code, coalesce(n, 0) AS n, (SELECT count(*) FROM p) // 8 AS target FROM range(32768) b(i) LEFT JOIN (SELECT {_CODE} AS code, n FROM c) u ON u.code = b.i), {_deal_sql(8, 32768)}
SELECT part, CAST(sum(n) AS BIGINT) AS load, count(*) AS cells, {', '.join(f"min({_unspread(o)}) * 31.25::DOUBLE AS {x}min, (max({_unspread(o)}) + 1) * 31.25::DOUBLE AS {x}max" for o, x in enumerate('xyz'))} FROM g GROUP BY part""",
    "exchange_rebalanced": f"""WITH {PARTICLES_SQL}, c AS ({_density(32)}), m AS MATERIALIZED (SELECT b.i AS code, coalesce(n, 0) AS n, (SELECT count(*) FROM p) // 8 AS target FROM range(32768) b(i) LEFT JOIN (SELECT {_CODE} AS code, n FROM c) u ON u.code = b.i), {_deal_sql(8, 32768)}
SELECT part AS owner, CAST(sum(n) AS BIGINT) AS load FROM g GROUP BY part HAVING sum(n) > 0""",
    "exchange_particles": f"WITH {PARTICLES_SQL} SELECT id, {_owner()} AS owner, mass FROM p",
    "ghost_exchange": f"WITH {PARTICLES_SQL}, s AS (" + " UNION ALL ".join(f"SELECT id, {_owner()} AS owner, {_owner((str(i * 10.0), str(j * 10.0), str(k * 10.0)))} AS dom FROM p" for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)) + ") SELECT DISTINCT id, owner, dom FROM s WHERE owner <> dom",
    "load_balance": f"WITH {PARTICLES_SQL}, c AS (SELECT d.dom, count(o.id) AS n FROM domains d LEFT JOIN (SELECT id, {_owner()} AS dom FROM p) o ON o.dom = d.dom GROUP BY 1) SELECT min(n) AS fewest, max(n) AS most, CAST(sum(n) AS BIGINT) AS records, max(n) - min(n) > 0.2 * max(n) AS rebalance FROM c",
}

# the same trees over the particle table; energies take potentials of the periodic tree at eps 0.1
def _P(sql):
    sql = sql.replace(HALOS_SQL, PARTICLES_SQL)
    for a in "xyz":  # cells of massless particles
        sql = sql.replace(f"sum(mass * {a}) / sum(mass) AS com{a}", f"coalesce(sum(mass * {a}) / nullif(sum(mass), 0), avg({a})) AS com{a}", 1)
    # the walk as an equi-join: it starts above the root
    sql = sql.replace("0 AS level, CAST(0 AS BIGINT) AS cell, false AS far", "-1 AS level, CAST(0 AS BIGINT) AS cell, false AS far")
    return sql.replace("(f.start AND n.level = 0) OR (NOT f.start AND NOT f.far AND NOT f.leaf AND n.level = f.level + 1 AND n.cell >> 3 = f.cell)", "n.level = f.level + 1 AND n.cell >> 3 = f.cell AND NOT f.far AND NOT f.leaf")


_A6 = _A8.replace(", 8)", ", 6)")
_TREE_E = f"""{_P(_tree(True)).replace('0.01 * 0.01', '0.1 * 0.1')}, f2 AS (SELECT id, -sum(m / sqrt(r2)) AS phi FROM w GROUP BY id),
e AS (SELECT round(k, 3) AS kinetic, round(u, 3) AS potential, round(k + u, 3) AS total FROM (SELECT sum(mass * (vx * vx + vy * vy + vz * vz) / 2) AS k, sum(mass * coalesce(phi, 0) / 2) AS u FROM p LEFT JOIN f2 USING (id)))"""
SQL |= {
    "force_tree_particles": f"WITH RECURSIVE {_P(_tree(False))} SELECT id, {_A6}, terms FROM t",
    "force_tree_periodic_particles": f"WITH RECURSIVE {_P(_tree(True))} SELECT id, {_A6}, terms FROM t",
    "tree_nodes_particles": _P(SQL["tree_nodes"]),
    "tree_stats_particles": _P(SQL["tree_stats"]),
    "energy_particles": f"WITH RECURSIVE {_TREE_E} SELECT * FROM e",
    "system_diagnostics_particles": f"""WITH RECURSIVE {_TREE_E} SELECT count(*) AS n, round(sum(mass), 6) AS mass, {', '.join(f'round(sum(mass * {a}) / sum(mass), 6) AS com{a}, round(sum(mass * v{a}), 5) AS p{a}' for a in 'xyz')},
{', '.join(f'round(sum(mass * ({b} * v{c} - {c} * v{b})), 3) AS l{a}' for a, b, c in ('xyz', 'yzx', 'zxy'))}, any_value(kinetic) AS kinetic, any_value(potential) AS potential, any_value(total) AS total FROM p, e""",
}
