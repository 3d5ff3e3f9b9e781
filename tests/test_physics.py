import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.functions import cosmology as co
from starloom.functions import vectors as ve
from starloom.operators import domain as dm
from starloom.operators import ewald as ew
from starloom.operators import forces as fo
from starloom.operators import grid as gr
from starloom.operators import halos as ha
from starloom.operators import integrate as it
from starloom.operators import spatial as sp
from starloom.operators import spectrum as ps
from starloom.queries import dynamics

#: Analytic values at z: Hubble rate, age, growth, growth rate, matter share.
GOLDEN = {
    0.0: (67.0, 13.941396, 0.41676568, 0.52510836, 0.31),
    1.0: (119.290109, 5.92254, 0.39839872, 0.87370703, 0.78233438),
    3.0: (303.577288, 2.171844, 0.24159737, 0.98137275, 0.96639065),
    10.0: (1362.095334, 0.478844, 0.09075526, 0.99908144, 0.99833051),
}
DISTANCE = {0.1: (436.86531, 397.150282, 480.551841), 1.0: (3431.517349, 1715.758674, 6863.034697), 3.0: (6576.126283, 1644.031571, 26304.505133)}


@pytest.fixture(scope="module")
def bodies(spark):
    rnd = np.random.default_rng(4)
    n = 60
    pdf = pd.DataFrame({"id": np.arange(n), **{a: rnd.uniform(0, 10, n) for a in "xyz"}, **{f"v{a}": rnd.normal(0, 1, n) for a in "xyz"}, "mass": rnd.uniform(0.5, 2, n)})
    return spark.createDataFrame(pdf).cache()


def test_background(spark):
    c, z = co.Cosmology(), F.col("z")
    df = spark.createDataFrame([(v,) for v in GOLDEN], "z double")
    a = co.a_of(z)
    for r in df.select("z", co.hubble(c, a), co.age(c, a), co.growth(c, a), co.growth_rate(c, a), co.omega_m(c, a)).collect():
        assert tuple(r)[1:] == pytest.approx(GOLDEN[r[0]], rel=1e-6)
    far = spark.createDataFrame([(v,) for v in DISTANCE], "z double")
    for r in far.select("z", co.comoving(c, z), co.angular_diameter(c, z), co.luminosity(c, z)).collect():
        assert tuple(r)[1:] == pytest.approx(DISTANCE[r[0]], rel=1e-8)
    assert spark.range(1).select(co.variance(c, F.lit(8.0))).first()[0] == pytest.approx(1.969955155764e-7, rel=1e-9)
    assert spark.range(1).select(co.conformal(c, F.lit(1.0))).first()[0] == pytest.approx(215.51010624, rel=1e-9)
    with pytest.raises(ValueError):
        co.Cosmology(om=0.5)


def test_vectors(spark):
    df = spark.createDataFrame([(-0.25,), (1000.0,), (2500.5,), (-999.5,), (float("nan"),)], "x double")
    got = [r[0] for r in df.select(ve.wrap(F.col("x"), 1000.0)).collect()]
    assert got[:4] == [999.75, 0.0, 500.5, 0.5] and math.isnan(got[4])
    k = [r[0] for r in spark.createDataFrame([(5, 3, 1)], "a long, b long, c long").select(ve.morton(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert k == [0b100010111]


def test_two_bodies_attract(spark):
    two = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, mass double")
    got = {r["id"]: r["ax"] for r in fo.direct(two, two, 0.01).collect()}
    assert got[0] == pytest.approx(1 / 1.0001**1.5) and got[1] == pytest.approx(-got[0])
    assert {r["id"]: r["fx"] for r in fo.pair_forces(two).withColumnRenamed("id1", "id").collect()}[0] > 0
    same = two.withColumns({"x": F.lit(0.0), "id": F.col("id") * 0 + F.col("id")})
    assert all(r["ax"] == 0 for r in fo.direct(same, same, 0.0).collect())


def test_blocks_agree_with_broadcast_and_momentum_is_conserved(bodies, monkeypatch):
    a = {r["id"]: r for r in fo.direct(bodies, bodies, 0.1, 10.0).collect()}
    monkeypatch.setattr(fo, "TILE", 16)
    b = {r["id"]: r for r in fo.direct(bodies, bodies, 0.1, 10.0).collect()}
    assert set(a) == set(b)
    for i in a:
        assert tuple(a[i]) == pytest.approx(tuple(b[i]), rel=1e-9, abs=1e-9)
    mass = {r["id"]: r["mass"] for r in bodies.collect()}
    for c in ("ax", "ay", "az"):
        assert sum(mass[i] * a[i][c] for i in a) == pytest.approx(0, abs=1e-7)


@pytest.mark.parametrize("box", [None, 100.0])
@pytest.mark.parametrize("eps", [0.0, 0.1])
def test_strips_agree_with_differences_of_each_pair(box, eps, monkeypatch):
    monkeypatch.setattr(fo, "STRIP", 32)
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.random((700, 3)) * 100, rng.random(700)])
    x[:300, :3] = x[:300, :3] * 0.01 + 49.5  # a clump
    x[400, :3], x[401, :3], x[402, :3] = x[399, :3], x[399, :3] + (50, 0, 0), x[399, :3] - (0, 50, 0)  # one place; just half a box away
    x, ids = x[np.lexsort((x[:, 2] // 25, x[:, 1] // 25, x[:, 0] // 25))], rng.permutation(700)
    every = ("ax", "ay", "az", "phi")
    whole = fo._kernel(x[:, :3], ids, x, ids, eps, box)
    close = lambda got, want: np.abs(got - want) <= 1e-12 * (1 + np.abs(whole).max())
    assert close(fo._tiles(x, ids, x, ids, eps, box, True, every)[0], whole).all()
    assert close(fo._tiles(x, ids, x, ids, eps, box, True, ("phi",))[0][:, 3], whole[:, 3]).all()
    got, back = fo._tiles(x[:450], ids[:450], x[450:].copy(), ids[450:], eps, box, True, every)
    assert close(got, fo._kernel(x[:450, :3], ids[:450], x[450:], ids[450:], eps, box)).all()
    assert close(back, fo._kernel(x[450:, :3], ids[450:], x[:450], ids[:450], eps, box)).all()
    some, own = x[::2].copy(), np.where(np.arange(350) % 5 == 0, ids[0], ids[::2])  # the targets' ids, some of them repeated
    got, _ = fo._tiles(x, ids, some, own, eps, box, False, every)
    assert close(got, fo._kernel(x[:, :3], ids, some, own, eps, box)).all()


def test_blocks_of_different_tables(spark, bodies, monkeypatch):
    some = bodies.where("id % 3 = 0")
    for targets, sources in ((bodies, some), (some, bodies), (bodies.limit(0), bodies)):
        monkeypatch.setattr(fo, "TILE", 4096)
        a = {r["id"]: tuple(r) for r in fo.direct(targets, sources, 0.1, 10.0).collect()}
        monkeypatch.setattr(fo, "TILE", 8)
        b = {r["id"]: tuple(r) for r in fo.direct(targets, sources, 0.1, 10.0).collect()}
        assert set(a) == set(b) and all(a[i] == pytest.approx(b[i], rel=1e-9, abs=1e-9) for i in a)


PULL, EVERY = ("ax", "ay", "az"), ("ax", "ay", "az", "phi")


@pytest.mark.parametrize("name, box, want, once", [
    # one case for each query over direct sums
    ("force_validation", 1000.0, PULL, True),
    ("force_sampled", None, PULL, False),
    ("force_direct_mass", 1000.0, PULL, True),
    ("force_potential", None, EVERY, True),
    ("force_direct", 1000.0, PULL, True),
    ("energy", 1000.0, ("phi",), True),
    ("force_allreduce", 1000.0, EVERY, True),
    ("cmp_tree_direct", None, PULL, True),
])
def test_direct_sums_are_fast_enough_for_a_catalogue(spark, name, box, want, once, monkeypatch):
    """A query sums only what it returns, and that takes a small part of the time that differences of each pair take."""
    real, seen = fo.direct, []

    def spy(targets, sources, eps, box=None, want=EVERY, mutual=False):
        seen.append((targets is sources or mutual, box, tuple(want)))
        with monkeypatch.context() as m:  # what a sum calls itself doesn't count
            m.setattr(fo, "direct", real)
            return real(targets, sources, eps, box, want, mutual)

    monkeypatch.setattr(fo, "direct", spy)
    dynamics.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen and set(seen) == {(once, box, want)}
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.random((6000, 3)) * 1000, np.ones(6000)])
    x, ids = x[np.lexsort((x[:, 1], x[:, 0] // 60))], np.arange(6000)
    times = []
    for f in (lambda: fo._tiles(x, ids, x if once else x.copy(), ids, 0.1, box, once, want), lambda: fo._kernel(x[:600, :3], ids[:600], x, ids, 0.1, box)):
        began = time.process_time()
        f()
        times.append(time.process_time() - began)
    assert times[0] < 10 * times[1] / 3


def _catalogue(spark, n, box=100.0):
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.random((n, 3)) * box, rng.random(n)])
    x[1, :3], x[2, :3], x[3, :3], x[4, :3], x[5, :3] = x[0, :3], x[0, :3] + 0.01, x[0, :3] + 1.0, 0.0, box  # one place, close by, corners
    pdf = pd.DataFrame({"id": rng.permutation(n), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "mass": x[:, 3]})
    return spark.createDataFrame(pdf), x, pdf["id"].to_numpy()


@pytest.mark.parametrize("eps", [0.0, 0.1])
def test_potentials_of_a_large_catalogue_take_no_sum_of_all_blocks(spark, eps, monkeypatch):
    """force_potential: beyond MANY records the blocks don't all meet, and every pair still counts, to roundings."""
    for module, name, value in ((fo, "TILE", 64), (fo, "MANY", 64), (ew, "MESH", 96)):
        monkeypatch.setattr(module, name, value, raising=False)
    monkeypatch.setattr(fo, "_in_order", lambda *a: pytest.fail("blocks that all meet"))
    df, x, ids = _catalogue(spark, 3000)
    got = fo.direct(df, df, eps).toPandas().set_index("id")
    want = fo._kernel(x[:, :3], ids, x, ids, eps, None)
    assert len(got) == 3000 and got.index.is_unique
    off = np.abs(got.loc[ids, ["ax", "ay", "az", "phi"]].to_numpy() - want)
    assert (off <= 1e-12 * (np.abs(want) + np.abs(want[:, 3:]).mean())).all()


def test_what_the_mesh_cannot_take_is_summed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(fo, "TILE", 64)
    monkeypatch.setattr(fo, "MANY", 64)
    df, x, ids = _catalogue(spark, 300)
    far, nan = (df.withColumn("x", F.when(F.col("id") == 7, F.lit(v)).otherwise(F.col("x"))) for v in (1e9, float("nan")))  # a clump; no number
    for odd, eps in ((far, 0.1), (nan, 0.1), (df.withColumn("id", F.col("id") % 299), 0.1), (df.withColumns({c: F.lit(1.0) for c in "xyz"}), 0.1), (df, 90.0)):
        assert ew.sums(odd, 300, eps, ("phi",)) is None
    twice = df.withColumn("id", F.col("id") % 299)
    got = {r["id"]: r["phi"] for r in fo.direct(twice, twice, 0.1, want=("phi",)).collect()}
    own = ids % 299
    want = pd.Series(fo._kernel(x[:, :3], own, x, own, 0.1, None)[:, 3]).groupby(own).sum()
    assert len(got) == 299 and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in got)


@pytest.mark.parametrize("tile", [16, 4096])
def test_mutual_pulls(spark, bodies, tile, monkeypatch):
    low, high = bodies.where("x < 4"), bodies.where("x >= 4")
    want = {r["id"]: tuple(r) for r in fo.direct(bodies, bodies, 0.1, 10.0).collect()}
    monkeypatch.setattr(fo, "TILE", tile)
    parts = fo.direct(low, low, 0.1, 10.0), fo.direct(high, high, 0.1, 10.0), fo.direct(low, high, 0.1, 10.0, mutual=True)
    got = {r["id"]: tuple(r) for r in fo.all_reduce(*parts).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-9) for i in want)


def test_slots_fill_every_partition(spark):
    at = spark.createDataFrame([(i,) for i in fo._slots(spark, 21)], "slot int").repartition(21, "slot")
    assert [r["count"] for r in at.groupBy(F.spark_partition_id()).count().collect()] == [1] * 21


@pytest.mark.parametrize("periodic", [False, True])
def test_tree_tends_to_the_direct_sum(bodies, periodic):
    box = 10.0
    exact = fo.direct(bodies, bodies, 0.01, box if periodic else None)
    for theta, most in ((1e-9, 1e-9), (0.5, 0.3)):
        e = fo.compare(fo.tree_force(bodies, box, theta, capacity=4, periodic=periodic), exact).first()
        assert e["n"] == 60 and e["max_error"] < most


def test_assignment_conserves_mass_and_spectrum_matches_numpy(spark, bodies):
    n, box = 8, 10.0
    total = bodies.agg(F.sum("mass")).first()[0]
    cic, ngp = gr.assign_cic(bodies, n, box), gr.assign_ngp(bodies, n, box)
    assert cic.agg(F.sum("rho")).first()[0] == pytest.approx(total)
    assert ngp.agg(F.sum("rho")).first()[0] == pytest.approx(total)
    field = np.zeros((n, n, n))
    for r in gr.contrast(cic, n).collect():
        field[r["ix"], r["iy"], r["iz"]] = r["delta"]
    assert field.mean() == pytest.approx(0, abs=1e-12)
    f = np.fft.fftn(field) / n**3
    k = np.fft.fftfreq(n, 1 / n)
    kk = np.sqrt(k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2)
    got = {r["bin"]: r for r in ps.spectrum(ps.modes(gr.contrast(cic, n), n), n, box, 0.0).collect()}
    for b in range(1, n // 2):
        sel = (kk >= b) & (kk < b + 1)
        assert got[b]["modes"] == sel.sum()
        assert got[b]["power"] == pytest.approx((np.abs(f[sel]) ** 2).mean() * box**3)
    zero = gr.contrast(cic.limit(0), n)
    assert zero.count() == n**3 and zero.agg(F.max(F.abs("delta"))).first()[0] == 0
    back = gr.transform(gr.transform(gr.contrast(cic, n).select("ix", "iy", "iz", F.col("delta").alias("re"), F.lit(0.0).alias("im")), n), n, inverse=True)
    for r in back.collect():
        assert r["re"] == pytest.approx(field[r["ix"], r["iy"], r["iz"]], abs=1e-12)


def test_neighbours_and_fof_do_not_depend_on_the_origin(spark, bodies):
    def groups(shift):
        moved = bodies.withColumns({a: ve.wrap(F.col(a) + shift, 10.0) for a in "xyz"})
        pairs = {(r["id1"], r["id2"]) for r in sp.neighbour_pairs(moved, 1.2, 10.0).collect()}
        halos = {(r["halo_id"], r["id"]) for r in ha.fof_members(moved, 1.2, 10.0, 2).collect()}
        return pairs, halos

    rows = {r["id"]: np.array([r["x"], r["y"], r["z"]]) for r in bodies.collect()}
    want = set()
    for i in rows:
        for j in rows:
            if i < j:
                d = np.abs(rows[i] - rows[j])
                d = np.minimum(d, 10 - d)
                if (d * d).sum() <= 1.2 * 1.2:
                    want.add((i, j))
    assert groups(0.0)[0] == want
    assert groups(0.0) == groups(3.75)
    assert {(r["id1"], r["id2"]) for r in sp.neighbour_pairs(bodies, 6.0, 10.0).collect()} >= want  # a grid of one cell a side


def test_halo_of_mass_zero_and_mass_function(spark):
    p = spark.createDataFrame([(i, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(3)], "id long, x double, y double, z double, vx double, vy double, vz double, mass double")
    m = spark.createDataFrame([(0, i) for i in range(3)], "halo_id long, id long")
    r = ha.properties(m, p).first()
    assert r["n"] == 3 and r["mtot"] == 0 and r["spin"] == 0 and r["v_max"] == 0
    f = ha.mass_function(spark.createDataFrame([(1.0,), (2.0,), (5.0,), (None,)], "mass double"), "mass", [0.0, 2.0, 4.0, 5.0], 10.0).orderBy("bin").collect()
    assert [x["n"] for x in f] == [1, 1, 0] and f[0]["density"] == pytest.approx(1 / 20)


def test_domains(spark, bodies):
    assert dm.block_dims(12) == (2, 2, 3) and dm.block_dims(7) == (1, 1, 7) and dm.block_dims(64) == (4, 4, 4)
    owners = dm.exchange(bodies, (2, 2, 3), 10.0)
    assert {r["id"] for r in owners.collect()} == set(range(60))
    lows = {r["dom"]: r for r in dm.bounds(spark, (2, 2, 3), 10.0).collect()}
    for r in owners.collect():
        b = lows[r["owner"]]
        assert all(b[f"{a}min"] <= r[a] < b[f"{a}max"] for a in "xyz")
    g = dm.ghosts(bodies, (2, 2, 3), 10.0, 0.5).collect()
    assert len({(r["id"], r["dom"]) for r in g}) == len(g) and all(r["owner"] != r["dom"] for r in g)
    assert dm.greedy(bodies, 10.0, 4).agg(F.sum("load"), F.sum("cells")).first()[:] == (60, 32**3)
    assert dm.loads(bodies.limit(0), (2, 2, 3), 10.0).first()["rebalance"] is False


def test_energy_is_nearly_conserved(spark):
    two = spark.createDataFrame([(0, 4.0, 5.0, 5.0, 0.0, 0.35, 0.0, 1.0), (1, 6.0, 5.0, 5.0, 0.0, -0.35, 0.0, 1.0)], "id long, x double, y double, z double, vx double, vy double, vz double, mass double")
    e = it.run(two, 3, 0.05, 0.1).collect()
    assert abs(e[-1]["drift"]) < 1e-4 and e[0]["drift"] == 0


def test_gravity_takes_every_particle(spark, tmp_path):
    rnd = np.random.default_rng(9)
    n = 40
    p = pd.DataFrame({"id": np.arange(n), **{a: rnd.uniform(0, 1000, n) for a in "xyz"}, **{f"v{a}": rnd.normal(0, 1, n) for a in "xyz"}, "mass": rnd.uniform(0.5, 2, n)})
    spark.createDataFrame(p).write.parquet(f"{tmp_path}/particles.parquet")
    q = {k: f(spark, str(tmp_path)) for k, f in dynamics.QUERIES.items() if k.endswith("_particles") or k == "force_pm"}
    for k in ("force_tree_particles", "force_tree_periodic_particles", "force_pm"):
        assert {r["id"] for r in q[k].collect()} == set(range(n))
    assert q["tree_stats_particles"].first()["bodies"] == n
    e = q["system_diagnostics_particles"].first()
    assert e["n"] == n and e["mass"] == pytest.approx(p["mass"].sum())
    assert e["px"] == pytest.approx((p["mass"] * p["vx"]).sum(), abs=1e-5)
    x, m, u = p[["x", "y", "z"]].to_numpy(), p["mass"].to_numpy(), 0.0
    for i in range(n):
        d = x[i + 1 :] - x[i]
        d -= 1000 * np.round(d / 1000)
        u -= (m[i] * m[i + 1 :] / np.sqrt((d * d).sum(1) + 0.01)).sum()
    assert e["potential"] == pytest.approx(u, rel=0.02)


@pytest.mark.parametrize("periodic", [False, True])
def test_blocks_of_the_tree_do_not_change_it(bodies, monkeypatch, periodic):
    one = {r["id"]: r for r in fo.tree_force(bodies, 10.0, capacity=2, periodic=periodic).collect()}
    monkeypatch.setattr(fo, "BLOCK", 4)
    many = {r["id"]: r for r in fo.tree_force(bodies, 10.0, capacity=2, periodic=periodic).collect()}
    assert set(one) == set(many) == set(range(60))
    for i in one:
        assert one[i]["terms"] == many[i]["terms"] and tuple(one[i])[1:5] == pytest.approx(tuple(many[i])[1:5], rel=1e-9, abs=1e-12)


def test_nfw_fit_takes_members_beyond_the_virial_radius_and_over_the_box_edge(spark):
    c, r_vir, n = 5.0, 1.0, 2000
    grid = np.linspace(0, 3, 20001)
    mu = np.log1p(c * grid) - c * grid / (1 + c * grid)
    d = np.interp((np.arange(n) + 0.5) / n, mu / mu[-1], grid)
    way = np.random.default_rng(3).normal(0, 1, (n, 3))
    way /= np.sqrt((way * way).sum(1))[:, None]
    at = np.mod(d[:, None] * way, 100.0)  # about the corner of the box
    p = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "mass": 1.0}))
    centre = spark.createDataFrame([(0, 0.0, 0.0, 0.0, r_vir)], "halo_id long, comx double, comy double, comz double, r_vir double")
    r = ha.nfw_fit(p.select(F.lit(0).cast("long").alias("halo_id"), "id"), p, centre, 100.0).first()
    assert r["n"] == n and r["beyond"] == (d > r_vir).sum() and r["r_max"] == pytest.approx(d.max())
    assert r["concentration"] == pytest.approx(c, rel=0.1) and r["rs"] == pytest.approx(r_vir / c, rel=0.1) and r["rms"] < 0.02
