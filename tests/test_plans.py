import pytest
from pyspark.sql import functions as F

from starloom.plans.components import Registry
from starloom.plans.config import Config
from starloom.plans.methods import recommend, spark_method
from starloom.operators import initial as ic
from starloom.plans.components import builtin
from starloom.plans.simulation import Builder
from starloom.sources import snapshots as sn
from starloom.sources.generators import random_particles, uniform_grid_points
from starloom.streaming.monitor import monitor


def test_config(tmp_path):
    c = Config({"physics": {"box": 100, "name": "x"}})
    assert c.get("physics.box", 1.0) == 100.0 and c.get("physics.name", 3) == 3 and c.get("a.b", "d") == "d"
    c.set("time.dt", 0.5)
    assert c.has("time.dt") and not c.has("time.dt.x")
    with pytest.raises(ValueError):
        c.set("time.dt.x", 1)
    c.save(tmp_path / "c.json")
    d = Config.load(tmp_path / "c.json").merge(Config({"physics": {"box": 5}}))
    assert d.get("physics.box") == 5 and d.get("physics.name") == "x"
    assert d.validate({"physics.box": int, "physics.name": int, "q": str}) == ["physics.name is not int", "q is missing"]


def test_registry_orders_dependencies():
    r = Registry()
    r.register("force", "tree", lambda: "t", ("cosmology",))
    r.register("model", "cosmology", lambda: "c")
    assert r.order() == ["cosmology", "tree"] and r.create_all() == {"cosmology": "c", "tree": "t"} and r.names("force") == ["tree"]
    with pytest.raises(ValueError):
        r.register("force", "tree", lambda: 1)
    with pytest.raises(KeyError):
        r.create("force", "none")
    r.register("model", "a", lambda: 1, ("b",))
    r.register("model", "b", lambda: 1, ("a",))
    with pytest.raises(ValueError):
        r.order()


def test_methods():
    assert recommend("TREE", 200_000).theta == 0.7 and recommend("PARTICLE_MESH", 8000).grid == 10
    assert spark_method(100) == "direct" and spark_method(10**6) == "tree"


def test_simulation_steps_observers_and_output(spark, tmp_path):
    seen = []
    sim = Builder(spark).particles(20, 7).settings(dt=0.01, box=100.0, output=str(tmp_path), every=1).observe(lambda e, s: seen.append((e, s.step))).build()
    sim.run_steps(2)
    assert [e for e in seen if e[0] != "step_start"] == [("start", 0), ("step", 1), ("step", 2), ("end", 2)] and sim.time == pytest.approx(0.02) and len(sim.stats) == 2
    back = sn.import_snapshot(spark, f"{tmp_path}/step=2", sim.bodies.schema)
    assert back.count() == 20 and sn.metadata(spark, f"{tmp_path}/step=2")["a"] == 1.0
    sim.pause()
    sim.run_steps(1)
    assert sim.step == 2 and seen[-1] == ("pause", 2)
    sim.resume()
    sim.run_until(0.03)
    assert sim.step == 3 and sim.time == pytest.approx(0.03)
    sim.stop()
    sim.run_steps(1)
    assert sim.step == 3 and "steps: 3" in sim.summary()
    sim.reset()
    assert (sim.step, sim.time, sim.stats) == (0, 0.0, [])
    with pytest.raises(ValueError):
        Builder(spark).build()
    with pytest.raises(ValueError):
        Builder(spark).settings(nonsense=1)


def test_sources_are_repeatable(spark):
    a, b = random_particles(spark, 100, 10.0, 3), random_particles(spark, 100, 10.0, 3)
    assert a.exceptAll(b).count() == 0
    assert a.where((F.col("x") < 0) | (F.col("x") >= 10)).count() == 0
    assert uniform_grid_points(spark, 3, 1.0, 1).count() == 27


def test_spectrum_text(spark, tmp_path):
    ps = spark.createDataFrame([(0, 0.5, 1.0, 0), (1, 1.5, 8.0, 4)], "bin int, k double, power double, modes long")
    sn.save_spectrum(ps, f"{tmp_path}/ps", 100.0, 16, 0.5)
    assert [tuple(r) for r in sn.load_spectrum(spark, f"{tmp_path}/ps").collect()] == [(1.5, 8.0, 4, 4.0)]
    with pytest.raises(ValueError):
        sn.export_snapshot(ps, f"{tmp_path}/x", "hdf5")


def test_stream_of_snapshots(spark, tmp_path):
    rows = random_particles(spark, 10, 10.0, 1).select(F.lit(1).alias("step"), "*")
    rows.write.parquet(f"{tmp_path}/in", mode="append")
    monitor(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    rows.withColumn("step", F.lit(2)).write.parquet(f"{tmp_path}/in", mode="append")
    monitor(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    last = spark.read.parquet(f"{tmp_path}/out/batch=1").orderBy("step").collect()
    assert [(r["step"], r["n"]) for r in last] == [(1, 10), (2, 10)]


def test_a_file_starts_and_restarts_a_run(spark, tmp_path):
    Config({
        "particles": {"num_particles": 12, "box_size": 50.0, "seed": 5, "generator": "zeldovich"}, "integration": {"time_step": 0.02, "max_time": 0.06},
        "forces": {"method": "tree", "softening": 0.2}, "output": {"directory": f"{tmp_path}/out", "every": 1}, "cosmology": {"om": 0.3, "ol": 0.7},
    }).save(f"{tmp_path}/run.json")
    sim = Builder(spark).config(f"{tmp_path}/run.json").build()
    assert (sim.n, sim.box, sim.method, sim.cosmo.om, sim.eps) == (12, 50.0, "tree", 0.3, 0.2)
    sim.run()
    assert sim.step == 3
    again = Builder(spark).config(f"{tmp_path}/run.json").snapshot(f"{tmp_path}/out/step=2").build()
    assert again.step == 2 and again.time == pytest.approx(0.04) and again.a == pytest.approx(sim.stats[1]["a"])
    again.run()
    order = lambda s: [tuple(round(v, 9) for v in r) for r in s.bodies.orderBy("id").select("x", "y", "z", "vx", "vy", "vz").collect()]
    assert again.step == 3 and order(again) == order(sim)
    sim.load(f"{tmp_path}/out/step=1")
    assert sim.step == 1 and sim.time == pytest.approx(0.02)


def test_warnings_errors_and_plug_ins(spark):
    registry, seen = builtin(), []
    registry.register("force", "none", lambda **_: lambda b: b.select("id", *[F.lit(0.0).alias(f"a{x}") for x in "xyz"]))
    registry.register("force", "broken", lambda **_: lambda b: b.select("nothing"))
    make = lambda name: Builder(spark, registry).particles(5).force(name).observe(lambda e, s: seen.append(e)).build()
    sim = make("none")
    before = sim.bodies.select("id", "vx").collect()
    sim.run_steps(1)
    assert sorted(sim.bodies.select("id", "vx").collect()) == sorted(before) and sim.check()["net"] == 0 and sim.stable()
    sim.bodies = sim.bodies.withColumn("x", F.when(F.col("id") == 1, F.lit(float("nan"))).otherwise(F.col("x")))
    assert not sim.stable() and seen[-1] == "warning"
    with pytest.raises(Exception):  # noqa: B017
        make("broken").run_steps(1)
    assert seen[-1] == "error"
    with pytest.raises(KeyError):
        make("unknown")
    adaptive = Builder(spark).particles(5).settings(adaptive=True, eps=1e-6, dt=10.0).build()
    adaptive.advance()
    assert 0 < adaptive.time < 10.0


def test_initial_particles_of_a_custom_power(spark):
    s = ic.Start(n=4, power=lambda k: k * 0.0 + 1.0)
    flat = ic.table(spark, s).agg(F.min("p"), F.max("p")).first()
    assert flat[0] == flat[1] == 1.0
    p = ic.particles(spark, s, 70)
    assert p.count() == 70 and p.select("x", "y", "z").distinct().count() == 64


def test_summary_of_a_configuration():
    assert Config({"b": {"c": 1}, "a": 2}).summary() == "a: 2\nb.c: 1"
