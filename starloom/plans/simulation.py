"""Simulations: a builder, a step loop over DataFrames, observers, snapshots, restarts."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.cosmology import Cosmology
from starloom.operators import forces as fo
from starloom.plans.components import Leapfrog, LambdaCdm, Registry, Snapshots, builtin
from starloom.plans.config import Config
from starloom.runtime import Scratch

EVENTS = ("start", "step_start", "step", "warning", "error", "pause", "end")
BODY = "id bigint, x double, y double, z double, vx double, vy double, vz double, mass double"


@dataclass
class Simulation:
    """State of a run. ``run_steps`` and ``run_until`` advance it; every step is a written table.

    ``method`` names the force computer and never changes by itself: :func:`starloom.plans.methods.spark_method` gives
    advice by size. With ``adaptive`` a step is no longer than the integrator recommends.
    """

    bodies: DataFrame
    dt: float = 0.01
    box: float = 100.0
    eps: float = 0.1
    theta: float = 0.5
    grid: int = 64
    cosmo: Cosmology | None = None
    a: float = 1.0
    method: str = "direct"
    integrator: str = "leapfrog"
    exporter: str = "parquet"
    adaptive: bool = False
    output: str | None = None
    every: int = 10
    max_time: float = 1.0
    time: float = 0.0
    step: int = 0
    registry: Registry = field(default_factory=builtin)
    stats: list[dict] = field(default_factory=list)
    observers: list[Callable[[str, "Simulation"], None]] = field(default_factory=list)
    message: str = ""

    def __post_init__(self) -> None:
        self._scratch = Scratch(self.bodies.sparkSession, "simulation")
        self._field = self.registry.create("force", self.method, box=self.box, eps=self.eps, theta=self.theta, grid=self.grid)
        self._integrate: Leapfrog = self.registry.create("integrator", self.integrator)
        self._export: Snapshots = self.registry.create("exporter", self.exporter)
        self.bodies = self._scratch.keep(self.bodies)
        self._first = (self.bodies, self.time, self.step, self.a)
        self.paused = self.stopped = False

    @property
    def redshift(self) -> float:
        return 1.0 / self.a - 1.0

    @property
    def n(self) -> int:
        return self.bodies.count()

    def _tell(self, event: str) -> None:
        for o in self.observers:
            o(event, self)

    def warn(self, message: str) -> None:
        self.message = message
        self._tell("warning")

    def accelerate(self, df: DataFrame) -> DataFrame:
        return self._field(df)

    def check(self) -> dict[str, Any]:
        """Unusable or missing accelerations and the net force; a warning where there are any of the first."""
        found = fo.validate(self.accelerate(self.bodies), self.bodies).first().asDict()
        if found["unusable"] or found["missing"]:
            self.warn(f"{found['unusable']} unusable and {found['missing']} missing accelerations")
        return found

    def stable(self) -> bool:
        """Whether every place and velocity is a number; else a warning."""
        bad = F.lit(False)
        for c in ("x", "y", "z", "vx", "vy", "vz"):
            bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        lost = self.bodies.where(bad).count()
        if lost:
            self.warn(f"{lost} bodies have no usable place or velocity")
        return not lost

    def advance(self) -> None:
        self._tell("step_start")
        began, dt = time.perf_counter(), self.dt
        if self.adaptive:
            dt = min(dt, self._integrate.recommended(self.bodies, self.accelerate, self.eps))
        new = self._scratch.keep(self._integrate(self.bodies, dt, self.accelerate, self.box))
        if self.bodies is not self._first[0]:
            self._scratch.drop(self.bodies)
        self.bodies = new
        self.step += 1
        self.time += dt
        if self.cosmo:
            self.a = LambdaCdm(self.cosmo).advance(self.a, dt)
        self.stats.append({"step": self.step, "time": self.time, "a": self.a, "dt": dt, "method": self.method, "seconds": time.perf_counter() - began})
        if self.output and self.step % self.every == 0:
            self.save(f"{self.output}/step={self.step}")
        self._tell("step")

    def run_steps(self, n: int) -> None:
        self._run(lambda done: done < n)

    def run_until(self, t: float) -> None:
        """Steps until the time is reached, to half a step."""
        self._run(lambda _: self.time < t - self.dt / 2)

    def run(self) -> None:
        self.run_until(self.max_time)

    def _run(self, more: Callable[[int], bool]) -> None:
        self._tell("start")
        done = 0
        try:
            while more(done) and not (self.stopped or self.paused):
                self.advance()
                done += 1
        except Exception as e:
            self.message = str(e)
            self._tell("error")
            raise
        self._tell("pause" if self.paused and more(done) else "end")

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def stop(self) -> None:
        self.stopped = True

    def reset(self) -> None:
        """Back to the bodies and the time it was built with."""
        self.bodies, self.time, self.step, self.a = self._first
        self.stats.clear()
        self.paused = self.stopped = False

    def save(self, path: str) -> None:
        self._export.write(self.bodies, path, {"time": self.time, "a": self.a, "step": float(self.step), "dt": self.dt, "box": self.box})

    def load(self, path: str) -> None:
        """Goes on from a snapshot."""
        rows, meta = self._export.read(self.bodies.sparkSession, path, self.bodies.schema)
        self.bodies = self._scratch.keep(rows)
        self.time, self.a, self.step = meta["time"], meta["a"], int(meta["step"])
        self.paused = self.stopped = False

    def summary(self) -> str:
        """The run in a few lines."""
        spent = sum(s["seconds"] for s in self.stats)
        return "\n".join([
            f"bodies: {self.n}, box: {self.box}, method: {self.method}, integrator: {self.integrator}",
            f"steps: {self.step}, time: {self.time:g}, redshift: {self.redshift:g}",
            f"seconds: {spent:.2f}, per step: {spent / max(1, len(self.stats)):.2f}",
        ])


#: Where a configuration file holds the settings.
KEYS = {
    "box": "particles.box_size", "dt": "integration.time_step", "max_time": "integration.max_time", "adaptive": "integration.adaptive",
    "integrator": "integration.method", "method": "forces.method", "eps": "forces.softening", "theta": "forces.theta",
    "grid": "forces.grid_size", "output": "output.directory", "every": "output.every", "exporter": "output.format",
}


class Builder:
    """Collects settings; ``build`` generates or takes the particles and makes the simulation. Settings given in code go
    before those of a file."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None):
        self._spark, self._registry = spark, registry or builtin()
        self._n, self._seed, self._generator, self._bodies, self._set, self._from = 0, 0, "random", None, {}, None

    def config(self, values: str | Path | Config) -> Builder:
        """A JSON file or a configuration, with the keys of KEYS, ``particles`` (num_particles, seed, generator) and
        ``cosmology`` (om, ol, ok, h, ns, s8)."""
        c = values if isinstance(values, Config) else Config.load(values)
        there = {name: c.get(key) for name, key in KEYS.items() if c.has(key)}
        if c.has("cosmology"):
            there["cosmo"] = Cosmology(**c.get("cosmology"))
        self._set = there | self._set
        self._n = self._n or c.get("particles.num_particles", 0)
        self._seed = self._seed or c.get("particles.seed", 0)
        if c.has("particles.generator"):
            self._generator = c.get("particles.generator")
        return self

    def particles(self, n: int, seed: int = 0, generator: str = "random") -> Builder:
        self._n, self._seed, self._generator = n, seed, generator
        return self

    def bodies(self, df: DataFrame) -> Builder:
        self._bodies = df
        return self

    def snapshot(self, path: str) -> Builder:
        """Starts from a snapshot, with its time, step and scale factor."""
        self._from = path
        return self

    def settings(self, **values) -> Builder:
        unknown = set(values) - {f.name for f in fields(Simulation)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        self._set |= values
        return self

    def force(self, name: str) -> Builder:
        return self.settings(method=name)

    def observe(self, f: Callable[[str, Simulation], None]) -> Builder:
        self._set.setdefault("observers", []).append(f)
        return self

    def build(self) -> Simulation:
        settings = {"registry": self._registry} | self._set
        bodies = self._bodies
        if bodies is None and self._from is not None:
            export = self._registry.create("exporter", settings.get("exporter", "parquet"))
            bodies, meta = export.read(self._spark, self._from, BODY)
            settings = {"time": meta["time"], "a": meta["a"], "step": int(meta["step"])} | settings
        if bodies is None:
            if self._n < 1:
                raise ValueError("no particles")
            bodies = self._registry.create("generator", self._generator)(self._spark, self._n, settings.get("box", 100.0), self._seed)
        return Simulation(bodies, **settings)
