"""Named components with dependencies, the protocols they follow, and the built-in ones."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import cosmology as co
from starloom.operators import forces as fo
from starloom.operators import initial as ic
from starloom.operators import integrate as it
from starloom.sources import snapshots as sn
from starloom.sources.generators import random_particles, standard_particles


class ForceComputer(Protocol):
    """(id, ax, ay, az) of bodies."""

    def __call__(self, bodies: DataFrame) -> DataFrame: ...


class PairKernel(Protocol):
    """The pull along a pair's distance vector, from masses and the softened squared distance."""

    def __call__(self, mass1: Column, mass2: Column, r2: Column) -> Column: ...


class Generator(Protocol):
    def __call__(self, spark: SparkSession, n: int, box: float, seed: int) -> DataFrame: ...


class Integrator(Protocol):
    """One step of bodies in the field of a force computer."""

    symplectic: bool

    def __call__(self, bodies: DataFrame, dt: float, field: ForceComputer, box: float | None) -> DataFrame: ...

    def recommended(self, bodies: DataFrame, field: ForceComputer, eps: float) -> float: ...


class CosmologyModel(Protocol):
    """Background quantities as columns of the scale factor, and the scale factor after a step."""

    def hubble(self, a: Column) -> Column: ...

    def growth(self, a: Column) -> Column: ...

    def matter(self, a: Column) -> Column: ...

    def dark(self, a: Column) -> Column: ...

    def advance(self, a: float, dt: float) -> float: ...


class Exporter(Protocol):
    formats: tuple[str, ...]

    def write(self, bodies: DataFrame, path: str, meta: dict[str, float]) -> None: ...

    def read(self, spark: SparkSession, path: str, schema: Any) -> tuple[DataFrame, dict[str, float]]: ...


class Registry:
    """Factories by type and name. ``create_all`` builds in order of dependency and refuses cycles."""

    def __init__(self) -> None:
        self._made: dict[tuple[str, str], tuple[Callable[..., Any], tuple[str, ...]]] = {}

    def register(self, kind: str, name: str, factory: Callable[..., Any], needs: tuple[str, ...] = ()) -> None:
        if (kind, name) in self._made:
            raise ValueError(f"{kind} {name} is there already")
        self._made[kind, name] = (factory, needs)

    def has(self, kind: str, name: str) -> bool:
        return (kind, name) in self._made

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._made if k == kind)

    def create(self, kind: str, name: str, **params: Any) -> Any:
        if not self.has(kind, name):
            raise KeyError(f"no {kind} is called {name}; there are {', '.join(self.names(kind)) or 'none'}")
        return self._made[kind, name][0](**params)

    def order(self) -> list[str]:
        return list(TopologicalSorter({n: needs for (_, n), (_, needs) in self._made.items()}).static_order())

    def create_all(self) -> dict[str, Any]:
        by_name = {n: f for (_, n), (f, _) in self._made.items()}
        return {n: by_name[n]() for n in self.order() if n in by_name}


# ---- built-in components


@dataclass(frozen=True)
class LambdaCdm:
    """A cosmology model over :class:`starloom.functions.cosmology.Cosmology`."""

    cosmo: co.Cosmology = co.Cosmology()

    def hubble(self, a: Column) -> Column:
        return co.hubble(self.cosmo, a)

    def growth(self, a: Column) -> Column:
        return co.growth(self.cosmo, a)

    def matter(self, a: Column) -> Column:
        return co.omega_m(self.cosmo, a)

    def dark(self, a: Column) -> Column:
        return co.omega_l(self.cosmo, a)

    def advance(self, a: float, dt: float) -> float:
        c = self.cosmo
        return a + a * c.h0 * (c.om / a**3 + c.ok / a**2 + c.ol) ** 0.5 * dt


class Leapfrog:
    """Kick, drift, kick."""

    symplectic = True

    def __call__(self, bodies: DataFrame, dt: float, field: ForceComputer, box: float | None = None) -> DataFrame:
        return it.kdk(bodies, dt, field, box)

    def recommended(self, bodies: DataFrame, field: ForceComputer, eps: float) -> float:
        """A fortieth of the time in which the strongest acceleration crosses the softening length; 0.01 at rest."""
        a2 = F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az")
        top = field(bodies).agg(F.max(F.sqrt(a2))).first()[0] or 0.0
        return 0.025 * (eps / top) ** 0.5 if top > 0 and eps > 0 else 0.01


class Snapshots:
    formats = sn.FORMATS

    def __init__(self, fmt: str = "parquet"):
        if fmt not in self.formats:
            raise ValueError(f"formats are {', '.join(self.formats)}")
        self.fmt = fmt

    def write(self, bodies: DataFrame, path: str, meta: dict[str, float]) -> None:
        sn.export_snapshot(bodies, path, self.fmt, meta)

    def read(self, spark: SparkSession, path: str, schema: Any) -> tuple[DataFrame, dict[str, float]]:
        return sn.import_snapshot(spark, path, schema, self.fmt), sn.metadata(spark, path)


def newton(mass1: Column, mass2: Column, r2: Column) -> Column:
    return mass1 * mass2 / (r2 * F.sqrt(r2))


def hybrid(bodies: DataFrame, box: float, eps: float, theta: float, grid: int, near: int = 1000) -> DataFrame:
    """Exact sums for systems below ``near`` bodies, else the periodic tree: the caller's choice by this name."""
    if bodies.count() < near:
        return fo.direct(bodies, bodies, eps, box)
    return fo.tree_force(bodies, box, theta, eps, periodic=True)


def _zeldovich(order: int) -> Generator:
    def make(spark: SparkSession, n: int, box: float, seed: int) -> DataFrame:
        grid = max(2, math.ceil(round(n ** (1 / 3), 9)))
        return ic.particles(spark, ic.Start(n=grid, box=box), n, order, seed=seed)

    return make


def builtin() -> Registry:
    """The components that come with this package: forces ``direct``, ``tree``, ``mesh`` and ``hybrid``, generators, the
    leapfrog, the standard cosmology, snapshot writers and the pair kernel."""
    r = Registry()
    r.register("force", "direct", lambda box, eps=0.1, **_: lambda b: fo.direct(b, b, eps, box))
    r.register("force", "tree", lambda box, eps=0.1, theta=0.5, **_: lambda b: fo.tree_force(b, box, theta, eps, periodic=True))
    r.register("force", "mesh", lambda box, grid=64, **_: lambda b: fo.mesh_force(b, grid, box))
    r.register("force", "hybrid", lambda box, eps=0.1, theta=0.5, grid=64, **_: lambda b: hybrid(b, box, eps, theta, grid))
    r.register("generator", "random", lambda **_: lambda spark, n, box, seed: random_particles(spark, n, box, seed))
    r.register("generator", "standard", lambda om=0.31, **_: lambda spark, n, box, seed: standard_particles(spark, n, box, seed, om))
    r.register("generator", "zeldovich", lambda **_: _zeldovich(1))
    r.register("generator", "second_order", lambda **_: _zeldovich(2))
    r.register("integrator", "leapfrog", lambda **_: Leapfrog())
    r.register("cosmology", "lambda_cdm", lambda **p: LambdaCdm(co.Cosmology(**p)))
    r.register("kernel", "newton", lambda **_: newton)
    for fmt in Snapshots.formats:
        r.register("exporter", fmt, lambda fmt=fmt, **_: Snapshots(fmt))
    return r
