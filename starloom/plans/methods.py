"""Choice of force method by size, as a rule and as a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def choose(n: Column, gpu: Column, compiled: Column) -> Column:
    """DIRECT below 1000; up to 100,000 TREE with an accelerator, else DIRECT; beyond, TENSORRT if there, else TREE."""
    mid = F.when(gpu, F.lit("TREE")).otherwise(F.lit("DIRECT"))
    return F.when(n < 1000, F.lit("DIRECT")).when(n < 100_000, mid).when(compiled, F.lit("TENSORRT")).otherwise(F.lit("TREE"))


@dataclass(frozen=True)
class Settings:
    method: str
    theta: float = 0.5
    capacity: int = 8
    grid: int = 0
    accelerated: bool = False


def recommend(method: str, n: int) -> Settings:
    """Parameters for a method at n records."""
    if method == "TREE":
        return Settings(method, theta=0.7 if n > 100_000 else 0.5, accelerated=True)
    if method == "PARTICLE_MESH":
        return Settings(method, grid=int(round((n / 8.0) ** (1 / 3), 9)), accelerated=True)
    return Settings(method, accelerated=method == "TENSORRT" or n > 1000)


def spark_method(n: int, tile: int = 20_000) -> str:
    """Advice on the force computer for n records: exact sums, or trees where those take too long. Nothing follows it by itself."""
    return "direct" if n <= tile else "tree"
