"""Vector algebra on columns, periodic boxes, and Morton keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", names: str = "xyz") -> Vec:
    return tuple(F.col(prefix + n) for n in names)  # type: ignore[return-value]


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))  # type: ignore[return-value]


def subtract(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))  # type: ignore[return-value]


def scale(a: Vec, s) -> Vec:
    return tuple(p * s for p in a)  # type: ignore[return-value]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def wrap(x: Column, box: float) -> Column:
    """x modulo the box, for any number of boxes away. 0 where rounding gives the box itself."""
    w = x - F.lit(box) * F.floor(x / F.lit(box))
    return F.when((w >= F.lit(box)) & ~F.isnan(w), F.lit(0.0)).otherwise(w)


def min_image(d: Column, box: float) -> Column:
    """The shortest of a difference and its neighbours one box away, for |d| up to 1.5 boxes."""
    half = F.lit(box / 2)
    return F.when(d > half, d - F.lit(box)).when(d < -half, d + F.lit(box)).otherwise(d)


def spread_bits(i: Column) -> Column:
    """The ten low bits of an integer, two zero bits between each."""
    out = F.lit(0).cast("long")
    for b in range(10):
        out = out + F.shiftleft(F.shiftright(i, b).bitwiseAND(F.lit(1).cast("long")), 3 * b)
    return out


def lattice(x: Column, box: float, cells: int = 1024) -> Column:
    """Cell number along one axis, kept inside the grid."""
    return F.least(F.greatest(F.floor(x / F.lit(box) * cells), F.lit(0)), F.lit(cells - 1)).cast("long")


def morton(ix: Column, iy: Column, iz: Column, x_first: bool = True) -> Column:
    """Interleaved bits; ``x_first`` makes x the most significant of each triple, else the least."""
    x, y, z = spread_bits(ix), spread_bits(iy), spread_bits(iz)
    return x * 4 + y * 2 + z if x_first else x + y * 2 + z * 4


SPREAD_SQL = "({})".format(" + ".join(f"((({{0}} >> {b}) & 1) << {3 * b})" for b in range(10)))


def spread_sql(e: str) -> str:
    return SPREAD_SQL.format(e)
