"""Softened open sums over all pairs of a large catalogue, to the roundings of a direct sum.

The kernel 1/R, R^2 = r^2 + eps^2, is cut into a part that vanishes beyond a reach and a smooth rest without waves shorter
than the mesh resolves. Near pairs are summed pair by pair; the rest of all pairs, self pairs included, is one convolution
on a mesh that records are spread to and read from. Near pairs and self pairs take their share of the rest back out. No pair
is left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESH = 160  # points an axis; the doubled mesh is transformed within one task
POINTS = 22  # of the mesh that a record is spread to, an axis
OVER = 1.12  # mesh waves for each that is kept
SHAPE = 28.0  # of the cut; e to its negative is what is lost
DEGREE = 22  # of the smooth part as a polynomial in R^2 within the reach
SLAB = 12  # mesh cells along x that are spread and read together; TILE cells along every axis at a time
TILE = 12
TARGETS, PAIRS = 128, 1 << 16  # records that meet others together, and pairs at a time
CLOSE = 0.01  # squared share of the reach below which a pair is taken by differences
AHEAD = (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)  # of nine columns: each pair of columns once
COLS = ["id", "x", "y", "z", "mass"]


def _bell(v: np.ndarray, shape: float) -> np.ndarray:
    return np.i0(shape * np.sqrt(np.maximum(1 - v * v, 0.0))) / np.i0(shape)


def _bell_waves(k: np.ndarray, shape: float) -> np.ndarray:
    """Fourier transform of :func:`_bell` over [-1, 1]."""
    q = np.sqrt((shape * shape - k * k).astype(complex))
    return 2 * np.where(q == 0, 1.0, np.sinh(q) / np.where(q == 0, 1.0, q)).real / np.i0(shape)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(100)


def _part(v: np.ndarray, shape: float) -> np.ndarray:
    """Integral of the bell from 0 to v over that from 0 to 1, divided by v (0 to 1)."""
    u = (_NODES + 1) / 2
    return (_bell(v[:, None] * u, shape) @ _WEIGHTS) / (_bell(u, shape) @ _WEIGHTS)


@dataclass(frozen=True)
class Mesh:
    """Geometry of the cut: low corner, spacing, points an axis, softening."""

    low: tuple[float, float, float]
    step: float
    points: int
    eps: float

    @property
    def reach(self) -> float:
        return SHAPE * OVER / np.pi * self.step

    @cached_property
    def smooth(self) -> tuple[np.ndarray, np.ndarray]:
        """Powers of t = 2 R^2 / reach^2 - 1 for the smooth part of 1/R and for its doubled slope in R^2."""
        cheb = np.polynomial.chebyshev.Chebyshev.interpolate(lambda t: _part(np.sqrt((t + 1) / 2), SHAPE) / self.reach, DEGREE)
        power = cheb.convert(kind=np.polynomial.Polynomial).coef
        return power, 4 / self.reach**2 * np.polynomial.polynomial.polyder(power)

    @cached_property
    def window(self) -> tuple[np.ndarray, float]:
        """Powers of t = 2 f - 1, f the place within a mesh cell, for the weights of the POINTS around, and their shape."""
        shape, n = np.pi * POINTS * (1 - 0.5 / OVER), 20
        t = np.cos((np.arange(n) + 0.5) * np.pi / n)
        at = (t[:, None] + 1) / 2 - (np.arange(POINTS) - POINTS // 2 + 1)
        return np.linalg.solve(np.polynomial.chebyshev.chebvander(t, n - 1), _bell(at * 2 / POINTS, shape)), shape

    def place(self, x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
        u = (x - self.low[axis]) / self.step + POINTS // 2
        return (c := np.floor(u)).astype(np.int64), u - c

    def weights(self, x: np.ndarray, axis: int, first: int, width: int, slope: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(n, width) weights of the mesh points from ``first`` on and their slopes."""
        cell, f = self.place(x, axis)
        coef, _ = self.window
        at = (cell - (POINTS // 2 - 1) - first)[:, None] + np.arange(POINTS)
        v, rows = np.polynomial.chebyshev.chebvander(2 * f - 1, len(coef) - 1), np.arange(len(x))[:, None]
        out = np.zeros((len(x), width))
        out[rows, at] = v @ coef
        if not slope:
            return out, None
        d = np.polynomial.chebyshev.chebder(coef)
        by = np.zeros((len(x), width))
        by[rows, at] = v[:, : len(d)] @ d * (2 / self.step)
        return out, by

    def waves(self) -> np.ndarray:
        """The smooth part's spectrum on the doubled mesh, (points + 1)^3, divided by that of the window, twice."""
        g, h = self.points, self.step
        q = 3 * g // 2
        far = np.sqrt(3.0) * g  # the kernel is whole up to there and gone where the mesh's next image begins
        mid, half = (far + 2 * q - g) / 2, (2 * q - g - far) / 2
        fade = np.polynomial.chebyshev.Chebyshev.interpolate(lambda v: 0.5 - 0.5 * v * _part(np.abs(v), SHAPE), 80)
        n, kept = np.arange(2 * q - g + 1, dtype=float), int(q / OVER) + 1  # waves beyond are lost in roundings
        turn, ends, m = np.cos(np.pi / q * np.outer(n[:kept], n)), np.where(n == 0, 1.0, 2.0), np.arange(g + 1)
        to = turn * ends
        out = np.empty((len(n), kept, kept))
        for i in range(len(n)):
            r2 = n[i] ** 2 + n[:, None] ** 2 + n**2
            big = np.sqrt(r2 * h * h + self.eps**2)
            v = 1.0 / np.maximum(big, 1e-300)
            near = big < self.reach
            if near.any():
                v[near] = np.polynomial.polynomial.polyval(2 * (big[near] / self.reach) ** 2 - 1, self.smooth[0])
            at = (np.sqrt(r2) - mid) / half
            v[at >= 1] = 0.0
            mix = np.abs(at) < 1
            v[mix] *= fade(at[mix])
            out[i] = to @ v @ to.T
        out = np.tensordot(to, out, (1, 0))
        k2 = n[:kept] ** 2
        wave = _bell_waves(np.pi / q * n[:kept] * POINTS / 2, self.window[1]) * POINTS / 2
        for i in range(kept):
            out[i] *= np.where(k2[i] + k2[:, None] + k2 < (q / OVER) ** 2, 1.0, 0.0) / (wave[i] * wave[:, None] * wave) ** 2
        # back for the offsets that occur, and on to the waves of the doubled mesh
        again = np.cos(np.pi / g * np.outer(m, m)) * np.where((m == 0) | (m == g), 1.0, 2.0)
        through = again @ (turn[:, : g + 1].T * ends[:kept] / (2 * q))
        part = np.empty((kept, g + 1, g + 1))
        for i in range(kept):
            part[i] = through @ out[i] @ through.T
        return np.tensordot(through, part, (1, 0))

    def convolve(self, rho: np.ndarray) -> np.ndarray:
        """The smooth potential on the mesh of the masses spread to it."""
        g = self.points
        f = np.fft.fft(np.fft.rfft(rho, 2 * g, axis=2), 2 * g, axis=1)
        waves, fold = self.waves(), np.minimum(np.arange(2 * g), 2 * g - np.arange(2 * g))
        for j in range(0, 2 * g, 16):
            line = np.fft.fft(f[:, j : j + 16], 2 * g, axis=0)
            line *= waves[fold][:, fold[j : j + 16]]
            f[:, j : j + 16] = np.fft.ifft(line, axis=0)[:g]
        out = np.empty((g, g, g))
        for i in range(g):
            out[i] = np.fft.irfft(np.fft.ifft(f[i], axis=0)[:g], 2 * g, axis=1)[:, :g]
        return out

    def first(self, slab: int) -> int:
        """The first plane that a slab's records reach."""
        return slab * SLAB - (POINTS // 2 - 1)

    def planes(self, slab: int) -> range:
        return range(max(self.first(slab), 0), min(self.first(slab) + SLAB + POINTS - 1, self.points))

    def _tiles(self, x: np.ndarray, slab: int):
        """(rows, first points) of the records of every tile of a slab."""
        at = [np.zeros(len(x), np.int64), *[self.place(x[:, a], a)[0] // TILE for a in (1, 2)]]
        key = at[1] * (1 << 20) + at[2]
        order = np.argsort(key, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(rows):
                yield rows, [self.first(slab), *[int(at[a][rows[0]]) * TILE - (POINTS // 2 - 1) for a in (1, 2)]]

    def spread(self, x: np.ndarray, mass: np.ndarray, slab: int) -> tuple[int, np.ndarray]:
        """First plane and planes that the masses of a slab reach."""
        w, pad = SLAB + POINTS - 1, TILE + POINTS
        out = np.zeros((w, self.points + 2 * pad, self.points + 2 * pad))
        for rows, (i, j, k) in self._tiles(x, slab):
            for part in np.array_split(rows, -(-len(rows) // 2048)):
                wx, wy, wz = (self.weights(x[part, a], a, f, n)[0] for a, f, n in ((0, i, w), (1, j, TILE + POINTS - 1), (2, k, TILE + POINTS - 1)))
                both = (wx * mass[part, None])[:, :, None] * wy[:, None, :]
                cube = (both.reshape(len(part), -1).T @ wz).reshape(w, wy.shape[1], wz.shape[1])
                out[:, pad + j : pad + j + wy.shape[1], pad + k : pad + k + wz.shape[1]] += cube
        return self.first(slab), out[:, pad : pad + self.points, pad : pad + self.points]

    def read(self, x: np.ndarray, slab: int, planes: np.ndarray) -> np.ndarray:
        """(n, 4) accelerations and potentials of a slab's records from its planes of the smooth potential."""
        w, pad, out = SLAB + POINTS - 1, TILE + POINTS, np.zeros((len(x), 4))
        grid = np.zeros((w, self.points + 2 * pad, self.points + 2 * pad))
        grid[:, pad : pad + self.points, pad : pad + self.points] = planes
        for rows, (i, j, k) in self._tiles(x, slab):
            for part in np.array_split(rows, -(-len(rows) // 2048)):
                (wx, dx), (wy, dy), (wz, dz) = (self.weights(x[part, a], a, f, n, True) for a, f, n in ((0, i, w), (1, j, TILE + POINTS - 1), (2, k, TILE + POINTS - 1)))
                cube = grid[:, pad + j : pad + j + wy.shape[1], pad + k : pad + k + wz.shape[1]].reshape(-1, wz.shape[1])
                mean = cube.mean()  # its slope is left to no roundings
                a = (wz @ (cube - mean).T).reshape(len(part), w, -1)
                b = (dz @ (cube - mean).T).reshape(len(part), w, -1)
                y = np.matmul(a, wy[:, :, None])[:, :, 0]
                out[part, 0] = (dx * y).sum(1)
                out[part, 1] = (wx * np.matmul(a, dy[:, :, None])[:, :, 0]).sum(1)
                out[part, 2] = (wx * np.matmul(b, wy[:, :, None])[:, :, 0]).sum(1)
                out[part, 3] = -(wx * y).sum(1) - mean * wx.sum(1) * wy.sum(1) * wz.sum(1)
        return out

    def near(self, x: np.ndarray, ids: np.ndarray, own: int) -> np.ndarray:
        """(n, 4) short parts between the first ``own`` records (x, y, z, mass) and all, each pair once for both."""
        reach2, eps2 = self.reach**2, self.eps**2
        order = np.concatenate([_column_order(x[:own], self.reach), own + _column_order(x[own:], self.reach)])
        x, ids, out = x[order], ids[order], np.zeros((len(x), 4))
        power, slope = self.smooth
        starts = np.arange(0, own, TARGETS)
        for a in starts:
            b = min(a + TARGETS, own)
            t, acc = x[a:b], np.zeros((b - a, 4))
            lo, hi = t[:, :3].min(0), t[:, :3].max(0)
            mid = (lo + hi) / 2
            rest = x[b:, :3]
            gap = np.maximum(np.maximum(lo - rest, rest - hi), 0.0)
            some = b + np.flatnonzero((gap * gap).sum(1) + eps2 < reach2)
            u = t[:, :3] - mid
            left = np.column_stack([-2.0 * u, (u * u).sum(1) + eps2, np.ones(len(u))])
            m = np.column_stack([u * t[:, 3:], t[:, 3]])
            for at in [np.arange(a, b), *np.split(some, np.arange(PAIRS // (b - a), len(some), PAIRS // (b - a)))]:
                if not len(at):
                    continue
                other = at[0] >= b
                y = x[at]
                c = y[:, :3] - mid
                r2 = left @ np.vstack([c.T, np.ones(len(c)), (c * c).sum(1)])
                flat = r2.ravel()
                inside = np.flatnonzero(flat < reach2)
                s = flat[inside]
                tight = np.flatnonzero(s < CLOSE * reach2 + 2 * eps2)
                i, j = np.divmod(inside[tight], len(at))
                d = y[j, :3] - t[i, :3]
                s[tight] = exact = (d * d).sum(1) + eps2
                s2 = s * (2 / reach2) - 1
                with np.errstate(divide="ignore"):
                    w = 1.0 / np.sqrt(s)
                    g = w / s
                w[tight] = g[tight] = 0.0
                w -= _horner(power, s2)
                g += _horner(slope, s2)
                k = np.where((exact == 0) | (ids[a:b][i] == ids[at][j]), 0.0, 1.0 / np.sqrt(np.where(exact == 0, 1.0, exact)))
                p = np.zeros_like(flat)
                p[inside] = w
                p = p.reshape(r2.shape)
                flat[:] = 0.0
                flat[inside] = g
                f = (k / np.where(exact == 0, 1.0, exact))[:, None] * d
                acc[:, 3] -= p @ y[:, 3]
                v = r2 @ np.column_stack([c * y[:, 3:], y[:, 3]])
                acc[:, :3] += v[:, :3] - u * v[:, 3:]
                for q in range(3):
                    acc[:, q] += np.bincount(i, f[:, q] * y[j, 3], len(t))
                acc[:, 3] -= np.bincount(i, k * y[j, 3], len(t))
                if other:
                    v = r2.T @ m
                    v[:, :3] -= c * v[:, 3:]
                    v[:, 3] = -(t[:, 3] @ p)
                    for q in range(3):
                        v[:, q] -= np.bincount(j, f[:, q] * t[i, 3], len(at))
                    v[:, 3] -= np.bincount(j, k * t[i, 3], len(at))
                    out[at] += v
            out[a:b] += acc
        result = np.empty_like(out)
        result[order] = out
        return result


def _horner(power: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = power[-1] * t
    for c in power[-2:0:-1]:
        out += c
        out *= t
    out += power[0]
    return out


def _column_order(x: np.ndarray, reach: float) -> np.ndarray:
    """Order by cubes that hold about TARGETS records, along z within columns."""
    if not len(x):
        return np.zeros(0, np.int64)
    size = np.maximum(np.ptp(x[:, :3], axis=0), 1e-300)
    side = max((size.prod() * TARGETS / len(x)) ** (1 / 3), 1e-300)
    cut = np.maximum(np.rint(size[:2] / side), 1)
    at = [np.minimum((x[:, a] - x[:, a].min()) / size[a] * cut[a], cut[a] - 1).astype(np.int64) for a in (0, 1)]
    return np.lexsort((x[:, 2], at[1], at[0]))


def _partial(ids: np.ndarray, a: np.ndarray, want: tuple[str, ...]) -> pd.DataFrame:
    return pd.DataFrame({"id": ids, "ax": a[:, 0], "ay": a[:, 1], "az": a[:, 2], "phi": a[:, 3]})[["id", *want]]


def sums(rows: DataFrame, n: int, eps: float, want: tuple[str, ...]) -> list[DataFrame] | None:
    """Partial sums (id, and those ``want``ed) over all pairs of a kept table of n rows (id, x, y, z, mass).

    None where a direct sum is due: if ids repeat, values aren't finite, the softening isn't small, or records are so clumped
    that the near pairs are no small part.
    """
    finite = F.col("id").isNotNull()
    for c in COLS[1:]:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    ends = rows.agg(F.count(F.when(finite, 1)), *[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    if ends[0] < n or rows.groupBy("id").count().where("count > 1").limit(1).count():
        return None
    low, wide = tuple(ends[1::2]), max(hi - lo for lo, hi in zip(ends[1::2], ends[2::2]))
    if not 0 < wide < float("inf"):
        return None
    mesh = Mesh(low, wide / (MESH - POINTS - 1), MESH, eps)
    if eps > mesh.reach / 2:
        return None
    cell = {c: F.floor((F.col(c) - lo) / mesh.reach).cast("int") for c, lo in zip("xyz", low)}
    met = rows.groupBy(*[e.alias(c) for c, e in cell.items()]).count().agg(F.sum(F.col("count").cast("double") ** 2)).first()[0]
    if 2 * 27 * met > float(n) * n:
        return None
    out = "id bigint, " + ", ".join(f"{c} double" for c in want)
    side, slabs = int(wide / mesh.reach) + 1, -(-MESH // SLAB)

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "id"], ascending=[False, True])
        ids, own = pdf["id"].to_numpy(), int(pdf["own"].sum())
        return _partial(ids, mesh.near(pdf[COLS[1:]].to_numpy(float), ids, own), want) if own else _partial(ids[:0], np.zeros((0, 4)), want)

    at = [F.struct((cell["x"] - i).alias("i"), (cell["y"] - j).alias("j"), F.lit((i, j) == (0, 0)).alias("own")) for i, j in AHEAD]
    columns = rows.select(*COLS, F.inline(F.array(*at))).where(f"i >= 0 and j between 0 and {side - 1}").withColumn("column", F.col("i") * side + F.col("j"))
    short = columns.drop("i", "j").repartition(side * side, "column").groupBy("column").applyInPandas(near, out)

    def spread(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        first, planes = mesh.spread(pdf[COLS[1:4]].to_numpy(float), pdf["mass"].to_numpy(float), key[0])
        some = [i for i in range(len(planes)) if 0 <= first + i < mesh.points]
        return pd.DataFrame({"whole": 0, "slab": key[0], "plane": [first + i for i in some], "body": [planes[i].tobytes() for i in some]})

    def convolve(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = np.zeros((mesh.points,) * 3)
        pdf = pdf.sort_values(["slab", "plane"])
        for i, body in zip(pdf["plane"], pdf["body"]):
            rho[i] += np.frombuffer(body).reshape(rho.shape[1:])
        del pdf
        phi = mesh.convolve(rho)
        whose = [(s, i) for s in range(slabs) for i in mesh.planes(s)]
        return pd.DataFrame({"slab": [s for s, _ in whose], "plane": [i for _, i in whose], "body": [phi[i].tobytes() for _, i in whose]})

    def read(key: tuple, pdf: pd.DataFrame, field: pd.DataFrame) -> pd.DataFrame:
        planes = np.zeros((SLAB + POINTS - 1, mesh.points, mesh.points))
        for i, body in zip(field["plane"], field["body"]):
            planes[i - mesh.first(key[0])] = np.frombuffer(body).reshape(planes.shape[1:])
        return _partial(pdf["id"].to_numpy(), mesh.read(pdf[COLS[1:4]].to_numpy(float), key[0], planes), want)

    cut = rows.select(*COLS, F.floor((F.floor((F.col("x") - low[0]) / mesh.step + POINTS // 2)) / SLAB).cast("int").alias("slab")).repartition(slabs, "slab")
    field = cut.groupBy("slab").applyInPandas(spread, "whole int, slab int, plane int, body binary")
    field = field.groupBy("whole").applyInPandas(convolve, "slab int, plane int, body binary").repartition(slabs, "slab")
    return [cut.groupBy("slab").cogroup(field.groupBy("slab")).applyInPandas(read, out), short]
