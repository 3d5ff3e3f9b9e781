"""Gravity: direct sums in blocks, Barnes-Hut trees, particle-mesh, pair kernels, energies."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import ewald as ew
from starloom.operators import grid as gr
from starloom.operators.skew import prefix_sums
from starloom.runtime import Scratch

TILE = 4096  # most sources that go to every task, evaluated in slices of at most SLICE pairs
BLOCKS = 10  # that more of them are cut into, each of at least TILE and at most SPAN rows
SPAN = 1 << 18
MANY = 1 << 15  # records whose open potentials, in place of blocks, are split into near pairs and a mesh
STRIP = 256  # rows of two blocks that meet at a time
SLICE = 1 << 20
MESH = 32**3  # cells of a field that is broadcast
OUT = "id bigint, ax double, ay double, az double, phi double"


def _kernel(t: np.ndarray, tid: np.ndarray, s: np.ndarray, sid: np.ndarray, eps: float, box: float | None) -> np.ndarray:
    """Acceleration and potential at targets (n, 3) from sources (m, 4); equal ids don't act on each other."""
    out = np.zeros((len(t), 4))
    for at in range(0, len(t), step := max(1, SLICE // max(1, len(s)))):
        d = s[None, :, :3] - t[at : at + step, None, :]
        if box is not None:
            d = np.where(d > box / 2, d - box, np.where(d < -box / 2, d + box, d))
        r2 = (d * d).sum(-1) + eps * eps
        w = np.where((sid[None, :] == tid[at : at + step, None]) | (r2 == 0), 0.0, s[None, :, 3]) / np.sqrt(np.where(r2 == 0, 1.0, r2))
        out[at : at + step, :3] = (w / np.where(r2 == 0, 1.0, r2))[:, :, None].__mul__(d).sum(1)
        out[at : at + step, 3] = -w.sum(1)
    return out


def _frame(ids: np.ndarray, a: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"id": ids, "ax": a[:, 0], "ay": a[:, 1], "az": a[:, 2], "phi": a[:, 3]})


def _meet(tid: np.ndarray, sid: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By pair of strips: the places (target, source) within them that have equal ids."""
    order = np.argsort(sid, kind="stable")
    first = np.searchsorted(sid[order], tid, "left")
    n = np.searchsorted(sid[order], tid, "right") - first
    i = np.repeat(np.arange(len(tid)), n)
    j = order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for u, v in zip(i.tolist(), j.tolist()):
        at = found.setdefault((u // STRIP, v // STRIP), ([], []))
        at[0].append(u % STRIP)
        at[1].append(v % STRIP)
    return {k: (np.array(u), np.array(v)) for k, (u, v) in found.items()}


def _tiles(t: np.ndarray, tid: np.ndarray, s: np.ndarray, sid: np.ndarray, eps: float, box: float | None, both: bool, want: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Acceleration and potential at (n, 4) targets from (m, 4) sources and, with ``both``, of the sources from the targets;
    ``t is s`` counts each pair of one block once as well. Both are in an order that keeps neighbours together.

    Strips of STRIP targets meet strips of STRIP sources. Where the bounds of two strips are apart, squared distances and sums
    are small matrix products around the targets' middle, which lose no more than a few roundings, and one shift holds for all
    images; only an axis along which some of the pairs take another image than others is evaluated by differences. Strips that are close
    by go through :func:`_kernel`'s differences.
    """
    out, back = np.zeros((len(t), 4)), np.zeros((len(s), 4))
    same, meet, starts, half = t is s, _meet(tid, sid), np.arange(0, len(s), STRIP), (box or np.inf) / 2
    pull, phi = any(c != "phi" for c in want), "phi" in want
    slo, shi, mass = np.minimum.reduceat(s[:, :3], starts), np.maximum.reduceat(s[:, :3], starts), s[:, 3]
    bufs = [np.empty(STRIP * STRIP) for _ in range(3)]
    for a in range(0, len(t), STRIP):
        x, acc = t[a : a + STRIP], out[a : a + STRIP]
        lo, hi = x[:, :3].min(0), x[:, :3].max(0)
        mid = (lo + hi) / 2
        least, most = slo - hi, shi - lo  # of source minus target, by strip
        shift = np.where(least > half, -(box or 0.0), np.where(most < -half, box or 0.0, 0.0))
        split = (shift == 0) & ((most > half) | (least < -half))
        gap = np.maximum(np.maximum(least + shift, -(most + shift)), 0.0)
        if box is not None:
            gap = np.where(split, np.maximum(np.maximum(np.minimum(least, box - most), np.minimum(-most, box + least)), 0.0), gap)
        whole = ~split
        reach = np.maximum(np.abs(slo + shift - mid), np.abs(shi + shift - mid)) * whole
        apart = (gap * gap).sum(1) + eps * eps >= np.maximum(reach * reach, 1e-300).sum(1) / 16
        rows = np.repeat(np.arange(len(starts)), STRIP)[: len(s)]
        c = (s[:, :3] + (shift - mid)[rows]) * whole[rows]
        right = np.empty((5, len(s)))
        right[:3], right[3], right[4] = c.T, 1.0, (c * c).sum(1)
        moments = np.column_stack([c * mass[:, None], mass])
        for k, b in enumerate(starts):
            if same and b < a:
                continue
            y, other = s[b : b + STRIP], not (same and a == b) and (both or same)
            shape, pairs = (len(x), len(y)), meet.get((a // STRIP, k))
            if not apart[k]:
                _close(x, y, eps, box, pairs, pull, phi, acc, back[b : b + STRIP] if other else None)
                continue
            r2, w, e = (v[: shape[0] * shape[1]].reshape(shape) for v in bufs)
            u = (x[:, :3] - mid) * whole[k]
            left = np.column_stack([-2.0 * u, (u * u).sum(1) + eps * eps, np.ones(len(u))])
            np.dot(left, right[:, b : b + STRIP], out=r2)
            axes = np.flatnonzero(split[k])
            ds = []
            for j in axes:
                d = y[None, :, j] - x[:, None, j]
                if most[k, j] > half:
                    d -= (d > half) * box
                if least[k, j] < -half:
                    d += (d < -half) * box
                np.multiply(d, d, out=e)
                r2 += e
                ds.append(d)
            np.sqrt(r2, out=w)
            if pull:
                w *= r2
            np.divide(1.0, w, out=w)
            if pairs is not None:
                w[pairs] = 0.0
            p = w if not pull else np.multiply(w, r2, out=r2) if phi else None
            if phi:
                acc[:, 3] -= p @ mass[b : b + STRIP]
                if other:
                    back[b : b + STRIP, 3] -= x[:, 3] @ p
            if pull:
                g = w @ moments[b : b + STRIP]
                acc[:, :3] += g[:, :3] - u * g[:, 3:]
                if other:
                    h = np.column_stack([u * x[:, 3:], x[:, 3]]).T @ w
                    back[b : b + STRIP, :3] += (h[:3] - right[:3, b : b + STRIP] * h[3]).T
                for j, d in zip(axes, ds):
                    d *= w
                    acc[:, j] += d @ y[:, 3]
                    if other:
                        back[b : b + STRIP, j] -= x[:, 3] @ d
    if same:
        out += back
    return out, back


def _close(x: np.ndarray, y: np.ndarray, eps: float, box: float | None, pairs: tuple[np.ndarray, np.ndarray] | None, pull: bool, phi: bool, acc: np.ndarray, back: np.ndarray | None) -> None:
    """Adds the pull of strip y on strip x to ``acc`` and, if given, of x on y to ``back``, by differences of each pair."""
    ds, r2 = [], np.full((len(x), len(y)), eps * eps)
    for j in range(3):
        d = y[None, :, j] - x[:, None, j]
        if box is not None:
            d = np.where(d > box / 2, d - box, np.where(d < -box / 2, d + box, d))
        r2 += d * d
        ds.append(d)
    none = r2 == 0
    r2[none] = 1.0
    w = 1.0 / np.sqrt(r2)
    w[none] = 0.0
    if pairs is not None:
        w[pairs] = 0.0
    if phi:
        acc[:, 3] -= w @ y[:, 3]
        if back is not None:
            back[:, 3] -= x[:, 3] @ w
    if pull:
        w /= r2
        for j, d in enumerate(ds):
            d *= w
            acc[:, j] += d @ y[:, 3]
            if back is not None:
                back[:, j] -= x[:, 3] @ d


def _slots(spark: SparkSession, n: int) -> list[int]:
    """n integers that hash partitioning puts into n different partitions."""
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")
    return [r[0] for r in spark.range(64 * n).groupBy(at).agg(F.min("id").cast("int").alias("id")).orderBy("at").select("id").collect()]


def _in_order(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(id, x, y, z, mass, rank) with ranks along a space-filling curve, their number, and how many ranks make a block."""
    kept = scratch.keep(df)
    ends = kept.agg(F.count(F.lit(1)), *[f(F.nanvl(a, F.lit(None).cast("double"))) for a in "xyz" for f in (F.min, F.max)]).first()
    key = F.lit(0).cast("long")
    for a, lo, hi, by in zip("xyz", ends[1::2], ends[2::2], (4, 2, 1)):
        at = F.coalesce(F.nanvl((F.col(a) - (lo or 0.0)) / (((hi or 0.0) - (lo or 0.0)) or 1.0), F.lit(0.0)), F.lit(0.0))
        key = key + _spread(F.least(F.floor(at * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long")) * by
    ranked = prefix_sums(df.sparkSession, kept.withColumns({"key": key, "one": F.lit(1).cast("long")}), [], ["key", "id"], "one", "rank", scratch)
    n = ends[0]
    blocks = max(min(-(-n // TILE), BLOCKS), -(-n // SPAN), 1)
    return scratch.keep(ranked.drop("key", "one")), n, max(1, -(-n // blocks))


def direct(targets: DataFrame, sources: DataFrame, eps: float, box: float | None = None, want: tuple[str, ...] = ("ax", "ay", "az", "phi"), mutual: bool = False) -> DataFrame:
    """(id, ax, ay, az, phi), or those ``want``ed: softened gravity of all sources at each target, G = 1, minimum image with ``box``.

    Up to TILE sources (counted first) go to every task and targets aren't shuffled. Beyond that both sides are cut
    along a space-filling curve into BLOCKS blocks, or more of at most SPAN rows; every pair of blocks is one group of
    bounded size in a partition of its own, whose partial sums are added per target. When the targets are the
    sources (one DataFrame), a pair of blocks is evaluated once for both. ``mutual``: so it is for two tables without
    common ids, and the pull of the targets on the sources comes out as well. No pair of records ever becomes a row.
    Open potentials (with accelerations or without) of more than MANY sources at themselves are those of :func:`ewald.sums`,
    which count every pair as well and differ by roundings.
    """
    cols, itself, spark = ["id", "x", "y", "z", "mass"], targets is sources, sources.sparkSession
    out = "id bigint, " + ", ".join(f"{c} double" for c in want)
    sources = sources.select(*cols)
    m = sources.count()
    if m <= TILE:
        if mutual:
            return all_reduce(direct(targets, sources, eps, box, want), direct(sources, targets, eps, box, want))
        src = sources.toPandas()
        s, sid = src[cols[1:]].to_numpy(float), src["id"].to_numpy()

        def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield _frame(pdf["id"].to_numpy(), _kernel(pdf[["x", "y", "z"]].to_numpy(float), pdf["id"].to_numpy(), s, sid, eps, box))[["id", *want]]

        return targets.select(*cols[:4]).mapInPandas(close, out)
    scratch = Scratch(spark, "direct")
    if itself and box is None and "phi" in want and m > MANY:
        sources = scratch.keep(sources)
        parts = ew.sums(sources, m, eps, want)
        if parts is not None:
            return all_reduce(*parts)
    rows, n, size = _in_order(sources, scratch)
    ns, each = -(-n // size), F.floor(F.col("rank") / size).cast("int")
    if itself:
        nt = ns
        across = F.transform(F.sequence(F.lit(0), F.lit(ns - 1)), lambda o: F.struct((F.least(each, o) * ns + F.greatest(each, o)).alias("pair"), (each > o).alias("source")))
        rows = rows.select(*cols, "rank", F.inline(across))
        used = [i * ns + j for i in range(ns) for j in range(i, ns)]
    else:
        t, n, size = _in_order(targets.select(*cols[:4], F.col("mass") if mutual else F.lit(0.0).alias("mass")), scratch)
        nt, own = max(1, -(-n // size)), F.floor(F.col("rank") / size).cast("int")
        s = rows.select(*cols, "rank", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("o"), each.alias("b")).select(*cols, "rank", (F.col("o") * ns + F.col("b")).alias("pair"), F.lit(True).alias("source"))
        t = t.select(*cols, "rank", F.explode(F.sequence(F.lit(0), F.lit(ns - 1))).alias("o"), own.alias("b")).select(*cols, "rank", (F.col("b") * ns + F.col("o")).alias("pair"), F.lit(False).alias("source"))
        rows, used = t.unionByName(s), list(range(nt * ns))
    place = dict(zip(used, _slots(spark, len(used))))
    slots = F.array(*[F.lit(place.get(i, -1)) for i in range(nt * ns)])
    rows = rows.withColumn("slot", F.get(slots, F.col("pair"))).drop("pair").repartition(len(used), "slot")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        two = [(p["id"].to_numpy(), p[cols[1:]].to_numpy(float)) for p in (pdf[~pdf["source"]], pdf[pdf["source"]])]
        (tid, a), (sid, b) = two if not itself or len(two[1][0]) else two[:1] * 2
        if not len(tid):
            return _frame(tid, a)[["id", *want]]
        got, back = _tiles(a, tid, b, sid, eps, box, itself or mutual, want)
        parts = [_frame(tid, got), *[_frame(sid, back)] * ((itself or mutual) and a is not b)]
        return pd.concat(parts)[["id", *want]]

    return all_reduce(rows.groupBy("slot").applyInPandas(block, out))


def all_reduce(*parts: DataFrame) -> DataFrame:
    """Partial accelerations added up per record."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("id").agg(*[F.sum(c).alias(c) for c in whole.columns if c != "id"])


def pair_forces(bodies: DataFrame, eps: float = 0.01, factor: float = 1.0) -> DataFrame:
    """(id1, id2, fx, fy, fz, potential) of each pair of a small fixed table: the attraction on id1 (quirk Q7),
    and the potential with the distance clamped at eps. ``factor`` other than 1 is modified gravity."""
    a = bodies.select(F.col("id").alias("id1"), *[F.col(c).alias(f"{c}1") for c in ("x", "y", "z", "mass")])
    b = bodies.select(F.col("id").alias("id2"), *[F.col(c).alias(f"{c}2") for c in ("x", "y", "z", "mass")])
    both = a.join(b, F.col("id1") < F.col("id2"))
    d = [F.col(f"{c}2") - F.col(f"{c}1") for c in "xyz"]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    r2 = d2 + eps * eps
    f = F.col("mass1") * F.col("mass2") * factor / (r2 * F.sqrt(r2))
    pot = -F.col("mass1") * F.col("mass2") * factor / F.greatest(F.sqrt(d2), F.lit(eps))
    return both.select("id1", "id2", *[(f * q).alias(f"f{c}") for q, c in zip(d, "xyz")], pot.alias("potential"))


def energies(bodies: DataFrame, eps: float, box: float | None = None, phi: DataFrame | None = None) -> DataFrame:
    """(kinetic, potential, total); each pair counts once, as half of each partner's potential. Potentials (id, phi)
    are those of direct sums unless given."""
    phi = direct(bodies, bodies, eps, box, ("phi",)) if phi is None else phi
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    e = bodies.join(phi.select("id", "phi"), "id", "left").agg(
        F.sum(F.col("mass") * v2 / 2).alias("kinetic"), F.sum(F.col("mass") * F.coalesce("phi", F.lit(0.0)) / 2).alias("potential")
    )
    return e.withColumn("total", F.col("kinetic") + F.col("potential"))


# ---- trees

DEPTH = 20


def _spread(c: Column) -> Column:
    """20 bits of an integer with two zero bits between each."""
    x = c.bitwiseAND(F.lit((1 << DEPTH) - 1).cast("long"))
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def tree_key(box: float) -> Column:
    """60-bit key of the finest octree cell; its prefixes are the cells above."""
    at = [F.least(F.greatest(F.floor(F.col(a) / box * (1 << DEPTH)), F.lit(0)), F.lit((1 << DEPTH) - 1)).cast("long") for a in "xyz"]
    return _spread(at[0]) * 4 + _spread(at[1]) * 2 + _spread(at[2])


def tree_nodes(bodies: DataFrame, box: float, capacity: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Nodes (level, cell, n, mass, comx, comy, comz, size, is_leaf), and leaf members (level, cell, id, ...).

    One aggregation a level, over the records still in cells above capacity: a cell is a leaf at the first level
    where it holds at most ``capacity`` records, or at level 20. All of a node's records count (quirk Q4); the
    root covers the box (Q5), and every record has its own mass (Q6). A node without mass has its records' mean place.
    """
    rest = scratch.keep(bodies.select("id", "x", "y", "z", "mass", tree_key(box).alias("key")))
    nodes, split, level = [], [], 0
    while True:
        at = rest.withColumn("cell", F.shiftright("key", 3 * (DEPTH - level)))
        m = F.col("mass")
        node = at.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"), *[F.coalesce(F.sum(m * F.col(a)) / F.when(F.sum("mass") > 0, F.sum("mass")), F.avg(a)).alias(f"com{a}") for a in "xyz"])
        node = scratch.keep(
            node.select(F.lit(level).alias("level"), "cell", "n", "mass", "comx", "comy", "comz", F.lit(box / 2**level).alias("size"), ((F.col("n") <= capacity) | F.lit(level == DEPTH)).alias("is_leaf"))
        )
        nodes.append(node)
        part = at.join(node.select("cell", "is_leaf"), "cell").select(F.lit(level).alias("level"), "cell", "id", "x", "y", "z", "mass", "key", "is_leaf")
        split.append(scratch.keep(part))
        rest = split[-1].where("not is_leaf").select("id", "x", "y", "z", "mass", "key")
        if not rest.limit(1).count():
            break
        level += 1
    return scratch.together(nodes), scratch.together(split).where("is_leaf").drop("key", "is_leaf")


BLOCK = 4096  # most records of a block that walks the tree together; WALK of them at a time
WALK = 256
SOURCES = "block", "level", "cell", "leaf", "id", "x", "y", "z", "mass"


def _far(size, r2, theta: float, eps: float, periodic: bool, root):
    """The opening rule, for columns and arrays alike."""
    return size * size < theta * theta * (r2 + eps * eps) if periodic else size < theta * root(r2)


def _under(up: np.ndarray, rec: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (record, place in the sorted array ``up``) of all entries below each record's cell, about SLICE at a time."""
    first = np.searchsorted(up, cell, "left")
    n = np.searchsorted(up, cell, "right") - first
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        k = n[at:to]
        yield np.repeat(rec[at:to], k), np.arange(k.sum()) + np.repeat(first[at:to] - (np.cumsum(k) - k), k)
        at = to


def _walk(t: np.ndarray, tid: np.ndarray, tree: list[tuple[dict, dict]], box: float, theta: float, eps: float, periodic: bool) -> np.ndarray:
    """Acceleration, potential and terms at targets (n, 3). ``tree`` has the inner nodes and the leaf records of each level."""
    out = np.zeros((len(t), 5))
    for at in range(0, len(t), WALK):
        x, own, acc = t[at : at + WALK], tid[at : at + WALK], out[at : at + WALK]

        def apart(src: dict, r: np.ndarray, i: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
            d = [src[a][i] - x[r, j] for j, a in enumerate("xyz")]  # noqa: B023
            if periodic:
                d = [np.where(q > box / 2, q - box, np.where(q < -box / 2, q + box, q)) for q in d]
            return d, d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

        def act(src: dict, r: np.ndarray, i: np.ndarray, d: list[np.ndarray], r2: np.ndarray, on: np.ndarray) -> None:
            r, m, soft = r[on], src["mass"][i[on]], r2[on] + eps * eps
            w = np.where(soft > 0, m, 0.0) / np.sqrt(np.where(soft > 0, soft, 1.0))
            for j, q in enumerate([*(w / np.where(soft > 0, soft, 1.0) * q[on] for q in d), -w, np.ones(len(r))]):
                acc[:, j] += np.bincount(r, q, len(acc))  # noqa: B023

        rec, cell = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level, (inner, leaf) in enumerate(tree):
            for r, i in _under(leaf["up"], rec, cell):
                d, r2 = apart(leaf, r, i)
                act(leaf, r, i, d, r2, leaf["id"][i] != own[r])
            opened = []
            for r, i in _under(inner["up"], rec, cell):
                d, r2 = apart(inner, r, i)
                far = _far(box / 2**level, r2, theta, eps, periodic, np.sqrt)
                act(inner, r, i, d, r2, far)
                opened.append((r[~far], inner["cell"][i[~far]]))
            rec, cell = (np.concatenate(v) for v in zip(*opened)) if opened else (rec[:0], cell[:0])
    return out


def _near(nodes: DataFrame, blocks: DataFrame, box: float, theta: float, eps: float, periodic: bool, scratch: Scratch) -> DataFrame:
    """(block, level, cell, is_leaf, comx, comy, comz, mass): all nodes that some record within a block's bounds can
    meet. A node is opened for the block unless it is far from the nearest point of the bounds."""
    front, parts, level = blocks.withColumn("cell", F.lit(0).cast("long")), [], 0
    eight = F.array(*[F.lit(i).cast("long") for i in range(8)])
    while True:
        here = nodes.where(F.col("level") == level).drop("n")
        met = front.join(F.broadcast(here) if level <= 4 else here, "cell")
        r2 = F.lit(0.0)
        for a in "xyz":
            images = [F.col(f"com{a}") + k * box for k in ((-1, 0, 1) if periodic else (0,))]
            gaps = [F.greatest(F.col(f"lo{a}") - c, c - F.col(f"hi{a}"), F.lit(0.0)) for c in images]
            gap = F.least(*gaps) if periodic else gaps[0]
            r2 = r2 + gap * gap
        far = _far(F.col("size"), r2 * (1 - 1e-9), theta, eps * (1 - 1e-9), periodic, F.sqrt)
        met = scratch.keep(met.withColumn("open", ~far & ~F.col("is_leaf")).select(*blocks.columns, "level", "cell", "is_leaf", "comx", "comy", "comz", "mass", "open"))
        parts.append(met)
        if not met.where("open").limit(1).count():
            return scratch.together(parts).select("block", "level", "cell", "is_leaf", "comx", "comy", "comz", "mass")
        front = met.where("open").select(*blocks.columns, F.explode(F.transform(eight, lambda o: F.col("cell") * 8 + o)).alias("cell"))
        level += 1


def tree_force(bodies: DataFrame, box: float, theta: float = 0.5, eps: float = 0.01, capacity: int = 8, periodic: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(id, ax, ay, az, phi, terms): Barnes-Hut acceleration and potential on every record, and the number of terms
    it took.

    Every record walks down on its own: a node acts by its centre of mass, is a leaf whose records act one by one,
    or is replaced by its children. The periodic form uses minimum images and opens by
    size^2 < theta^2 (r^2 + eps^2). To keep the visits of records from becoming rows, records are put into blocks, the
    largest cells of at most BLOCK; a block and the nodes its records can meet are one cogroup of bounded size. The
    levels near the root hold at most 8**level nodes and are broadcast up to 4096; deeper ones are shuffled by cell.
    """
    scratch = scratch or Scratch(bodies.sparkSession, "tree-force")
    nodes, leaves = tree_nodes(bodies, box, capacity, scratch)
    ends = nodes.where("is_leaf").select("level", "cell")
    above = ends.withColumn("bl", F.explode(F.sequence(F.lit(0), F.col("level")))).withColumn("bc", F.expr("shiftright(cell, 3 * (level - bl))"))
    tops = nodes.where(F.col("n") <= BLOCK).select(F.col("level").alias("bl"), F.col("cell").alias("bc"))
    top = above.join(tops, ["bl", "bc"]).groupBy("level", "cell").agg(F.min(F.struct("bl", "bc")).alias("b"))
    top = ends.join(top, ["level", "cell"], "left").withColumn("b", F.coalesce("b", F.struct(F.col("level").alias("bl"), F.col("cell").alias("bc"))))
    top = top.select("level", "cell", F.expr("b.bc + shiftleft(1L, 3 * b.bl)").alias("block"))
    targets = scratch.keep(leaves.join(top, ["level", "cell"]).select("block", "id", "x", "y", "z"))
    blocks = scratch.keep(targets.groupBy("block").agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]))
    near = _near(nodes, blocks, box, theta, eps, periodic, scratch)
    inner = near.where("not is_leaf").select("block", "level", "cell", F.lit(False).alias("leaf"), F.lit(0).cast("long").alias("id"), *[F.col(f"com{a}").alias(a) for a in "xyz"], "mass")
    single = near.where("is_leaf").select("block", "level", "cell").join(leaves, ["level", "cell"]).withColumn("leaf", F.lit(True)).select(*SOURCES)
    sources = inner.unionByName(single).select(*[F.col(c).alias(f"s_{c}") for c in SOURCES])

    def walk(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.assign(s_up=b["s_cell"] // 8).sort_values(["s_up", "s_cell", "s_id"], kind="stable")
        columns = lambda p: {c: p[f"s_{c}"].to_numpy() for c in ("up", "cell", "id", "x", "y", "z", "mass")}
        at = [b[b["s_level"] == v] for v in range(DEPTH + 1)]
        tree = [(columns(p[~p["s_leaf"]]), columns(p[p["s_leaf"]])) for p in at]
        ids = a["id"].to_numpy()
        got = _walk(a[["x", "y", "z"]].to_numpy(float), ids, tree, box, theta, eps, periodic)
        return _frame(ids, got).assign(terms=got[:, 4].astype(np.int64))

    return targets.groupBy("block").cogroup(sources.groupBy("s_block")).applyInPandas(walk, f"{OUT}, terms bigint").where("terms > 0")


def tree_stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.max("level").alias("depth"), F.count(F.lit(1)).alias("nodes"), F.sum(F.col("is_leaf").cast("long")).alias("leaves"), F.max(F.when(F.col("level") == 0, F.col("n"))).alias("bodies")
    )


def efficiency(walked: DataFrame) -> DataFrame:
    """(bodies, terms, efficiency) of a tree walk: the part of all pairs that it evaluated."""
    out = walked.agg(F.count(F.lit(1)).alias("bodies"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"))
    return out.withColumn("efficiency", F.when(F.col("bodies") > 0, F.col("terms") / (F.col("bodies").cast("double") * F.col("bodies"))).otherwise(0.0))


def validate(forces: DataFrame, bodies: DataFrame) -> DataFrame:
    """(n, unusable, missing, net): records with accelerations, null or NaN ones, bodies without any, and the size of the sum
    of mass times acceleration over the sum of their sizes, which is 0 for exact pair forces."""
    f = [F.col("mass") * F.col(f"a{x}") for x in "xyz"]
    bad = F.lit(False)
    for x in "xyz":
        bad = bad | F.col(f"a{x}").isNull() | F.isnan(f"a{x}")
    both = bodies.select("id", "mass").join(forces.select("id", "ax", "ay", "az", F.lit(True).alias("there")), "id", "left")
    size = F.sqrt(f[0] * f[0] + f[1] * f[1] + f[2] * f[2])
    net = F.sqrt(sum((F.sum(q) * F.sum(q) for q in f[1:]), F.sum(f[0]) * F.sum(f[0])))
    return both.agg(
        F.count("there").alias("n"), F.count_if(F.col("there") & bad).alias("unusable"), F.count_if(F.col("there").isNull()).alias("missing"), F.coalesce(net / F.when(F.sum(size) > 0, F.sum(size)), F.lit(0.0)).alias("net")
    )


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, mean_error, max_error, correlation) of accelerations a against b."""
    other = b.select("id", *[F.col(f"a{x}").alias(f"b{x}") for x in "xyz"])
    rows = a.join(other, "id").withColumns({
        "e": F.expr("sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))"), "s": F.expr("sqrt(bx * bx + by * by + bz * bz)"),
        "ab": F.expr("ax * bx + ay * by + az * bz"), "aa": F.expr("ax * ax + ay * ay + az * az"), "bb": F.expr("bx * bx + by * by + bz * bz"),
    }).where("s > 0")
    rel = F.col("e") / F.col("s")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(rel).alias("mean_error"), F.max(rel).alias("max_error"), (F.sum("ab") / F.sqrt(F.sum("aa") * F.sum("bb"))).alias("correlation"))


def mesh_force(bodies: DataFrame, n: int, box: float) -> DataFrame:
    """(id, ax, ay, az) by particle-mesh: cloud-in-cell density, Poisson's equation per mode, and the gradient
    read back with the same eight weights. Two of the three real components share one complex transform.

    The field has n**3 rows whatever the number of records: up to MESH it is broadcast, beyond it is joined by cell.
    """
    scratch = Scratch(bodies.sparkSession, "mesh")
    delta = gr.contrast(gr.assign_cic(bodies, n, box), n)
    mean = float(bodies.agg(F.sum("mass")).first()[0] or 0.0) / box**3
    modes = scratch.keep(gr.transform(delta.select("ix", "iy", "iz", (F.col("delta") * mean).alias("re"), F.lit(0.0).alias("im")), n))
    k = [gr.mode(F.col(f"i{a}"), n) * (2.0 * math.pi / box) for a in "xyz"]
    k2 = k[0] * k[0] + k[1] * k[1] + k[2] * k[2]
    # a = -grad phi, phi_k = -4 pi rho_k / k^2; the gradient along an axis has no part in its highest wave number
    g = [F.when((k2 > 0) & (2 * F.col(f"i{a}") != n), 4.0 * math.pi * q / k2).otherwise(0.0) for q, a in zip(k, "xyz")]
    re, im = F.col("re"), F.col("im")
    xy = gr.transform(modes.select("ix", "iy", "iz", (-g[0] * im - g[1] * re).alias("re"), (g[0] * re - g[1] * im).alias("im")), n, inverse=True)
    z = gr.transform(modes.select("ix", "iy", "iz", (-g[2] * im).alias("re"), (g[2] * re).alias("im")), n, inverse=True)
    field = xy.withColumnsRenamed({"re": "gx", "im": "gy"}).join(z.select("ix", "iy", "iz", F.col("re").alias("gz")), ["ix", "iy", "iz"])
    field = scratch.keep(field)
    field = F.broadcast(field) if n**3 <= MESH else field
    low = bodies.select("id", *[F.pmod(F.col(a) * (n / box), F.lit(float(n))).alias(f"u{a}") for a in "xyz"])
    shares = []
    for o in ((i, j, m) for i in (0, 1) for j in (0, 1) for m in (0, 1)):
        w = F.lit(1.0)
        for a, up in zip("xyz", o):
            f = F.col(f"u{a}") - F.floor(f"u{a}")
            w = w * (f if up else 1.0 - f)
        shares.append(F.struct(*[F.pmod(F.floor(f"u{a}") + up, F.lit(n)).cast("int").alias(f"i{a}") for a, up in zip("xyz", o)], w.alias("w")))
    spread = low.select("id", F.inline(F.array(*shares)))
    return spread.join(field, ["ix", "iy", "iz"]).groupBy("id").agg(*[F.sum(F.col("w") * F.col(f"g{a}")).alias(f"a{a}") for a in "xyz"])
