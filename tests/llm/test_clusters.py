import itertools
import random

import pytest

from starloom.llm import clusters
from starloom.operators import friends

SCHEMA = "id long, x double, y double, z double, cell string, label int"


def brute(rows, link, box, least):
    pts = [(i, tuple(v % box for v in p)) for i, *p in rows if i is not None and all(v is not None and abs(v) < 1e300 for v in p)]
    parent = list(range(len(pts)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def near(p, q):
        return sum(min(abs(a - b), box - abs(a - b)) ** 2 for a, b in zip(p, q)) <= link * link

    for a, b in itertools.combinations(range(len(pts)), 2):
        if pts[a][0] == pts[b][0] or near(pts[a][1], pts[b][1]):
            if pts[a][0] != pts[b][0] or near(pts[a][1], pts[b][1]):
                parent[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(pts):
        groups.setdefault(find(k), set()).add(i)
    return {(min(g), i) for g in groups.values() if len(g) >= least for i in g}


def clump(rnd, centre, n, size, first, box):
    return [(first + i, *[(c + rnd.gauss(0, size)) % box for c in centre]) for i in range(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    return {tuple(r) for r in clusters.members(df, **kw).collect()}


@pytest.mark.parametrize("pairs", [4096, 2])
def test_clumps_borders_dirt_and_repeats(spark, monkeypatch, pairs):
    monkeypatch.setattr(friends, "PAIRS", pairs)  # 2: almost every undecided pair of cells is quantised further
    rnd = random.Random(pairs)
    box, link, least = 10.0, 0.4, 8
    rows = clump(rnd, (0.0, 0.0, 9.95), 40, 0.25, 100, box) + clump(rnd, (5, 5, 5), 40, 0.3, 200, box) + clump(rnd, (5.9, 5, 5), 30, 0.2, 300, box)
    rows += [(400 + i, 2.0 + 0.39 * i, 8.0, 2.0) for i in range(12)]  # a chain
    rows += [(500 + i, rnd.uniform(0, box), rnd.uniform(0, box), rnd.uniform(0, box)) for i in range(60)]
    rows += [(600 + i, 7.0, 1.0, 1.0) for i in range(9)] + [(700 + i, 3.0, 3.0, 3.0) for i in range(7)]  # ties; one too small
    want = brute(rows, link, box, least)
    assert len({c for c, _ in want}) >= 4
    dirty = rows + rows[:30] + [(i, x + 3 * box, y - 2 * box, z) for i, x, y, z in rows[:1]] * 2
    dirty += [(900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0), (902, float("inf"), 7.0, 1.0), (None, 7.0, 1.0, 1.0)]
    assert run(spark, dirty, link=link, box=box, least=least) == want


def test_one_place_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(friends, "PAIRS", 64)
    rows = [(i, 5.0, 5.0, 5.0) for i in range(400)] + [(1000 + i, 5.0 + 0.39, 5.0, 5.0) for i in range(300)] + [(2000 + i, 5.0 + 0.81, 5.0, 5.0) for i in range(20)]
    got = run(spark, rows, link=0.4, box=10.0, least=20)
    assert got == {(0, i) for i, *_ in rows if i < 2000} | {(2000, 2000 + i) for i in range(20)}


def test_description_and_empty_table(spark):
    rows = [(i, 5.0 + 0.01 * i, 5.0, 5.0) for i in range(30)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    got = clusters.describe(df, 0.4, 10.0, 20, 3).orderBy("place").collect()
    assert [r["place"] for r in got] == [1, 2, 3] and {(r["cluster_id"], r["size"]) for r in got} == {(0, 30)}
    assert clusters.members(df.limit(0)).count() == 0 and clusters.describe(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        clusters.members(df, link=5.0, box=10.0)
