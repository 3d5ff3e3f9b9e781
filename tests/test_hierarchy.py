import random

from starloom.operators import hierarchy as hi

SCHEMA = "halo_id long, descendant_id long, progenitor_ids array<long>, size string, jump int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    ids = {r[0] for r in rows}
    listed = {}
    for p, _, kids in rows:
        for k in kids or []:
            if k is not None:
                listed[k] = min(p, listed.get(k, p))
    up = {i: (listed.get(i) if d is None else d) for i, d, _ in rows}
    up = {i: p if p in ids and p > 0 else None for i, p in up.items()}
    paths, loops = {}, {}
    for i in ids:
        chain, at = [], i
        while at is not None and at not in chain:
            chain.append(at)
            at = up[at]
        if at is None:
            paths[i] = chain[::-1]
        else:
            loops[i] = min(chain[chain.index(at):])
    return paths, loops


def check(spark, rows):
    paths, loops = brute(rows)
    df = frame(spark, rows)
    got = {r["halo_id"]: r for r in hi.hierarchy(df).collect()}
    assert {i: r["path"] for i, r in got.items() if r["loop_id"] is None} == paths
    assert {i: r["loop_id"] for i, r in got.items() if r["loop_id"] is not None} == loops
    for i, p in paths.items():
        r = got[i]
        below = {j for j, q in paths.items() if i in q and j != i}
        assert (r["depth"], r["root_id"], r["n_below"]) == (len(p) - 1, p[0], len(below))
        inside = {j for j in paths if got[j]["root_id"] == r["root_id"] and r["lft"] < got[j]["lft"] <= r["rgt"]}
        assert inside == below
    assert {tuple(r) for r in hi.endless_nodes(df).collect()} == set(loops.items())


def test_random_forests_with_loops(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(1, 151):
        kind = rnd.random()
        up = None if kind < 0.25 else -1 if kind < 0.3 else 9999 if kind < 0.35 else rnd.randrange(1, 151)
        kids = rnd.choice([None, [], [rnd.randrange(1, 151), rnd.randrange(1, 151), None, 12345]])
        rows.append((i, up, kids))
    check(spark, rows)


def test_trees_without_loops_deep_chain_and_star(spark):
    rows = [(1, -1, None)] + [(i, i - 1, [i]) for i in range(2, 41)] + [(100 + i, 7, None) for i in range(60)] + [(500, None, [501, 501]), (501, None, None)]
    check(spark, rows)


def test_self_loop_ring_with_tail_and_empty_table(spark):
    check(spark, [(5, 5, None), (6, 5, None), (1, 2, None), (2, 3, None), (3, 1, None), (4, 3, None), (8, 4, None), (9, None, [9])])
    assert hi.hierarchy(frame(spark, [])).count() == 0
    assert hi.endless_nodes(frame(spark, [])).count() == 0
    assert hi.progenitors(frame(spark, [(1, None, None)])).count() == 0


def test_progenitors_by_ranges(spark):
    rows = [(i, (i - 1) // 3, None) for i in range(1, 200)]
    paths, _ = brute(rows)
    want = {(a, i, len(p) - 1 - k) for i, p in paths.items() for k, a in enumerate(p[:-1])}
    assert {tuple(r) for r in hi.progenitors(frame(spark, rows)).collect()} == want
