import random

from pyspark.sql import functions as F

from starloom.operators import frequency, skew
from starloom.operators.graph import connected_components
from starloom.runtime import Scratch


def test_latest_takes_newest_row_and_survives_clashing_names(spark):
    rows = [(1, 10, "a", 0), (1, 11, "b", 0), (1, 11, "b", 0), (2, None, "c", 0), (2, 5, None, 0), (None, 9, "x", 0)]
    df = spark.createDataFrame(rows, "k long, t int, v string, _rank int")
    got = {tuple(r) for r in skew.latest(df, "k", "t").collect()}
    assert got == {(1, 11, "b", 0), (2, 5, None, 0)}
    assert skew.latest(df.limit(0), "k", "t").count() == 0


def test_lookup_splits_hot_keys(spark):
    left = spark.range(90_000).select(F.when(F.col("id") < 60_000, F.lit(7)).when(F.col("id") < 60_010, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert skew.hot_keys(left, "k") == [7]
    got = skew.lookup(left, right, "k")
    assert got.count() == 90_000
    assert got.where("k = 7 and v = 14").count() == 60_000
    assert got.where("k is null and v is null").count() == 10
    assert skew.lookup(left, right, "k", how="inner").count() == 89_990


def test_prefix_sums_match_a_loop(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 2, None]), i, rnd.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, o int, v long")
    got = {(r["k"], r["o"]): r["before"] for r in skew.prefix_sums(spark, df, ["k"], ["o"], "v", "before", Scratch(spark, "t")).collect()}
    run = {}
    for k, o, v in rows:
        assert got[k, o] == run.get(k, 0)
        run[k] = run.get(k, 0) + v
    whole = {r["o"]: r["before"] for r in skew.prefix_sums(spark, df, [], ["o"], "v", "before", Scratch(spark, "t")).collect()}
    assert whole[2999] == sum(v for _, o, v in rows if o < 2999)


def test_components_of_random_graphs_and_a_long_path(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i * 37 % 400, 1000 + (i + 1) * 37 % 400) for i in range(399)] + [(5, 5), (None, 4)]
    got = {r["id"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


MEMBER = "halo_id long, id long, snap int, loaded_at timestamp, weight int, n_distinct string"


def test_profiles_count_distinct_memberships(spark):
    rows = [(1, 1, 3), (1, 1, 3), (1, 2, 3), (1, 1, 4), (-1, 1, 3), (None, 1, 3), (1, None, 3), (2, 9, None), (3, 5, 1), (3, 6, 2)]
    df = spark.createDataFrame([(*r, None, 1, "x") for r in rows], MEMBER)
    got = {r["halo_id"]: r.asDict() for r in frequency.halo_profiles(df).collect()}
    assert set(got) == {1, 2, 3}
    one = {"halo_id": 1, "n_memberships": 3, "n_rows": 4, "n_snaps": 2, "n_ids": 2, "mode_snap": 3, "mode_n": 2, "median_snap": 3}
    assert got[1] == one
    assert got[2]["mode_snap"] is None and got[2]["n_memberships"] == 1 and got[2]["n_snaps"] == 0
    assert got[3]["mode_snap"] == 1 and got[3]["median_snap"] == 1  # ties: the earlier
    assert frequency.halo_profiles(df.limit(0)).count() == 0
    assert {r[0] for r in frequency.heavy_halos(df, 40).collect()} == {1}  # 3 of 6
    assert frequency.heavy_halos(df.limit(0)).count() == 0


def test_weighted_percentiles_are_exact(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice([None, float("nan"), *range(k * 50)]), rnd.randrange(1, 4)) for k in (1, 2, 3) for _ in range(400)]
    df = spark.createDataFrame([(k, None if v is None else float(v), w) for k, v, w in rows], "k int, v double, w long")
    got = {(r["k"], r["q"]): r["v"] for r in frequency.percentiles(df, "k", "v", [0.0, 0.25, 0.5, 1.0], "w").collect()}
    for k in (1, 2, 3):
        flat = sorted(v for a, v, w in rows if a == k and v is not None and v == v for _ in range(w))
        for q in (0.0, 0.25, 0.5, 1.0):
            import math

            assert got[k, q] == flat[max(1, math.ceil(q * len(flat))) - 1]
