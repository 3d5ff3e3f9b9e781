import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.llm import sketch, topn

NODE = "halo_id long, descendant_id long, mass double, redshift double, place string, _rank int"


def test_top_n_ties_nulls_and_clashing_names(spark):
    nan = float("nan")
    rows = [(1, 9, 5.0, 2.0), (2, 9, 5.0, 1.0), (3, 9, 5.0, nan), (4, 9, 5.0, None), (5, 9, 5.0, -1.0), (6, 9, 6.0, None), (7, 9, nan, 1.0), (8, 9, None, 1.0), (9, 9, -1.0, 1.0), (10, 8, 1.0, 1.0), (11, -1, 1.0, 1.0), (12, None, 1.0, 1.0)]
    df = spark.createDataFrame([(*r, "p", 0) for r in rows], NODE)
    got = {(r["descendant_id"], r["place"]): r["halo_id"] for r in topn.heaviest_progenitors(df, 5).collect()}
    assert got == {(9, 1): 6, (9, 2): 2, (9, 3): 1, (9, 4): 3, (9, 5): 4, (8, 1): 10}
    assert topn.heaviest_progenitors(df.limit(0)).count() == 0


def test_top_n_of_one_hot_group_is_limited_before_the_shuffle(spark):
    df = spark.range(20_000).select(F.floor(F.col("id") / 1e6).alias("g"), "id")
    top = topn.top_n(df, "g", [F.col("id").desc()], 3)
    assert [r["id"] for r in top.orderBy("place").collect()] == [19999, 19998, 19997]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def exact(vals, q):
    vals = sorted(vals)
    return vals[max(1, math.ceil(q * len(vals))) - 1]


QS = [0.01, 0.25, 0.5, 0.75, 0.99]


def test_quantiles_have_bounded_rank_error(spark):
    rnd = random.Random(2)
    rows = [("a", rnd.lognormvariate(0, 2)) for _ in range(20_000)] + [("b", rnd.gauss(0, 1)) for _ in range(300)] + [("c", 5.0)] * 500 + [(None, 1.0), ("d", 0.0), ("d", -3.0)]
    rows += [("a", None), ("a", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("level", F.lit("x"))
    got = {(r["g"], r["q"]): (r["n"], r["value"]) for r in sketch.quantiles(sketch.sketch(df, ["g"], "v"), ["g"], QS).collect()}
    assert {g for g, _ in got} == {"a", "b", "c", "d", None}
    for g in ("a", "b"):
        vals = sorted(v for k, v in rows if k == g and v is not None and v == v)
        for q in QS:
            n, v = got[g, q]
            assert n == len(vals)
            rank = sum(x <= v * (1.0005 if v > 0 else 0.9995) for x in vals)
            assert abs(rank - q * n) <= max(2, 0.012 * n)
    assert got["c", 0.5][1] == pytest.approx(5.0, rel=1e-3) and got["d", 0.99][1] == 0.0 and got["d", 0.01][1] == pytest.approx(-3, rel=1e-3)
    empty = sketch.sketch(df.limit(0), ["g"], "v")
    assert empty.count() == 0 and sketch.quantiles(empty, ["g"], QS).count() == 0


def test_merging_and_deleting_equal_the_whole(spark):
    rnd = random.Random(7)
    rows = [(1, rnd.uniform(1, 1000)) for _ in range(3000)]
    gone = rows[:1000]
    make = lambda r, w=None: sketch.sketch(spark.createDataFrame(r, "g int, v double"), ["g"], "v", w)
    whole = {tuple(r) for r in make(rows[1000:]).where("total <> 0").collect()}
    parts = sketch.merge(["g"], make(rows[:2000]), make(rows[2000:]), make(gone, F.lit(-1)))
    assert {tuple(r) for r in parts.where("total <> 0").collect()} == whole
    assert sketch.quantiles(sketch.merge(["g"], make(gone), make(gone, F.lit(-1))), ["g"], QS).count() == 0


def test_codes_keep_order_and_are_undone(spark):
    vals = [-1e300, -5.0, -1e-300, 0.0, 1e-300, 0.7, 0.701, 3.0, 1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    codes = [r[0] for r in df.select(sketch.encode("v")).collect()]
    assert codes == sorted(codes) and len(set(codes[:-1])) == len(codes) - 1
    back = sketch.decode(pd.Series(codes).to_numpy())
    assert list(back[1:8]) == pytest.approx(vals[1:8], rel=1e-3)


def test_outliers(spark):
    df = spark.createDataFrame([(1, float(v), i) for i, v in enumerate([10] * 20 + [100, 1, -5, 0])] + [(1, None, 90), (1, float("nan"), 91)], "g int, v double, i int")
    q = sketch.quantiles(sketch.sketch(df.where("v > 0 and not isnan(v)"), ["g"], "v"), ["g"], [0.25, 0.75])
    assert {r["i"] for r in sketch.outliers(df, ["g"], "v", 8.0, q).collect()} == {20, 21}


def test_loads_with_replaced_rows_equal_the_latest_rows(spark):
    rnd = random.Random(11)
    rows = []
    for k in range(400):
        for t in range(rnd.choice([1, 1, 2, 3])):
            rows.append((k, f"2020-0{t + 1}", rnd.choice([1, 1, 2]), rnd.choice([None, float("nan"), rnd.uniform(1, 9)])))
    rows += [(900, None, 1, 5.0), (900, "2020-02", 2, 6.0)]
    df = spark.createDataFrame(rows, "k int, at string, g int, v double").withColumn("weight0", F.lit("x"))
    loads = sketch.sketch(sketch.changes(df, ["k"], "at", F.col("at")), ["load", "g"], "v", F.col("weight"))
    last = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        last[r[0]] = r
    whole = sketch.sketch(spark.createDataFrame(list(last.values()), "k int, at string, g int, v double"), ["g"], "v")
    merged = {tuple(r) for r in sketch.merge(["g"], loads).where("total <> 0").collect()}
    assert merged == {tuple(r) for r in whole.where("total <> 0").collect()}
    now = spark.createDataFrame(list(last.values()), "k int, at string, g int, v double").where("v > 0 and not isnan(v)")
    errors = sketch.rank_errors(now, ["g"], "v", sketch.quantiles(sketch.merge(["g"], loads), ["g"], QS)).collect()
    assert len(errors) == 2 * len(QS) and all(r["error"] <= max(2, 0.01 * r["n"]) for r in errors)
