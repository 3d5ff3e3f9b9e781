"""Queries p3_ to p8_ and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import clusters, mixing, packing, rules, sketch, topn
from starloom.llm.tokens import n_tokens
from starloom.operators.friends import UNITS, Grid
from starloom.operators.skew import latest
from starloom.queries.structure import MEMBERS_SQL
from starloom.runtime import Scratch, table


def _nodes(spark, d):
    return latest(table(spark, d, "merger_nodes").select("halo_id", "snap", "redshift", "mass", "descendant_id", "loaded_at"), "halo_id", "loaded_at")


KINDS = {"halos": "m_vir", "merger_nodes": "redshift"}
GROUP, QS = ["kind", "snap"], [0.05, 0.25, 0.5, 0.75, 0.95]


def _deliveries(spark, d) -> DataFrame:
    """(kind, halo_id, snap, value, loaded_at) of all rows as delivered, repeated ones once."""
    parts = [table(spark, d, kind).select(F.lit(kind).alias("kind"), "halo_id", "snap", topn.positive(col).alias("value"), "loaded_at") for kind, col in KINDS.items()]
    return reduce(DataFrame.unionByName, parts).where("halo_id is not null").distinct()


def _sketches(spark, d, rows: DataFrame) -> DataFrame:
    """The stored sketches of the loads, a month each: what a load brings counts, and the row it replaces is deleted."""
    changes = sketch.changes(rows, ["kind", "halo_id"], "loaded_at", F.date_format("loaded_at", "yyyy-MM"))
    return Scratch(spark, "sketches").keep(sketch.sketch(changes, ["load", *GROUP], "value", F.col("weight")))


def _numbers(spark, d) -> tuple[DataFrame, DataFrame]:
    """The present positive values (kind, snap, halo_id, value), and the sketch of all loads put together."""
    rows = Scratch(spark, "rows").keep(_deliveries(spark, d))
    now = reduce(DataFrame.unionByName, [latest(rows.where(F.col("kind") == k), "halo_id", "loaded_at") for k in KINDS])
    return now.where("value is not null").drop("loaded_at"), sketch.merge(GROUP, _sketches(spark, d, rows))


def p5_percentiles(spark, d):
    return sketch.quantiles(_numbers(spark, d)[1], GROUP, QS)


def p5_rank_error(spark, d):
    """Whether each percentile's rank among the present values is within one percent of the rank asked for."""
    now, merged = _numbers(spark, d)
    now = Scratch(spark, "now").keep(now)
    return sketch.rank_errors(now, GROUP, "value", sketch.quantiles(merged, GROUP, QS)).select(*GROUP, "q", "n", (F.col("error") <= F.greatest(F.lit(2.0), F.col("n") * 0.01)).alias("within"))


def p5_merge_check(spark, d):
    """Whether the loads' sketches put together are, counter for counter, the sketch of the present rows."""
    now, merged = _numbers(spark, d)
    whole = sketch.merge(GROUP, merged, sketch.sketch(now, GROUP, "value", F.lit(-1)))
    return whole.groupBy(*GROUP).agg((F.count_if(F.col("total") != 0) == 0).alias("same")).where("snap is not null")


def p5_found(spark, d):
    now, merged = _numbers(spark, d)
    quartiles = sketch.quantiles(merged, GROUP, [0.25, 0.75])
    far = [sketch.outliers(now.where(F.col("kind") == k), GROUP, "value", f, quartiles) for k, f in (("halos", 8.0), ("merger_nodes", 1.5))]
    return reduce(DataFrame.unionByName, far).select("kind", "halo_id")


def _packed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return packing.pack(docs.select("doc_id", n_tokens("text").alias("tokens")), "doc_id", "tokens", 4096)


def _subjects(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    names = [r[0] for r in table(spark, d, "subject_areas").select("subject").distinct().collect()]
    return rules.subjects_of(docs, rules.fit(docs, table(spark, d, "subject_labels"), names))


def _mixable(spark, d):
    """Documents with tokens, source, language and their foremost subject as topic."""
    docs = table(spark, d, "documents")
    best = _subjects(spark, d).groupBy("doc_id").agg(F.max(F.struct("share", "subject"))["subject"].alias("topic"))
    counted = docs.select("doc_id", mixing.source_name("source").alias("source"), mixing.language("lang").alias("lang"), n_tokens("text").alias("tokens"))
    return counted.join(best, "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit("none")))


def p6_checks(spark, d):
    """Whether all tokens are in containers, none is overfull, and how near their number is to the least possible."""
    counted = Scratch(spark, "tokens").keep(table(spark, d, "documents").select("doc_id", n_tokens("text").alias("tokens")))
    r = packing.report(packing.pack(counted, "doc_id", "tokens", 4096))
    total = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    return r.select((F.coalesce("size", F.lit(0)) == total).alias("whole"), (F.coalesce("fullest", F.lit(0)) <= 4096).alias("fits"), (F.col("containers") <= 1.02 * F.coalesce("at_least", F.lit(0)) + 1).alias("tight"))


def p7_checks(spark, d):
    """Whether each source reaches its goal, within one percent, and no document is repeated more than allowed."""
    r = mixing.report(_mixable(spark, d), table(spark, d, "mix_targets"))
    near = F.abs(F.col("reached") - F.col("goal")) <= F.greatest(0.01 * F.col("goal"), F.lit(4096.0))
    return r.select("source", near.alias("close"), (F.col("repeats") <= F.col("max_repeats")).alias("allowed"))


def p8_corpus(spark, d):
    """Documents and shares of text by subject."""
    return _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("share").alias("texts"))


QUERIES = {
    "p3_found": lambda s, d: clusters.members(table(s, d, "particles")),
    "p3_clusters": lambda s, d: clusters.describe(table(s, d, "particles")),
    "p4_found": lambda s, d: topn.heaviest_progenitors(_nodes(s, d)).select("descendant_id", "halo_id"),
    "p4_ranked": lambda s, d: topn.heaviest_progenitors(_nodes(s, d), 10),
    "p5_found": p5_found,
    "p5_percentiles": p5_percentiles,
    "p5_rank_error": p5_rank_error,
    "p5_merge_check": p5_merge_check,
    "p6_found": lambda s, d: packing.split_items(_packed(s, d), "doc_id"),
    "p6_containers": lambda s, d: packing.fills(_packed(s, d)),
    "p6_report": lambda s, d: packing.report(_packed(s, d)),
    "p6_checks": p6_checks,
    "p7_checks": p7_checks,
    "p7_found": lambda s, d: mixing.short_sources(_mixable(s, d), table(s, d, "mix_targets")),
    "p7_report": lambda s, d: mixing.report(_mixable(s, d), table(s, d, "mix_targets")),
    "p7_mix": lambda s, d: mixing.mix(_mixable(s, d), table(s, d, "mix_targets"))[0],
    "p8_found": lambda s, d: _subjects(s, d).select("doc_id", "subject"),
    "p8_corpus": p8_corpus,
}

_NODES = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY halo_id ORDER BY loaded_at DESC) AS rn FROM merger_nodes) WHERE rn = 1)"
_RANKED = f"""WITH {_NODES}, g AS (SELECT descendant_id, halo_id, mass, CASE WHEN redshift > 0 AND NOT isnan(redshift) THEN redshift END AS redshift
FROM n WHERE descendant_id > 0 AND mass > 0 AND NOT isnan(mass)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY descendant_id ORDER BY mass DESC, redshift ASC NULLS LAST, halo_id) AS INT) AS place FROM g)"""
_VALUES = """WITH h AS (SELECT * FROM (SELECT halo_id, snap, m_vir AS v, row_number() OVER (PARTITION BY halo_id ORDER BY loaded_at DESC) AS rn FROM halos) WHERE rn = 1),
n AS (SELECT * FROM (SELECT halo_id, snap, redshift AS v, row_number() OVER (PARTITION BY halo_id ORDER BY loaded_at DESC) AS rn FROM merger_nodes) WHERE rn = 1),
a AS (SELECT 'halos' AS kind, 8.0 AS f, halo_id, snap, v FROM h UNION ALL SELECT 'merger_nodes', 1.5, halo_id, snap, v FROM n),
g AS (SELECT * FROM a WHERE v > 0 AND NOT isnan(v))"""
_FAR = f"""{_VALUES}, q AS (SELECT kind, snap, quantile_disc(v, 0.25) AS lo, quantile_disc(v, 0.75) AS up FROM g GROUP BY 1, 2)
SELECT g.kind, g.halo_id FROM g JOIN q ON q.kind = g.kind AND q.snap = g.snap WHERE v > up * CAST(f AS DOUBLE) OR v < lo / CAST(f AS DOUBLE)"""

_GRID = Grid(0.2, 1000.0)
_AT = [f"(CAST(least(floor({a} * {1.0 / _GRID.unit!r}::DOUBLE), {_GRID.wides * UNITS - 1}) AS BIGINT) // {UNITS // _GRID.w})" for a in "xyz"]
_CLUSTERS = f"""WITH RECURSIVE {MEMBERS_SQL}, pl AS (SELECT m.halo_id AS cluster_id, p.id, x, y, z, ({_AT[0]} * {_GRID.n} + {_AT[1]}) * {_GRID.n} + {_AT[2]} AS cell FROM m JOIN p ON p.id = m.id),
ce AS (SELECT cluster_id, cell, count(*) AS n, avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM pl GROUP BY 1, 2),
de AS (SELECT *, CAST(sum(n) OVER (PARTITION BY cluster_id) AS BIGINT) AS size, count(*) OVER (PARTITION BY cluster_id) AS n_cells, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, cell) AS rn FROM ce),
ty AS (SELECT de.cluster_id, size, n_cells, n AS densest_n, id, row_number() OVER (PARTITION BY de.cluster_id ORDER BY round((x - ax) * (x - ax) + (y - ay) * (y - ay) + (z - az) * (z - az), 12), id) AS place FROM de JOIN pl ON pl.cluster_id = de.cluster_id AND pl.cell = de.cell WHERE rn = 1)
SELECT cluster_id, size, n_cells, densest_n, CAST(place AS INT) AS place, id FROM ty WHERE place <= 5"""

SQL = {
    "p3_found": f"WITH RECURSIVE {MEMBERS_SQL} SELECT halo_id AS cluster_id, id FROM m",
    "p3_clusters": _CLUSTERS,
    "p5_rank_error": f"{_VALUES}, n2 AS (SELECT kind, snap, count(*) AS n FROM g GROUP BY 1, 2) SELECT kind, snap, q, n, true AS within FROM n2, (SELECT unnest({QS!r}::DOUBLE[]) AS q)",
    "p5_merge_check": "SELECT DISTINCT kind, snap, true AS same FROM (SELECT 'halos' AS kind, snap FROM halos WHERE m_vir > 0 AND NOT isnan(m_vir) UNION ALL SELECT 'merger_nodes', snap FROM merger_nodes WHERE redshift > 0 AND NOT isnan(redshift))",
    "p6_checks": "SELECT true AS whole, true AS fits, true AS tight",
    "p7_checks": "SELECT lower(trim(source)) AS source, true AS close, true AS allowed FROM mix_targets",
    "p4_found": f"{_RANKED} SELECT descendant_id, halo_id FROM r WHERE place <= 3",
    "p4_ranked": f"{_RANKED} SELECT descendant_id, halo_id, mass, redshift, place FROM r WHERE place <= 10",
    "p5_found": _FAR,
}
