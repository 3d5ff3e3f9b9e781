"""Queries p1_ and p2_: skewed keys and hierarchies."""

from __future__ import annotations

from starloom.operators import frequency, hierarchy
from starloom.operators.skew import latest
from starloom.runtime import table


def _nodes(spark, d):
    return latest(table(spark, d, "merger_nodes"), "halo_id", "loaded_at").select("halo_id", "descendant_id", "progenitor_ids")


QUERIES = {
    "p1_found": lambda s, d: frequency.heavy_halos(table(s, d, "membership")),
    "p1_halo_profiles": lambda s, d: frequency.halo_profiles(table(s, d, "membership")),
    "p1_top_snapshots": lambda s, d: frequency.top_snapshots(table(s, d, "membership")),
    "p2_found": lambda s, d: hierarchy.endless_nodes(_nodes(s, d)),
    "p2_hierarchy": lambda s, d: hierarchy.hierarchy(_nodes(s, d)),
    "p2_progenitors": lambda s, d: hierarchy.progenitors(_nodes(s, d)),
}

_MEMBER = "m AS (SELECT halo_id, id, snap, count(*) AS w FROM membership WHERE halo_id > 0 AND id IS NOT NULL GROUP BY 1, 2, 3)"
_TREE = """n AS (SELECT * FROM (SELECT halo_id, descendant_id, progenitor_ids, row_number() OVER (PARTITION BY halo_id ORDER BY loaded_at DESC) AS rn FROM merger_nodes) WHERE rn = 1),
l AS (SELECT id, min(p) AS p FROM (SELECT halo_id AS p, unnest(progenitor_ids) AS id FROM n) GROUP BY id),
e AS (SELECT n.halo_id, CASE WHEN descendant_id IS NULL THEN l.p ELSE descendant_id END AS parent FROM n LEFT JOIN l ON l.id = n.halo_id),
c AS (SELECT e.halo_id, k.halo_id AS parent FROM e LEFT JOIN e k ON k.halo_id = e.parent)"""
_DOWN = """, t AS (SELECT halo_id, halo_id AS root_id, CAST(0 AS BIGINT) AS depth, [halo_id] AS path FROM c WHERE parent IS NULL
UNION ALL SELECT c.halo_id, t.root_id, t.depth + 1, list_append(t.path, c.halo_id) FROM t JOIN c ON c.parent = t.halo_id)"""

SQL = {
    "p1_found": f"WITH {_MEMBER}, h AS (SELECT halo_id, count(*) AS n FROM m GROUP BY 1) SELECT halo_id FROM h WHERE n * 100 >= 2 * (SELECT sum(n) FROM h)",
    "p1_halo_profiles": f"""WITH {_MEMBER}, s AS (SELECT halo_id, snap, count(*) AS k FROM m GROUP BY 1, 2),
o AS (SELECT halo_id, snap, k, row_number() OVER (PARTITION BY halo_id ORDER BY k DESC, snap) AS rn FROM s WHERE snap IS NOT NULL),
a AS (SELECT halo_id, snap, sum(k) OVER (PARTITION BY halo_id ORDER BY snap) AS upto, sum(k) OVER (PARTITION BY halo_id) AS total FROM s WHERE snap IS NOT NULL)
SELECT m.halo_id, CAST(count(*) AS BIGINT) AS n_memberships, CAST(sum(w) AS BIGINT) AS n_rows, CAST(count(DISTINCT m.snap) AS BIGINT) AS n_snaps,
CAST(count(DISTINCT m.id) AS BIGINT) AS n_ids, any_value(o.snap) AS mode_snap, CAST(any_value(o.k) AS BIGINT) AS mode_n, any_value(q.median_snap) AS median_snap
FROM m LEFT JOIN o ON o.halo_id = m.halo_id AND o.rn = 1
LEFT JOIN (SELECT halo_id, min(snap) AS median_snap FROM a WHERE upto >= greatest(1, ceil(0.5 * total)) GROUP BY 1) q ON q.halo_id = m.halo_id GROUP BY m.halo_id""",
    "p1_top_snapshots": f"""WITH {_MEMBER}, s AS (SELECT halo_id, snap, count(*) AS n_members FROM m GROUP BY 1, 2)
SELECT * FROM (SELECT halo_id, snap, n_members, CAST(row_number() OVER (PARTITION BY halo_id ORDER BY n_members DESC, snap NULLS LAST) AS INT) AS place FROM s) WHERE place <= 3""",
    "p2_found": f"""WITH RECURSIVE {_TREE}{_DOWN}, u AS (SELECT halo_id, parent FROM c WHERE halo_id NOT IN (SELECT halo_id FROM t)),
r AS (SELECT halo_id AS start, parent AS hit FROM u UNION SELECT r.start, u.parent FROM r JOIN u ON u.halo_id = r.hit),
o AS (SELECT start AS halo_id FROM r WHERE start = hit)
SELECT r.start AS halo_id, min(r.hit) AS loop_id FROM r WHERE r.hit IN (SELECT halo_id FROM o) GROUP BY r.start""",
    "p2_hierarchy": f"""WITH RECURSIVE {_TREE}{_DOWN}, z AS (SELECT a AS halo_id, count(*) AS size FROM (SELECT unnest(path) AS a FROM t) GROUP BY 1),
u AS (SELECT halo_id, parent FROM c WHERE halo_id NOT IN (SELECT halo_id FROM t)),
r AS (SELECT halo_id AS start, parent AS hit FROM u UNION SELECT r.start, u.parent FROM r JOIN u ON u.halo_id = r.hit),
g AS (SELECT start AS halo_id, min(hit) AS loop_id FROM r WHERE hit IN (SELECT start FROM r WHERE start = hit) GROUP BY 1),
f AS (SELECT t.*, z.size, CAST(row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 AS BIGINT) AS lft FROM t JOIN z USING (halo_id))
SELECT halo_id, root_id, depth, path, CAST(size - 1 AS BIGINT) AS n_below, lft, CAST(lft + size - 1 AS BIGINT) AS rgt, CAST(NULL AS BIGINT) AS loop_id FROM f
UNION ALL SELECT halo_id, NULL, NULL, NULL, NULL, NULL, NULL, loop_id FROM g""",
    "p2_progenitors": f"""WITH RECURSIVE {_TREE}{_DOWN}
SELECT a AS halo_id, halo_id AS progenitor_id, CAST(depth - i + 1 AS BIGINT) AS distance FROM (SELECT halo_id, depth, unnest(path) AS a, generate_subscripts(path, 1) AS i FROM t) WHERE a <> halo_id""",
}
