"""Parent-child links to whole hierarchies: subtree sizes upward, preorder ranges downward, nested sets.

Both passes work by pointer doubling, so trees of depth d take log2(d) rounds, and round k only handles
nodes at least 2**k below their root. Sizes flow upward: a node's size is one plus what every round adds
from the nodes exactly 2**k below it. Preorder starts flow downward: prefix sums of sibling sizes, added
up along the path. What is left unprocessed when a round finishes no node hangs on a cycle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.skew import lookup, prefix_sums
from starloom.runtime import Scratch, parallelism


def links(nodes: DataFrame, node: str = "halo_id", parent: str = "descendant_id", children: str = "progenitor_ids") -> DataFrame:
    """(id, parent) of nodes unique by id. A null parent is completed from the children lists of others (of
    several the smallest id); a parent below 1 is none."""
    listed = (
        nodes.select(F.explode(children).alias("id"), F.col(node).alias("_lister"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("_lister").alias("_lister"))
    )
    given = nodes.select(F.col(node).alias("id"), F.col(parent).alias("parent")).where("id is not null")
    full = given.where("parent is not null").unionByName(
        given.where("parent is null").drop("parent").join(listed, "id", "left").withColumnRenamed("_lister", "parent")
    )
    return full.select("id", F.when(F.col("parent") > 0, F.col("parent")).alias("parent"))


@dataclass
class Upward:
    """Result of the upward pass; ``jumps[k]`` holds (id, jump) for nodes at least 2**k below their root."""

    nodes: DataFrame
    jumps: list[DataFrame]
    counts: list[int]
    adds: list[DataFrame]
    endless: DataFrame | None


def upward(edges: DataFrame, scratch: Scratch) -> Upward:
    """Subtree sizes and the nodes that no round processes, from (id, parent) unique by id."""
    edges = scratch.keep(edges)
    known = edges.select(F.col("id").alias("parent"), F.lit(True).alias("inside"))
    nodes = scratch.keep(
        lookup(edges, known, "parent").select(
            "id", F.when(F.col("inside"), F.col("parent")).alias("parent"), F.when(F.col("inside").isNull(), F.col("parent")).alias("outside")
        )
    )
    active, n = scratch.keep_counted(nodes.where("parent is not null").select("id", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("size")))
    jumps, counts, adds = [], [], []
    while n:
        add = scratch.keep(active.groupBy(F.col("jump").alias("id")).agg(F.expr("try_sum(size)").alias("more")))
        jumps.append(active)
        counts.append(n)
        adds.append(add)
        # the node jumped to brings its own jump; a popular one makes a skewed join, which adaptive execution splits
        ahead = active.select(F.col("id").alias("jump"), F.col("jump").alias("next"))
        step = active.join(ahead, "jump").select("id", "size", F.col("next").alias("jump"))
        after, m = scratch.keep_counted(step.join(add, "id", "left").select("id", "jump", F.expr("try_add(size, coalesce(more, 0))").alias("size")))
        if m == n:  # nobody between 2**k and 2**(k+1) below a root, so nobody deeper either
            return Upward(nodes, jumps[:-1], counts[:-1], adds[:-1], after.select("id", "jump"))
        active, n = after, m
    return Upward(nodes, jumps, counts, adds, None)


def loops(up: Upward, scratch: Scratch) -> DataFrame:
    """(id, loop_id, on_loop) of every node whose chain never ends; loop_id is the smallest id on its loop."""
    if up.endless is None:
        return up.nodes.select("id", F.col("id").alias("loop_id"), F.lit(False).alias("on_loop")).limit(0)
    far = scratch.keep(up.endless)
    image, size = scratch.keep_counted(far.select("jump").distinct())
    while True:  # the image shrinks to the nodes on loops
        after = scratch.keep(far.join(far.select(F.col("id").alias("jump"), F.col("jump").alias("next")), "jump").select("id", F.col("next").alias("jump")))
        image_after, m = scratch.keep_counted(after.select("jump").distinct())
        if m == size:
            break
        far, image, size = after, image_after, m
    on = image.select(F.col("jump").alias("id"))
    ring = up.nodes.join(on, "id").select("id", F.col("parent").alias("jump"), F.least("id", "parent").alias("least"))
    ring, changed = scratch.keep(ring), 1
    while changed:
        ahead = ring.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("least").alias("ahead"))
        step = ring.join(ahead, "jump").select("id", F.col("next").alias("jump"), F.least("least", "ahead").alias("least"), (F.col("ahead") < F.col("least")).alias("lower"))
        after, changed = scratch.keep_counted(step, F.col("lower"))
        scratch.drop(ring)
        ring = after.drop("lower")
    to = ring.select(F.col("id").alias("jump"), F.col("least").alias("loop_id"))
    found = far.join(to, "jump").select("id", "loop_id")
    return found.join(on.withColumn("on_loop", F.lit(True)), "id", "left").select("id", "loop_id", F.coalesce("on_loop", F.lit(False)).alias("on_loop"))


def nested_sets(up: Upward, scratch: Scratch) -> DataFrame:
    """(id, parent, outside, root, depth, size, lft, rgt) of every node whose chain ends.

    ``lft..rgt`` is the node's preorder range within its tree, siblings in order of id: the descendants of
    a node are the nodes of its root with lft inside. Rows of prefix sums are range-partitioned, so a parent
    with a third of all nodes does not end up in one task.
    """
    spark = up.nodes.sparkSession
    ends = up.nodes
    if up.endless is not None:
        ends = ends.join(up.endless.select("id"), "id", "left_anti")
    more = None
    for a in up.adds:
        more = a if more is None else more.unionByName(a)
    sized = ends.withColumn("size", F.lit(1).cast("long"))
    if more is not None:
        total = more.groupBy("id").agg(F.expr("try_sum(more)").alias("more"))
        sized = ends.join(total, "id", "left").withColumn("size", 1 + F.coalesce("more", F.lit(0))).drop("more")
    sized = scratch.keep(sized)
    below = sized.where("parent is not null")
    starts = prefix_sums(spark, below, ["parent"], ["id"], "size", "before", scratch)
    seg = scratch.keep(starts.select("id", (1 + F.col("before")).alias("seg")))
    known = scratch.keep(sized.where("parent is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("lft")))
    finals = [known]
    for k, (jump, n) in enumerate(zip(up.jumps, up.counts)):
        here = scratch.keep(jump.select("id", "jump").join(seg, "id"))  # leaves out endless nodes: they have no seg
        last = k + 1 == len(up.jumps)
        band = here if last else here.join(up.jumps[k + 1].select("id"), "id", "left_anti")
        at = known.select(F.col("id").alias("jump"), "root", "depth", "lft")
        new = scratch.keep(
            lookup(band, at, "jump", n, "inner").select("id", "root", (F.col("depth") + (1 << k)).alias("depth"), (F.col("lft") + F.col("seg")).alias("lft"))
        )
        finals.append(new)
        known = known.unionByName(new)
        if not last:
            deeper = here.join(up.jumps[k + 1].select("id"), "id", "left_semi")
            ahead = here.select(F.col("id").alias("jump"), F.col("seg").alias("ahead"))
            seg = scratch.keep(lookup(deeper, ahead, "jump", n, "inner").select("id", (F.col("seg") + F.col("ahead")).alias("seg")))
    placed = finals[0]
    for f in finals[1:]:
        placed = placed.unionByName(f)
    return sized.join(placed, "id").select("id", "parent", "outside", "root", "depth", "size", "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"))


def _cut(ranges: DataFrame, block: int, fan: int = 64) -> DataFrame:
    """The ranges lft..rgt once for each ``block`` of numbers they touch. A long range is cut in steps, each into at most
    ``fan`` pieces that are dealt out to all tasks, so no row and no task holds all of it."""
    longest = ranges.agg(F.max(F.expr(f"rgt div {block} - a_lft div {block} + 1"))).first()[0] or 1
    out, piece = ranges.withColumns({"lo": F.expr(f"a_lft div {block}"), "hi": F.expr(f"rgt div {block}")}), fan
    while piece * fan < longest:
        piece *= fan
    while longest > fan and piece >= fan:
        out = out.withColumn("i", F.explode(F.expr(f"sequence(0L, (hi - lo) div {piece})"))).withColumn("lo", F.col("lo") + F.col("i") * piece)
        out = out.withColumn("hi", F.least("hi", F.col("lo") + (piece - 1))).drop("i").repartition(parallelism(ranges.sparkSession))
        piece //= fan
    return out.withColumn("block", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def ancestor_pairs(sets: DataFrame, block: int = 64) -> DataFrame:
    """(ancestor, ancestor_depth, id): every node with every node above it, and with itself.

    A range join on nested sets, cut into blocks of preorder numbers: a block holds at most ``block`` nodes
    and ``block`` plus depth ranges, whatever the size of its tree, so no join group grows with the data.
    """
    ranges = _cut(sets.select("root", F.col("id").alias("ancestor"), F.col("depth").alias("ancestor_depth"), F.col("lft").alias("a_lft"), "rgt"), block)
    points = sets.select("root", "id", "lft", F.expr(f"lft div {block}").alias("block"))
    return ranges.join(points, ["root", "block"]).where("lft between a_lft and rgt").select("ancestor", "ancestor_depth", "id")


def hierarchy(nodes: DataFrame) -> DataFrame:
    """(halo_id, root_id, depth, path, n_below, lft, rgt, loop_id) for nodes unique by halo_id.

    path runs from the root to the node. Nodes on or above a loop have a loop_id and null in the other
    columns. Duplicate progenitors, links to ids outside and null lists are allowed; other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(nodes.sparkSession, "tree")
    up = upward(links(nodes), scratch)
    sets = scratch.keep(nested_sets(up, scratch))
    paths = ancestor_pairs(sets).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ancestor_depth", "ancestor"))).alias("p"))
    whole = sets.join(paths, "id").select(
        F.col("id").alias("halo_id"), F.col("root").alias("root_id"), "depth", F.col("p.ancestor").alias("path"),
        (F.col("size") - 1).alias("n_below"), "lft", "rgt", F.lit(None).cast("long").alias("loop_id"),
    )
    if up.endless is None:
        return whole
    ring = loops(up, scratch).select(F.col("id").alias("halo_id"), "loop_id")
    return whole.unionByName(ring, allowMissingColumns=True)


def progenitors(nodes: DataFrame) -> DataFrame:
    """(halo_id, progenitor_id, distance): all nodes below each node, by nested-set ranges."""
    scratch = Scratch(nodes.sparkSession, "below")
    sets = scratch.keep(nested_sets(upward(links(nodes), scratch), scratch))
    pairs = ancestor_pairs(sets).where("ancestor <> id")
    depth = sets.select("id", "depth")
    return pairs.join(depth, "id").select(
        F.col("ancestor").alias("halo_id"), F.col("id").alias("progenitor_id"), (F.col("depth") - F.col("ancestor_depth")).alias("distance")
    )


def endless_nodes(nodes: DataFrame) -> DataFrame:
    """(halo_id, loop_id) of the nodes the upward pass leaves unprocessed."""
    scratch = Scratch(nodes.sparkSession, "loops")
    up = upward(links(nodes), scratch)
    return loops(up, scratch).select(F.col("id").alias("halo_id"), "loop_id")
