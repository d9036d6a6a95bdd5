"""Hierarchies: every note has at most one parent, so the graph is functional.

Depth, root and cycles come from pointer jumping, which needs about log2(depth) joins instead of
one per level. Each step is an N:1 join and is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.session import settle


def parent_edges(resolved: DataFrame, field: str = "parent") -> DataFrame:
    return resolved.filter((F.col("field") == field) & F.col("resolved_path").isNotNull()).select(
        F.col("src_path").alias("child"), F.col("resolved_path").alias("parent")).distinct()


def _jump(edges: DataFrame) -> tuple[DataFrame, bool]:
    """(node, ptr, hops) after jumping; ptr is the root for acyclic nodes. Flag: cycles left."""
    nodes = edges.select(F.col("child").alias("node"), F.col("parent").alias("ptr"))
    roots = edges.select(F.col("parent").alias("node")).distinct() \
        .join(nodes.select("node"), "node", "left_anti")
    state = nodes.select("node", "ptr", F.lit(1).cast("bigint").alias("hops"),
                         F.lit(False).alias("done")) \
        .unionByName(roots.select("node", F.col("node").alias("ptr"),
                                  F.lit(0).cast("bigint").alias("hops"), F.lit(True).alias("done")))
    state = settle(state)
    previous = -1
    while True:
        live = state.filter("NOT done")
        ahead = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"),
                             F.col("hops").alias("hops2"), F.col("done").alias("done2"))
        moved = live.join(ahead, "ptr").select(
            "node", F.col("ptr2").alias("ptr"), (F.col("hops") + F.col("hops2")).alias("hops"),
            F.col("done2").alias("done"))
        state = settle(state.filter("done").unionByName(moved))
        open_rows = state.filter("NOT done").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("ptr").alias("images")).first()
        if open_rows["n"] == 0:
            return state, False
        # The set of nodes reached by ever longer jumps shrinks until only cycle members remain.
        if open_rows["images"] == previous:
            return state, True
        previous = open_rows["images"]


def _cycle_members(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(node, cycle): members of each cycle labelled with the smallest one."""
    members = settle(state.filter("NOT done").select(F.col("ptr").alias("node")).distinct())
    ring = edges.join(members, F.col("child") == F.col("node"), "left_semi").select(
        F.col("child").alias("node"), F.col("parent").alias("ptr"),
        F.least("child", "parent").alias("label"))
    ring = settle(ring)
    while True:
        ahead = ring.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"),
                            F.col("label").alias("label2"))
        nxt = settle(ring.join(ahead, "ptr").select(
            "node", F.col("ptr2").alias("ptr"), F.least("label", "label2").alias("label"),
            (F.col("label2") < F.col("label")).alias("changed")))
        if nxt.filter("changed").isEmpty():
            return nxt.select("node", F.col("label").alias("cycle"))
        ring = nxt.drop("changed")


def forest(edges: DataFrame) -> DataFrame:
    """(node, root, depth, cycle): a rootless cycle is cut at its smallest member, which then
    is the root; ``cycle`` names the cycle a node belongs to, null for all others."""
    edges = settle(edges.select("child", "parent").distinct())
    state, cyclic = _jump(edges)
    if not cyclic:
        return state.select("node", F.col("ptr").alias("root"), F.col("hops").alias("depth"),
                            F.lit(None).cast("string").alias("cycle"))
    members = _cycle_members(edges, state)
    cut = edges.join(members.filter("node = cycle"), F.col("child") == F.col("node"), "left_anti")
    state, _ = _jump(cut)
    # A ring of one note without further children loses its only edge and must not vanish.
    alone = members.join(state, "node", "left_anti").select(
        "node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), "cycle")
    return state.join(members, "node", "left").select(
        "node", F.col("ptr").alias("root"), F.col("hops").alias("depth"), "cycle") \
        .unionByName(alone)


def parent_cycles(edges: DataFrame) -> DataFrame:
    """Members of parent cycles: (path, cycle, position, length), position counted from the
    smallest member along the parent direction."""
    found = forest(edges)
    members = found.filter(F.col("cycle").isNotNull())
    sizes = members.groupBy("cycle").agg(F.count(F.lit(1)).alias("length"))
    return members.join(sizes, "cycle").select(
        F.col("node").alias("path"), "cycle",
        F.when(F.col("depth") == 0, 0).otherwise(F.col("length") - F.col("depth"))
        .cast("bigint").alias("position"), "length")


def is_child_of(edges: DataFrame, parent_path: str) -> DataFrame:
    return edges.filter(F.col("parent") == parent_path).select(F.col("child").alias("path"))


def descendants_of(edges: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(path, target, depth): notes whose parent chain meets a target; the nearest one counts.

    The targets' own parent edges are cut first, so each target is a root and a cycle through a
    target opens up; pointer jumping does the rest.
    """
    marks = targets.select(F.col("path").alias("mark")).distinct()
    cut = edges.join(marks, F.col("child") == F.col("mark"), "left_anti")
    rows = forest(cut).join(marks, F.col("root") == F.col("mark"), "left_semi") \
        .filter(F.col("depth") > 0)
    if max_depth is not None:
        rows = rows.filter(F.col("depth") <= max_depth)
    return rows.select(F.col("node").alias("path"), F.col("root").alias("target"), "depth")


def under(links: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources of resolved links whose target is one of ``targets`` or lies below one."""
    below = descendants_of(edges, targets).select("path").unionByName(
        targets.select("path")).distinct()
    return links.join(below, F.col("resolved_path") == F.col("path"), "left_semi") \
        .select(F.col("src_path").alias("path")).distinct()


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(path, ancestor, depth) for all pairs up to a depth; each pair once, cycles included.

    Known pairs double: those of the full depth so far are continued by all pairs of their ancestor,
    so a chain takes log2(length) rounds. A chain ends at its root, or after one full turn of a
    cycle, which the node's chain length tells in advance.
    """
    base = settle(edges.select("child", "parent").distinct())
    shape = forest(base)
    sizes = shape.filter(F.col("cycle").isNotNull()).groupBy("cycle").agg(
        F.count(F.lit(1)).alias("size"))
    rooted = shape.join(sizes.withColumnRenamed("cycle", "root_cycle"),
                        F.col("root") == F.col("root_cycle"), "left")
    # Members meet the whole ring; nodes hanging off a ring meet it after their own branch, which
    # is longest when counted from the ring's cut; the distinct below removes what they repeat.
    reach = settle(rooted.select(
        "node", (F.col("depth") + F.coalesce(F.when(F.col("cycle").isNull(), F.col("size")),
                                             F.col("size") - F.col("depth"), F.lit(0))
                 ).alias("reach")))
    longest = reach.agg(F.max("reach")).first()[0] or 0
    stop = longest if max_depth is None else min(longest, max_depth)
    reach = reach.select(F.col("node").alias("path"), F.least("reach", F.lit(stop)).alias("reach"))
    known = settle(base.select(F.col("child").alias("path"), F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("depth"))
                   .join(reach, "path").filter("reach >= 1"))
    depth = 1
    while depth < stop:
        onward = known.select(F.col("path").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("depth").alias("more"))
        added = (known.filter(F.col("depth") == depth).join(onward, "ancestor")
                 .select("path", F.col("beyond").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"), "reach")
                 .filter("depth <= reach"))
        known = settle(known.unionByName(added))
        depth *= 2
    return known.groupBy("path", "ancestor").agg(F.min("depth").cast("int").alias("depth"))


def would_cycle(edges: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposed (child, parent) edges, each judged alone, that would close a cycle.

    The new edge closes one when the child is the parent itself or above it. Members of a ring are
    above all that hangs below it. Otherwise the child must stand where the parent's chain is at the
    child's depth: all proposals take that many steps together, by powers of two.
    """
    proposals = proposals.select("child", "parent").distinct()
    same = proposals.filter(F.col("child") == F.col("parent"))
    shape = settle(forest(edges))
    above = shape.select(F.col("node").alias("child"), F.col("root").alias("c_root"), F.col("depth").alias("c_depth"), F.col("cycle").alias("ring"))
    below = shape.select(F.col("node").alias("parent"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"))
    both = settle(proposals.filter(F.col("child") != F.col("parent")).join(above, "child").join(below, "parent").filter("c_root = p_root"))
    jump = edges.select(F.col("child").alias("at"), F.col("parent").alias("up")).distinct()
    walk = both.filter("ring IS NULL AND c_depth < p_depth").select(
        "child", "parent", F.col("parent").alias("at"), (F.col("p_depth") - F.col("c_depth")).alias("steps"))
    longest = walk.agg(F.max("steps")).first()[0] or 0
    rounds = int(longest).bit_length()
    for bit in range(rounds):
        step = F.shiftright("steps", bit).bitwiseAND(F.lit(1)) == 1
        moved = walk.filter(step).join(jump, "at").select("child", "parent", F.col("up").alias("at"), "steps")
        walk = settle(walk.filter(~step).unionByName(moved))
        if bit + 1 == rounds:
            break
        ahead = jump.select(F.col("at").alias("up"), F.col("up").alias("far"))
        jump = settle(jump.join(ahead, "up").select("at", F.col("far").alias("up")))
    return (same.unionByName(both.filter("ring IS NOT NULL").select("child", "parent"))
            .unionByName(walk.filter(F.col("at") == F.col("child")).select("child", "parent")).distinct())


def children_index(edges: DataFrame) -> DataFrame:
    """Children per parent as a count; the rows themselves are the edges."""
    return edges.distinct().groupBy(F.col("parent").alias("path")).agg(
        F.count(F.lit(1)).alias("n_children"))


def _sum_before(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same key that come earlier.

    A segmented scan over range pieces, so a key may own a large share of all rows.
    """
    from pyspark.sql import Window as W
    put = settle(rows.repartitionByRange(key, *order).withColumn("piece_", F.spark_partition_id()))
    inner = W.partitionBy("piece_", key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    put = put.withColumn("near_", F.sum(value).over(inner))
    past = W.partitionBy(key).orderBy("piece_").rowsBetween(W.unboundedPreceding, -1)
    pieces = put.groupBy(key, "piece_").agg(F.sum(value).alias("all_")).withColumn("far_", F.sum("all_").over(past))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return put.join(pieces.select(key, "piece_", "far_"), [key, "piece_"]).withColumn(
        "before", zero("near_") + zero("far_")).drop("piece_", "near_", "far_")


def tree_rows(notes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Forest of the selected rows in reading order: path, name, root, depth, ord.

    Roots are rows whose parent is not selected; rows on or below a ring of parents have none and are
    left out. ``ord`` numbers the rows from 1 as they are printed, siblings by name, then path. The
    number of a row is the sum, over its way from the root, of the sizes of the subtrees printed before
    it at each step. Sizes and sums come from pointer doubling: about log2(depth) rounds of
    partial sums and N:1 joins, at any depth, and no list in a row.
    """
    chosen = settle(notes.select("path", "name"))
    inside = settle(edges.select("child", "parent").distinct()
                    .join(chosen.select(F.col("path").alias("child")), "child", "left_semi")
                    .join(chosen.select(F.col("path").alias("parent")), "parent", "left_semi"))
    shape = settle(forest(inside))
    rings = shape.filter("cycle IS NOT NULL").select("root").distinct()
    shape = shape.join(rings, "root", "left_anti") if not rings.isEmpty() else shape
    lost = inside.select(F.col("child").alias("path")).join(shape.select(F.col("node").alias("path")), "path", "left_anti")
    rows = chosen.join(lost, "path", "left_anti").join(shape.select(F.col("node").alias("path"), "root", "depth"), "path", "left") \
        .join(inside.select(F.col("child").alias("path"), "parent"), "path", "left")
    rows = rows.select("path", "name", F.coalesce("root", "path").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), "parent")
    if max_depth is not None:
        rows = rows.filter(F.col("depth") < max_depth)
    rows = settle(rows)
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    rounds = int(deepest).bit_length()

    sizes = rows.select("path", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size"))
    for _ in range(rounds):  # ``up`` is 1, 2, 4, ... steps above; size counts all rows fewer steps below
        below = sizes.filter("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.sum("size").alias("more"))
        ahead = sizes.select(F.col("path").alias("up"), F.col("up").alias("far"))
        sizes = settle(sizes.join(below, "path", "left").join(ahead, "up", "left").select(
            "path", F.col("far").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    step = _sum_before(rows.join(sizes.select("path", "size"), "path").withColumn("under", F.coalesce("parent", F.lit(""))),
                       "under", ["name", "path"], "size")
    walk = settle(step.select("path", F.col("parent").alias("up"), (F.col("before") + 1).alias("ord")))
    for _ in range(rounds):
        ahead = walk.select(F.col("path").alias("up"), F.col("up").alias("far"), F.col("ord").alias("more"))
        walk = settle(walk.join(ahead, "up", "left").select(
            "path", F.col("far").alias("up"), (F.col("ord") + F.coalesce("more", F.lit(0))).alias("ord")))
    return rows.join(walk.select("path", "ord"), "path").select("path", "name", "root", F.col("depth").cast("int").alias("depth"), "ord")


def directory_rows(notes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Notes per folder level: (folder, depth, n_direct, n_below)."""
    direct = notes.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("folder", "/")
    levels = direct.select("folder", "n", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("depth", "level"))
    out = levels.groupBy(F.col("level").alias("folder"), "depth").agg(
        F.sum(F.when(F.col("level") == F.col("folder"), F.col("n")).otherwise(0)).alias("n_direct"),
        F.sum("n").alias("n_below"))
    return out if max_depth is None else out.filter(F.col("depth") < max_depth)


def alias_map(notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """alias -> path where exactly one note claims it and no real name equals it."""
    claims = aliases.select(F.lower("alias").alias("alias"), "path").distinct()
    single = claims.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")) \
        .filter("n = 1").drop("n")
    return single.join(notes.select(F.lower("name").alias("alias")).distinct(), "alias",
                       "left_anti")
