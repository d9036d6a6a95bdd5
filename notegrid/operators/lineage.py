"""Fork lineage: notes carry ``id`` and ``forked_from``, compared case-insensitively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.operators import hierarchy as H
from notegrid.session import settle

# Fixed value: the shape of a stable id.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def lineage_nodes(notes: DataFrame) -> DataFrame:
    """(path, id_key, parent_key): keys are null unless they are valid ids."""
    return notes.select(
        "path", F.when(valid_id(F.col("id")), F.lower("id")).alias("id_key"),
        F.when(valid_id(F.col("forked_from")), F.lower("forked_from")).alias("parent_key"))


def unique_ids(nodes: DataFrame) -> DataFrame:
    """id -> its only note; ids used by several notes are left out."""
    return nodes.filter(F.col("id_key").isNotNull()).groupBy("id_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").drop("n")


def lineage_edges(notes: DataFrame) -> DataFrame:
    """(child, parent) paths over ids that name exactly one note."""
    nodes = lineage_nodes(notes)
    sole = unique_ids(nodes)
    children = nodes.filter(F.col("parent_key").isNotNull()).join(sole.select("id_key"), "id_key",
                                                                  "left_semi")
    return children.join(sole.select(F.col("id_key").alias("parent_key"),
                                     F.col("path").alias("parent")), "parent_key").select(
        F.col("path").alias("child"), "parent")


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph; the component is its smallest node.

    Large-star then small-star rounds: every node points to the smallest neighbour it knows.
    A hub costs one aggregated row per neighbour and is never collected into a list.
    """
    both = pairs.select(F.col("child").alias("u"), F.col("parent").alias("v"))
    edges = settle(both.filter("u <> v").distinct())
    every = settle(both.select(F.col("u").alias("node")).union(both.select("v")).distinct())
    while True:
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                          F.col("m").alias("v")).distinct()
        large = settle(large)
        small_in = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = small_in.groupBy("u").agg(F.min("v").alias("m"))
        small = small_in.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").filter("u <> v").distinct()
        small = settle(small)
        same = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        edges = small
        if same:
            break
    return every.join(edges, F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("v", "node").alias("component"))


def lineage_component(notes: DataFrame) -> DataFrame:
    """(path, component) for every note that takes part in a fork edge; a component is named after
    its smallest path.

    A note has one lineage parent, so everyone connected shares a root (or a cut ring), and the
    roots come from pointer jumping; ``components`` is for graphs without that property.
    """
    shape = H.forest(lineage_edges(notes))
    label = shape.groupBy("root").agg(F.min("node").alias("component"))
    return shape.join(label, "root").select(F.col("node").alias("path"), "component")


def lineage_rows(notes: DataFrame, target_path: str) -> DataFrame:
    """Everyone connected to the target: generation relative to it and how they relate."""
    edges = settle(lineage_edges(notes))
    shape = settle(H.forest(edges))
    mine = shape.filter(F.col("node") == target_path).select(
        F.col("root").alias("r"), F.col("depth").alias("d"))
    mine = F.broadcast(mine)  # one row: the target's own position
    related = shape.join(mine, F.col("root") == F.col("r"))
    session = notes.sparkSession
    target = session.createDataFrame([(target_path,)], "path string")
    below = H.descendants_of(edges, target).select(F.col("path").alias("below"))
    above = _ancestors(edges, target_path)
    joined = related.join(below, F.col("node") == F.col("below"), "left") \
        .join(above, F.col("node") == F.col("above"), "left")
    return joined.select(
        F.col("node").alias("path"), (F.col("depth") - F.col("d")).alias("generation"),
        F.when(F.col("node") == target_path, "target")
        .when(F.col("above").isNotNull(), "ancestor")
        .when(F.col("below").isNotNull(), "descendant").otherwise("related").alias("relationship"))


def _ancestors(edges: DataFrame, start: str) -> DataFrame:
    """The parent chain of one note, found by doubling jumps over the shared edges.

    Reversed edges make the ancestors of a note its descendants, but they fan out; instead the
    set grows by following all known ancestors one jump at a time, each jump twice as long.
    """
    session = edges.sparkSession
    jump = edges
    known = session.createDataFrame([(start,)], "node string")
    while True:
        reached = known.join(jump, F.col("node") == F.col("child")).select(
            F.col("parent").alias("node"))
        grown = settle(known.union(reached).distinct())
        if grown.count() == known.count():
            return grown.filter(F.col("node") != start).select(F.col("node").alias("above"))
        known = grown
        ahead = jump.select(F.col("child").alias("parent"), F.col("parent").alias("far"))
        jump = settle(jump.join(ahead, "parent").select("child", F.col("far").alias("parent")))


def lineage_issues(notes: DataFrame) -> DataFrame:
    """(path, code, value): duplicate ids, bad or dangling parents, missing ids, fork cycles."""
    has_parent = F.col("forked_from").isNotNull()
    nodes = lineage_nodes(notes)
    keyed = notes.select("path", "id", "forked_from",
                         F.when(valid_id(F.col("id")), F.lower("id")).alias("id_key"),
                         F.when(valid_id(F.col("forked_from")), F.lower("forked_from"))
                         .alias("parent_key"))
    local = keyed.filter(has_parent).select("path", F.explode(F.array_compact(F.array(
        F.when(F.col("parent_key").isNull(), F.struct(F.lit("invalid-forked-from").alias("code"),
                                                     F.col("forked_from").alias("value"))),
        F.when(F.col("id_key").isNull(), F.struct(F.lit("missing-lineage-id").alias("code"),
                                                 F.col("id").alias("value")))))).alias("i")) \
        .select("path", "i.code", "i.value")
    ids = nodes.filter(F.col("id_key").isNotNull()).groupBy("id_key").agg(
        F.count(F.lit(1)).alias("n"))
    repeated = keyed.join(ids.filter("n > 1"), "id_key", "left_semi").select(
        "path", F.lit("duplicate-note-id").alias("code"), F.col("id").alias("value"))
    dangling = keyed.filter(F.col("parent_key").isNotNull()).join(
        ids.select(F.col("id_key").alias("parent_key")), "parent_key", "left_anti").select(
        "path", F.lit("dangling-forked-from").alias("code"), F.col("forked_from").alias("value"))
    rings = H.parent_cycles(lineage_edges(notes)).select(
        "path", F.lit("fork-cycle").alias("code"), F.col("cycle").alias("value"))
    return local.unionByName(repeated).unionByName(dangling).unionByName(rings)


def id_preflight(notes: DataFrame) -> DataFrame:
    """Counts before ids become mandatory."""
    key = F.when(valid_id(F.col("id")), F.lower("id"))
    missing = F.col("id").isNull() | (F.trim("id") == "")
    per = notes.groupBy(key.alias("key"), missing.alias("missing")).agg(
        F.count(F.lit(1)).alias("n"))
    ok = F.col("key").isNotNull()
    return per.agg(
        F.coalesce(F.sum(F.when(ok & (F.col("n") == 1), F.col("n"))), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(~ok & ~F.col("missing"), F.col("n"))), F.lit(0)).alias("invalid"),
        F.coalesce(F.sum(F.when(ok & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("duplicate"))


def fork_delete_guard(notes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Delete candidates with their block: missing, duplicate-id, has-children or null.

    Children that are deleted in the same run do not block.
    """
    nodes = lineage_nodes(notes)
    ids = nodes.filter(F.col("id_key").isNotNull()).groupBy("id_key").agg(
        F.count(F.lit(1)).alias("n_same"))
    kids = nodes.join(candidates.select("path"), "path", "left_anti") \
        .filter(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("id_key")).agg(
        F.count(F.lit(1)).alias("n_children"))
    asked = candidates.select("path").distinct().join(nodes.withColumn("found", F.lit(True)),
                                                      "path", "left")
    return asked.join(ids, "id_key", "left").join(kids, "id_key", "left").select(
        "path", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("found").isNull(), "missing").when(F.col("n_same") > 1, "duplicate-id")
        .when(F.col("n_children") > 0, "has-children").alias("block"))


def adoption_check(notes: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposed (child, parent) fork edges with a verdict: ok or why not."""
    nodes = lineage_nodes(notes)
    ids = nodes.filter(F.col("id_key").isNotNull()).groupBy("id_key").agg(
        F.count(F.lit(1)).alias("same"))
    flagged = nodes.join(ids, "id_key", "left").select(
        "path", F.coalesce(F.col("same") == 1, F.lit(False)).alias("good_id"),
        F.col("parent_key").isNotNull().alias("has_parent"))
    ring = H.would_cycle(lineage_edges(notes), proposals).withColumn("ring", F.lit(True))
    left = flagged.select(F.col("path").alias("child"), F.col("good_id").alias("child_ok"),
                          "has_parent")
    right = flagged.select(F.col("path").alias("parent"), F.col("good_id").alias("parent_ok"))
    joined = proposals.join(left, "child", "left").join(right, "parent", "left") \
        .join(ring, ["child", "parent"], "left")
    no = F.lit(False)
    return joined.select("child", "parent", F.when(F.col("child") == F.col("parent"), "same-note")
                         .when(~F.coalesce("child_ok", no) | ~F.coalesce("parent_ok", no), "invalid-id")
                         .when(F.col("has_parent"), "has-provenance")
                         .when(F.coalesce("ring", no), "closes-cycle").otherwise("ok").alias("verdict"))
