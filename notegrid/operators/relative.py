"""Relative dates: chains of "equal to that note's date plus an offset".

constraints: node, ord, kind (equal / after / before), target (null: bad reference), amount, unit
anchors: node, day
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.functions.dates import add_offset
from notegrid.operators.hierarchy import forest
from notegrid.session import settle


def _first_equal(constraints: DataFrame) -> DataFrame:
    rows = constraints.filter("kind = 'equal' AND target IS NOT NULL")
    return rows.groupBy("node").agg(F.min(F.struct("ord", "target", "amount", "unit")).alias("c")) \
        .select("node", "c.target", "c.amount", "c.unit")


def relative_dates(constraints: DataFrame, anchors: DataFrame) -> DataFrame:
    """(node, day, resolution): ok, cycle or unanchored for every constrained node.

    Only the notes resolved in the last round meet the chains, and each note is resolved once, so
    the work over all rounds is one join of the chains. Month offsets do not add up, hence rounds
    instead of jumps. What never resolves is split by following its chain to a ring or an end.
    """
    chains = settle(_first_equal(constraints))
    frontier = settle(anchors.join(constraints.select("node").distinct(), "node", "left_anti")
                      .select(F.col("node").alias("target"), "day"))
    own = constraints.select("node").distinct().join(chains, "node", "left_anti")
    solved = []
    while True:
        nxt = settle(chains.join(frontier, "target").select(
            "node", add_offset(F.col("day"), F.col("amount"), F.col("unit")).alias("day")))
        if nxt.isEmpty():
            break
        solved.append(nxt)
        frontier = nxt.withColumnRenamed("node", "target")
    done = chains.select("node", F.lit(None).cast("date").alias("day")).limit(0)
    for level in solved:
        done = done.unionByName(level)
    done = settle(done)
    stuck = settle(chains.join(done.select("node"), "node", "left_anti"))
    ok = done.withColumn("resolution", F.lit("ok"))
    none = F.lit(None).cast("date")
    bounds_only = own.select("node", none.alias("day"), F.lit("unanchored").alias("resolution"))
    if stuck.isEmpty():
        return ok.unionByName(bounds_only)
    shape = forest(stuck.select(F.col("node").alias("child"), F.col("target").alias("parent")))
    rings = shape.filter("cycle IS NOT NULL").select(F.col("cycle").alias("root")).distinct() \
        .withColumn("ring", F.lit(True))
    rest = stuck.select("node").join(shape.select("node", "root"), "node", "left").join(rings, "root", "left") \
        .select("node", none.alias("day"), F.when(F.col("ring"), "cycle").otherwise("unanchored").alias("resolution"))
    return ok.unionByName(bounds_only).unionByName(rest)


def relative_date_issues(constraints: DataFrame, anchors: DataFrame, resolved: DataFrame) -> DataFrame:
    """(node, code): bad references and offsets, rings, unanchored chains, equal constraints that
    disagree, and bounds that do not hold."""
    known = resolved.filter("day IS NOT NULL").select(F.col("node").alias("target"), F.col("day").alias("t_day")) \
        .unionByName(anchors.select(F.col("node").alias("target"), F.col("day").alias("t_day"))
                     .join(resolved.select(F.col("node").alias("target")), "target", "left_anti"))
    placed = constraints.join(known, "target", "left").withColumn(
        "at", add_offset(F.col("t_day"), F.col("amount"), F.col("unit")))
    code = lambda c: F.lit(c).alias("code")
    bad_ref = constraints.filter("target IS NULL").select("node", code("relative-date-invalid-ref"))
    bad_offset = constraints.filter(~F.col("unit").isin("d", "w", "mon", "y")).select(
        "node", code("relative-date-invalid-offset"))
    state = resolved.filter("resolution <> 'ok'").select("node", F.concat(
        F.lit("relative-date-"), "resolution").alias("code"))
    equal = placed.filter("kind = 'equal' AND at IS NOT NULL").groupBy("node").agg(
        F.min("at").alias("low"), F.max("at").alias("high"))
    clash = equal.filter("low <> high").select("node", code("relative-date-contradiction"))
    bounds = placed.filter("kind <> 'equal' AND at IS NOT NULL").join(
        resolved.filter("day IS NOT NULL").select("node", "day"), "node")
    broken = bounds.filter(F.when(F.col("kind") == "after", F.col("day") < F.col("at"))
                           .otherwise(F.col("day") > F.col("at"))).select(
        "node", code("relative-date-bound-violation"))
    return bad_ref.unionByName(bad_offset).unionByName(state).unionByName(clash).unionByName(broken) \
        .distinct()
