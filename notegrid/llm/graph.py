"""Connected components of long node pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import settled


def _lowest(pairs: DataFrame, own: bool) -> DataFrame:
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return low.select("u", F.least("u", "m").alias("m")) if own else low


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable. Nodes without an edge are not listed.

    ``edges`` has columns a and b. Every step is a partial minimum per node and a join back on that
    node, so a node with very many neighbours is never gathered; each round is written to the shared
    checkpoint folder.
    """
    pairs = settled(edges.filter(F.col("a") != F.col("b"))
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        state = tuple(pairs.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if state == before or not state[0]:
            break
        before = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_lowest(both, True), "u").filter("v > u AND v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.distinct()
        low = _lowest(large, False)
        small = large.join(low, "u")
        pairs = settled(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionByName(low.select("u", F.col("m").alias("v")))
                        .filter("u != v").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
