"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source gets a target number of words by weight, at most ``most_passes`` times its size; what a
full source cannot take goes to the others by weight. Rows of a source are hashed into blocks. Whole
passes take every block; the rest of the target takes blocks in a random order, and one last block,
and one last row in it, in part, so that a source's words meet its target to the word.

Taken blocks are dealt out to output shards by a tree: at every node the exact quota of blocks of each
source is split between the two halves of the node's shards by drawing without replacement, source
after source (a multivariate hypergeometric draw). At the leaves shard quotas are exact; shards then
take disjoint runs of each source's permuted blocks, and rows are ordered by a hash within a shard.

Everything is DataFrame work: counts per block, a small tree table, and joins back on the block.
Null texts have size 0; null sources are one source, last in the order. Rows of size 0 are never
taken. Rows without doc_id are dealt by their text. Equal rows are interchangeable. Reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import WORD, settled

MASK = 1 << 31


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
            most_passes: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, rank, source_size, target).

    Sources by code point with null last carry ``weights`` in turn. Filling up: with level L a source
    gets min(weight x L, most_passes x size). Sorted by the level at which they are full, the level is
    found from running sums; sources are ranked with range-partitioned numbers by the engine's sort.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", turn).withColumn("cap", F.col("source_size") * float(most_passes))
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("w"))
    up_to = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.orderBy(F.desc("full_at"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = (ranked.withColumn("total", F.sum("source_size").over(whole) * float(share))
              .withColumn("caps", F.sum("cap").over(up_to))
              .withColumn("open_w", F.coalesce(F.sum("w").over(later), F.lit(0.0))))
    # A source is full if at its own level the total is not yet spent.
    filled = filled.withColumn("is_full", F.col("caps") + F.col("open_w") * F.col("full_at") <= F.col("total"))
    spent = F.sum(F.when(F.col("is_full"), F.col("cap")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("is_full"), 0.0).otherwise(F.col("w"))).over(whole)
    target = F.when(F.col("is_full"), F.col("cap")).otherwise((F.col("total") - spent) * F.col("w") / open_weight)
    return filled.select("source", "rank", "source_size", F.least(target, F.col("cap")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(MASK)) / float(MASK)


def _halves(nodes: DataFrame, seed: int) -> DataFrame:
    """One level of the tree: (node, shards, quotas: array of (rank, n)) to its two children.

    Left quotas are drawn without replacement: walking over the sources, source s gives as many of
    the slots still open on the left as a hypergeometric draw says; the draw itself takes the slots
    one by one from what is left of s and of the sources after it.
    """
    total = "aggregate(quotas, 0L, (t, q) -> t + q.n)"
    draw = """
      aggregate(quotas,
        named_struct('slots', slots, 'rest', total, 'left', cast(array() as array<struct<rank:int,n:bigint>>)),
        (a, q) -> named_struct(
          'slots', a.slots - {x}, 'rest', a.rest - q.n,
          'left', concat(a.left, array(named_struct('rank', q.rank, 'n', {x})))),
        a -> a.left)"""
    taken = ("if(a.slots = 0L OR q.n = 0L, 0L, if(a.slots >= a.rest, q.n, aggregate(sequence(1L, least(a.slots, a.rest)),"
             " named_struct('got', 0L, 'seen', 0L),"
             f" (d, i) -> named_struct('got', d.got + if(pmod(xxhash64(node, q.rank, i, {seed}), {MASK}L) / {MASK}D"
             " < (q.n - d.got) / (a.rest - d.seen), 1L, 0L), 'seen', d.seen + 1L), d -> d.got)))")
    split = (nodes.withColumn("total", F.expr(total))
             .withColumn("left_shards", F.shiftright("shards", 1))
             .withColumn("slots", F.expr("cast(round(total * left_shards / shards) as bigint)"))
             .withColumn("left", F.expr(draw.format(x=taken))))
    right = F.expr("transform(quotas, (q, k) -> named_struct('rank', q.rank, 'n', q.n - left[k].n))")
    both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left_shards").alias("shards"), F.col("left").alias("quotas")),
                   F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("shards") - F.col("left_shards")).alias("shards"),
                            right.alias("quotas")))
    return split.select(F.explode(both).alias("c")).select("c.*")


def shard_quotas(taken_blocks: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(rank, n blocks) to (rank, shard, first, upto): the runs of each source's permuted blocks per shard."""
    levels = max(0, math.ceil(math.log2(max(shards, 1))))
    nodes = (taken_blocks.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("n").cast("long").alias("n")))).alias("quotas"))
             .select(F.lit(1).cast("long").alias("node"), F.lit(1 << levels).alias("shards"), "quotas"))
    for _ in range(levels):
        nodes = settled(_halves(nodes, seed))
    flat = nodes.select((F.col("node") - (1 << levels)).alias("shard"), F.explode("quotas").alias("q")).select("shard", "q.rank", "q.n")
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (flat.withColumn("upto", F.sum("n").over(before)).withColumn("first", F.col("upto") - F.col("n"))
            .filter("n > 0").select("rank", "shard", "first", "upto"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_passes: float = 2.0,
        block_rows: int = 512, most_blocks: int = 4096, shards: int = 16, seed: int = 0) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, taken and its ``places``.

    ``places`` lists the copies the mix takes: pass, words, shard and the order in the shard. A
    source has at most ``most_blocks`` blocks, whatever its rows, so the tables of blocks and the tree
    stay small; the rows of a block grow instead, and only one block of a source is ever ordered.
    """
    clash = {c: f"_in_{c}" for c in ("size", "source_size", "target", "taken", "places") if c in docs.columns}
    own = docs.withColumnsRenamed(clash)
    sized = own.withColumns({"_size": word_count(), "_key": F.xxhash64("doc_id", "text", F.lit(seed))})
    slim = sized.select(F.col("source").alias("s"), "_size", "_key")
    # Fine hash cells first: one partial aggregation over the rows gives all later counts.
    cell = F.pmod(F.col("_key"), F.lit(most_blocks)).cast("int")
    cells = settled(slim.groupBy("s", cell.alias("cell")).agg(F.sum("_size").alias("words"), F.count("*").alias("n")))
    whole = cells.groupBy(F.col("s").alias("source")).agg(F.sum("words").alias("source_size"), F.sum("n").alias("n"))
    goal = targets(whole.select("source", "source_size"), weights, share, most_passes)
    goal = settled(goal.alias("g").join(whole.select(F.col("source").alias("h"), "n"), F.expr("g.source <=> h"))
                   .select("g.*", "n",
                           F.expr(f"int(greatest(1, least({most_blocks}, ceil(n / {block_rows}))))").alias("blocks"),
                           F.expr("int(if(source_size = 0, 0, floor(target / source_size)))").alias("passes"))
                   .withColumn("goal", F.round("target").cast("long"))
                   .withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size")))
    # A block is a run of cells, so blocks are as exact a partition of the source as cells are.
    of_cell = F.expr(f"int(floor(cell * blocks / {most_blocks}))")
    blocks = (cells.join(goal, F.expr("s <=> source")).withColumn("block", of_cell)
              .groupBy("rank", "block", "rest", "passes").agg(F.sum("words").alias("words")))
    shuffled = Window.partitionBy("rank").orderBy(F.xxhash64("rank", "block", F.lit(seed + 1)), "block")
    run = shuffled.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (blocks.withColumn("held", F.count("*").over(Window.partitionBy("rank")))
              .withColumn("place", F.row_number().over(shuffled) - 1).withColumn("upto", F.sum("words").over(run))
              .withColumn("in_rest", F.expr("greatest(0L, least(words, rest - (upto - words)))")))
    # Blocks of the mix in permuted order: first those of the whole passes, then those of the rest.
    of_rest = Window.partitionBy("rank").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = settled(blocks.withColumn("rest_place", F.sum(F.expr("int(in_rest > 0)")).over(of_rest) - 1))
    count = blocks.groupBy("rank").agg(F.sum(F.expr("passes + int(in_rest > 0)")).alias("n"))
    quotas = shard_quotas(count, shards, seed)
    copies = blocks.select(
        "rank", "block",
        F.explode(F.expr("""concat(
            transform(if(passes > 0, sequence(0, passes - 1), array()), p -> named_struct('pass', p, 'at', bigint(p) * held + place)),
            if(in_rest > 0, array(named_struct('pass', passes, 'at', bigint(passes) * held + rest_place)), array()))""")).alias("c"))
    dealt = (copies.select("rank", "block", "c.*").join(quotas, "rank").filter("at >= first AND at < upto")
             .groupBy("rank", "block").agg(F.sort_array(F.collect_list(F.struct("pass", F.col("shard").cast("int").alias("shard")))).alias("dealt")))
    plan = (blocks.join(dealt, ["rank", "block"], "left").join(goal, "rank")
            .select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), blocks["passes"].alias("p_passes"),
                    F.col("source_size").alias("source_size"), "target", "in_rest", F.col("words").alias("block_words"), "dealt"))
    plan = settled(plan)
    layout = settled(goal.select(F.col("source").alias("l_source"), F.col("blocks").alias("l_blocks")))
    placed = (_small(sized, layout, F.expr("source <=> l_source")).withColumn("p_block", F.expr(
        f"int(floor(pmod(_key, {most_blocks}L) * l_blocks / {most_blocks}))")).drop("l_source", "l_blocks"))
    placed = _small(placed, plan.withColumnRenamed("p_block", "q_block"), F.expr("source <=> p_source AND p_block = q_block"))
    # Only the rows of blocks taken in part are ordered; there is one such block per source at most.
    part = (placed.filter("in_rest > 0 AND in_rest < block_words").select("p_source", "p_block", "_key", "_size", "in_rest", "doc_id"))
    ordered = Window.partitionBy("p_source", "p_block").orderBy("_key", "doc_id")
    # Equal rows share key and id, and stand at one point of the order: they share what is taken there evenly.
    part = (part.groupBy("p_source", "p_block", "_key", "doc_id", "in_rest").agg(F.sum("_size").alias("words"), F.count("*").alias("n"))
            .withColumn("upto", F.sum("words").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .filter("upto - words < in_rest AND upto >= in_rest AND words > 0")
            .select(F.col("p_source").alias("e_source"), F.col("p_block").alias("e_block"), F.col("_key").alias("e_key"),
                    F.col("doc_id").alias("e_id"), F.expr("(in_rest - (upto - words)) div n").alias("e_words")))
    edge = settled(part.groupBy("e_source", "e_block").agg(F.max(F.struct("e_key", "e_id", "e_words")).alias("e")).select("e_source", "e_block", "e.*"))
    placed = _small(placed, edge, F.expr("p_source <=> e_source AND p_block = e_block"), "left")
    rest = F.expr("""CASE WHEN in_rest = 0 THEN 0L WHEN in_rest >= block_words THEN _size
                          WHEN _key < e_key OR (_key = e_key AND doc_id < e_id) THEN _size
                          WHEN _key = e_key AND doc_id <=> e_id THEN least(e_words, _size) ELSE 0L END""")
    placed = placed.withColumn("rest_words", rest)
    places = F.expr("""filter(transform(dealt, d -> named_struct('pass', d.pass, 'words', if(d.pass < p_passes, _size, rest_words),
                       'shard', d.shard, 'order', xxhash64(_key, d.pass))), x -> x.words > 0)""")
    placed = placed.withColumn("places", F.coalesce(places, F.expr("filter(array(named_struct('pass', 0, 'words', 0L, 'shard', 0, 'order', 0L)), x -> false)")))
    return placed.select(*own.columns, F.col("_size").alias("size"), "source_size", "target",
                         F.expr("aggregate(places, 0L, (t, x) -> t + x.words)").alias("taken"), "places")


SMALL_ROWS = 200_000


def _small(rows: DataFrame, lookup: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join with a settled lookup table: broadcast if it is measured to be small, else shuffled."""
    return rows.join(F.broadcast(lookup) if lookup.count() <= SMALL_ROWS else lookup, on, how)


def mixed_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: one row per copy, in shards; a copy taken in part keeps its first words."""
    copies = mixed.select("*", F.explode("places").alias("_c"))
    text = F.when(F.col("_c.words") == F.col("size"), F.col("text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), F.lit(1), F.col("_c.words").cast("int")), " "))
    return copies.withColumn("text", text).select(*columns, F.col("_c.shard").alias("_shard"), F.col("_c.order").alias("_order"))
