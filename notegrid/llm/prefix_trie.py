"""Trie of conversation prefixes: who shares how many first turns, and what sharing them saves.

A node is a distinct sequence of first turns (role, text). Most prefixes of a large corpus belong to one
conversation only, and only the others need to be brought together:

1. Turns shrink to two 64-bit hashes and a word count, and are range-partitioned by conversation and
   turn, so a conversation of any length is spread over as many partitions as its rows ask for. Three
   scans of these short rows follow; between scans only one small row per partition reaches the driver,
   which hands every partition the state its first row continues. The last scan gives a row per
   conversation and depth. The digest of a prefix is the sum of hashes of (position, turn) in two lanes
   modulo 2^64, so it goes on across partitions.
2. A count-min sketch of all digests, three rows of cells that count to two, becomes three bit maps of
   "two or more". Their width is four times the number of prefixes, up to ``most_cells`` each (4 MB of
   bits); beyond it more prefixes are taken for shared, which costs shuffling, not correctness.
3. A prefix with a bit unset is proven to belong to one conversation. It and all deeper ones are emitted
   where they are. Only the rest is grouped exactly, by digest with partial aggregation.
4. Each node lies in the chain of its smallest member. Sums over subtrees are sums over the members of a node
   of what their chains hold, less what the node's own chain holds above it; no round per level.
   Keys that may be hot are cut: rows of one conversation by blocks of depth, children of one node by
   a broadcast of the nodes with a thousandth of all children or more, of which there are at most 1,000.

Rows without a conversation id are left out. Null role or text counts as empty. Turns are ordered by turn,
null first, then role, then a hash of the text; equal rows are turns of their own. An empty table gives no
nodes. The ids of the conversations that end in a node are hashed as a stream: in one task, as the digest
asks for, but never held together.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import WORD, settled, stored
from notegrid.llm.text_arrays import mix

MASK = (1 << 64) - 1
STRIDE = 0x9E3779B97F4A7C15
LANES = (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)
LINES = 3  # rows of the sketch
BLOCK = 4096  # depths of one conversation that stay together
EMPTY = hashlib.sha256(b"").hexdigest()


def no_repeats(conv: int) -> int:
    return 0


def _scramble(h: int) -> int:
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & MASK
    return h ^ (h >> 31)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


class Walk:
    """Goes through turns in order and gives a row per conversation and depth.

    ``taken(conv)`` first turns of a conversation are replaced by as many of the first conversation of its
    family, the ``family`` consecutive ids it belongs to. A row is given once it is known whether its
    conversation goes on.
    """

    def __init__(self, family: int, taken, conv=None, seen=0, first=(), base=None, sums=(0, 0), held=None):
        self.family, self.taken = family, taken
        self.conv, self.seen, self.base, self.first = conv, seen, base, list(first)
        self.sums, self.held = tuple(sums), held  # held: hashes and words of the last turn
        self.skip = taken(conv) if conv is not None else 0
        self.rest = max(0, seen - self.skip) + min(self.skip, len(self.first)) if conv is not None and conv != base else seen

    def _row(self, last: bool):
        h = self.held or (0, 0, 0)
        a, b = self.sums
        return (self.conv, self.rest, _signed(a), _signed(b), _signed((a - h[0]) & MASK), _signed((b - h[1]) & MASK), h[2], last)

    def _add(self, turn):
        a, b, words = turn
        step = (self.rest * STRIDE) & MASK
        h = (_scramble((a + step) & MASK), _scramble((b ^ LANES[0]) + step * 3 & MASK), words)
        row = self._row(False)
        self.sums = ((self.sums[0] + h[0]) & MASK, (self.sums[1] + h[1]) & MASK)
        self.held, self.rest = h, self.rest + 1
        return row

    def turn(self, conv: int, a: int, b: int, words: int):
        if conv != self.conv:
            if self.conv is not None:
                yield self._row(True)
            base = conv - (conv % self.family if conv >= 0 else -(-conv % self.family))
            if base != self.base:
                self.base, self.first = base, []
            self.conv, self.seen, self.rest, self.sums, self.held = conv, 0, 0, (0, 0), None
            self.skip = self.taken(conv)
            if conv != base:
                for turn in self.first[:self.skip]:
                    yield self._add(turn)
        k, self.seen = self.seen, self.seen + 1
        if conv == self.base:
            if k < 8:
                self.first.append((a, b, words))
            yield self._add((a, b, words))
        elif k >= self.skip:
            yield self._add((a, b, words))

    def close(self):
        yield self._row(True)


def _turns(batches):
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv", "a", "b", "words")]
        yield from zip(*columns)


def _edges(batches):
    """One row per partition: its rows, first and last conversation, and what is needed to go on after it."""
    n, first, conv, seen, whole = 0, None, None, 0, 0
    for c, *_ in _turns(batches):
        n += 1
        if first is None:
            first = c
        if c != conv:
            conv, seen = c, 0
        seen += 1
    yield pa.RecordBatch.from_pydict({"pid": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64()),
                                      "first": pa.array([first], pa.int64()), "conv": pa.array([conv], pa.int64()),
                                      "seen": pa.array([seen], pa.int64())})


TURN = "array<struct<a:long,b:long,words:long>>"


def _rows_of_depth(turns: DataFrame, family: int, taken) -> tuple[DataFrame, int]:
    """(conv, depth, d1, d2, p1, p2, words, last): a row per conversation and depth, in order; and how many turns there are."""
    base = F.col("conv") - F.col("conv") % F.lit(family)
    order = [base, F.col("conv") != base, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key"), F.col("lot")]
    put = settled(turns.withColumn("lot", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
                  .select("conv", "a", "b", "words"))
    parts = {r.pid: r for r in put.mapInArrow(_edges, "pid int, n long, first long, conv long, seen long").collect() if r.n}
    if not parts:
        return None, 0
    order = sorted(parts)
    start, conv, seen = {}, None, 0
    for pid in order:  # which conversation goes on in this partition, and how many of its rows came before
        start[pid] = (conv, seen)
        p = parts[pid]
        seen = seen + p.seen if p.conv == conv and p.first == conv else p.seen
        conv = p.conv

    def begin(pid, firsts, sums):
        conv, seen = start[pid]
        base = None if conv is None else conv - (conv % family if conv >= 0 else -(-conv % family))
        had, s, held = firsts.get(pid, []), *sums.get(pid, ((0, 0), None))
        if parts[pid].first != conv:  # closed by the partition before
            conv, seen = None, 0
        return Walk(family, taken, conv, seen, had, base, s, held)

    def firsts_of(batches):
        """The first turns of the last family's first conversation, as far as this partition holds them."""
        pid = TaskContext.get().partitionId()
        conv, seen = start.get(pid, (None, 0))
        base, got = None, []
        for c, a, b, words in _turns(batches):
            seen = seen + 1 if c == conv else 1
            conv = c
            own = c - (c % family if c >= 0 else -(-c % family))
            if own != base:
                base, got = own, []
            if c == own and seen <= 8:
                got.append({"a": a, "b": b, "words": words})
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "base": pa.array([base], pa.int64()), "got": pa.array(
            [got], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.int64())])))})
    found = {r.pid: r for r in put.mapInArrow(firsts_of, f"pid int, base long, got {TURN}").collect()}
    firsts, base, had = {}, None, []
    for pid in order:
        firsts[pid] = had
        got = [(t.a, t.b, t.words) for t in found[pid].got]
        had = (had + got if found[pid].base == base else got)[:8]
        base = found[pid].base

    def ends_of(batches):
        """What the last conversation adds up to within this partition."""
        pid = TaskContext.get().partitionId()
        if pid not in start:
            return
        walk = begin(pid, firsts, {})
        for turn in _turns(batches):
            for _ in walk.turn(*turn):
                pass
        h = walk.held or (0, 0, 0)
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "moved": pa.array([walk.held is not None]), **{
            n: pa.array([v], pa.int64()) for n, v in zip(("s1", "s2", "h1", "h2", "words"), map(_signed, (*walk.sums, *h)))}})
    ends = {r.pid: r for r in put.mapInArrow(ends_of, "pid int, moved boolean, s1 long, s2 long, h1 long, h2 long, words long").collect()}
    sums, state = {}, ((0, 0), None)
    for pid in order:
        sums[pid] = state
        e, p = ends[pid], parts[pid]
        own = (e.s1 & MASK, e.s2 & MASK), ((e.h1 & MASK, e.h2 & MASK, e.words) if e.moved else None)
        if p.conv == start[pid][0] and p.first == p.conv:  # the whole partition goes on with one conversation
            state = tuple((x + y) & MASK for x, y in zip(state[0], own[0])), own[1] or state[1]
        else:
            state = own
    following = {pid: parts[after].first for pid, after in zip(order, order[1:])}

    def rows_of(batches):
        pid = TaskContext.get().partitionId()
        if pid not in start:
            return
        walk = begin(pid, firsts, sums)
        out = []

        def batch():
            columns = list(zip(*out))
            kinds = [pa.int64()] * 7 + [pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              ["conv", "depth", "d1", "d2", "p1", "p2", "words", "last"])
        for turn in _turns(batches):
            out.extend(walk.turn(*turn))
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        if following.get(pid) != walk.conv:
            out.extend(walk.close())
        if out:
            yield batch()
    rows = put.mapInArrow(rows_of, "conv long, depth long, d1 long, d2 long, p1 long, p2 long, words long, last boolean")
    return stored(rows), sum(p.n for p in parts.values())


def _cells(one: np.ndarray, two: np.ndarray, width: int):
    """The cell of each digest in each row of the sketch."""
    one, two = one.view(np.uint64), two.view(np.uint64)
    for line in range(LINES):
        yield line * width + (mix(one + two * np.uint64(2 * line + 1) + np.uint64(line)) & np.uint64(width - 1)).astype(np.int64)


def _shared_bits(rows: DataFrame, width: int) -> np.ndarray:
    """Bit maps, one after another, of the cells that two or more prefixes fall into."""
    def count(batches):
        for batch in batches:
            one, two = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("d1", "d2"))
            cell, n = np.unique(np.concatenate(list(_cells(one, two, width))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.minimum(n, 2))], ["cell", "n"])
    full = rows.select("d1", "d2").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    words = full.groupBy(F.expr("cell DIV 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(cell % 32 AS INT)))").alias("bits"))
    table = words.toArrow()  # at most LINES x width / 32 rows
    bits = np.zeros(-(-LINES * width // 32), np.uint32)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return bits


def _screened(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` with single (proven to be of one conversation) and parent_single."""
    bits = rows.sparkSession.sparkContext.broadcast(_shared_bits(rows, width))

    def single(one, two):
        out = np.zeros(len(one), bool)
        for cell in _cells(one, two, width):
            out |= (bits.value[cell >> 5] >> (cell & 31).astype(np.uint32)) & np.uint32(1) == 0
        return out

    def work(batches):
        conv, alone = None, False  # of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two, up1, up2, convs = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("d1", "d2", "p1", "p2", "conv"))
            own, up = single(one, two), single(up1, up2)
            fresh = np.concatenate(([conv is None or convs[0] != conv], convs[1:] != convs[:-1])).astype(bool)
            # Once single, so is every deeper prefix of the conversation.
            place = np.arange(len(own))
            hit = np.where(own, place, len(own))
            if alone and not fresh[0]:
                hit[0] = 0
            start = np.flatnonzero(fresh | (place == 0))
            now = place >= np.minimum.reduceat(hit, start)[np.searchsorted(start, place, side="right") - 1]
            up = ~fresh & (up | np.concatenate(([alone], now[:-1])))
            conv, alone = convs[-1], bool(now[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(now), pa.array(up)], [*batch.schema.names, "single", "parent_single"])
    kinds = "conv long, depth long, d1 long, d2 long, p1 long, p2 long, words long, last boolean, single boolean, parent_single boolean"
    return stored(rows.mapInArrow(work, kinds))


def _ends(shared: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256): hash of the ids, in order and joined by commas, of the conversations that end in a node."""
    order = ["d1", "d2", "conv"]

    def joined(batches):
        """Ids next to each other as text, at most 500 to a row."""
        for batch in batches:
            key = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("d1", "d2")])
            convs = batch.column("conv").to_pylist()
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            edge = [0, *cut.tolist(), len(convs)]
            begin = [k for a, b in zip(edge, edge[1:]) for k in range(a, b, 500)]
            end = [min(k + 500, b) for a, b in zip(edge, edge[1:]) for k in range(a, b, 500)]
            yield pa.RecordBatch.from_pydict({"d1": key[0][begin], "d2": key[1][begin], "conv": pa.array([convs[k] for k in begin], pa.int64()),
                                              "ids": [",".join(map(str, convs[a:b])) for a, b in zip(begin, end)]})

    def hashed(batches):
        key, digest, out = None, None, []
        for batch in batches:
            for one, two, ids in zip(*(batch.column(n).to_pylist() for n in ("d1", "d2", "ids"))):
                if (one, two) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (one, two), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(("d1", "d2", "ends_sha256"), x)) for x in out])
                out = []
        if key is not None:
            out.append((*key, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("d1", "d2", "ends_sha256"), x)) for x in out])
    parts = (shared.filter("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
             .mapInArrow(joined, "d1 long, d2 long, conv long, ids string"))
    return parts.repartition("d1", "d2").sortWithinPartitions(*order).mapInArrow(hashed, "d1 long, d2 long, ends_sha256 string")


def _with_parent(children: DataFrame, nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """``children`` (with p1, p2) and the smallest member of their parent, parent_conv; null if it is no node."""
    up = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.filter(F.col("n") * 1000 >= F.lit(total)).select("p1", "p2")  # at most 1,000
    known = F.broadcast(up.join(F.broadcast(heavy), ["p1", "p2"]).withColumn("_heavy", F.lit(True)))
    marked = children.join(known, ["p1", "p2"], "left")
    light = marked.filter("_heavy IS NULL").drop("parent_conv", "_heavy").join(up, ["p1", "p2"], "left")
    return marked.filter("_heavy").drop("_heavy").unionByName(light)


def prefix_trie(turns: DataFrame, family: int = 1, taken=no_repeats, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", most_cells: int = 1 << 25) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    saved_tokens sums, over the node's subtree, the words of each node's last turn once for every member but
    one. With ``family`` over 1 the first ``taken(id)`` turns of a conversation, 8 at most, are those of the
    first conversation of its family of consecutive ids.
    """
    spark = turns.sparkSession
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    key = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256)

    def part(k):
        return F.conv(F.substring("key", 1 + 15 * k, 15), 16, 10).cast("long")
    short = (turns.filter(F.col(conv).isNotNull())
             .select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), who.alias("role"), key.alias("key"),
                     F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"))
             .select("*", part(0).alias("a"), part(1).alias("b")))
    rows, n = _rows_of_depth(short, family, taken)
    columns = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if rows is None:
        return spark.createDataFrame([], columns)
    width = 1 << 12
    while width < min(4 * n, most_cells):
        width *= 2
    screened = _screened(rows, width)
    shared, alone = screened.filter("NOT single"), screened.filter("single")
    tops = alone.filter("depth > 0 AND NOT parent_single")

    nodes = stored(shared.groupBy("d1", "d2").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"),
                                                  F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2")))
    counts = settled(nodes.filter("depth > 0").select("p1", "p2").unionByName(tops.select("p1", "p2"))
                     .groupBy("p1", "p2").agg(F.count("*").alias("n")))
    nodes = stored(nodes.join(counts.select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), F.col("n").alias("n_children")), ["d1", "d2"], "left")
                   .fillna(0, ["n_children"]).withColumn("own", F.expr("CASE WHEN depth > 0 THEN (n_convs - 1) * words ELSE 0 END")))

    # What the chain of a conversation holds: at most one leaf, and the savings of the nodes whose smallest member it is.
    held = (nodes.select(F.col("conv_id").alias("conv"), F.expr("CAST(n_children = 0 AS LONG)").alias("leaf"), "own")
            .unionByName(alone.filter("last").select("conv", F.lit(1).cast("long").alias("leaf"), F.lit(0).cast("long").alias("own")))
            .groupBy("conv").agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own")))
    block = F.expr(f"depth DIV {BLOCK}").alias("block")
    blocks = shared.select("conv", block).distinct().join(held, "conv")  # a row per conversation and block of depths
    sums = (shared.select("conv", block, "d1", "d2").join(blocks, ["conv", "block"])
            .groupBy("d1", "d2").agg(F.sum("leaf").alias("n_leaves"), F.sum("own").alias("all_own")))
    # Savings above a node in its own chain: within the block of depths, and in the blocks before.
    chain = nodes.select("d1", "d2", "conv_id", "depth", "own", block)
    per = chain.groupBy("conv_id", "block").agg(F.sum("own").alias("sum"))
    past = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("conv_id", "block", F.coalesce(F.sum("sum").over(past), F.lit(0)).alias("far"))
    near = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = (chain.withColumn("near", F.coalesce(F.sum("own").over(near), F.lit(0))).join(per, ["conv_id", "block"])
             .select("d1", "d2", (F.col("near") + F.col("far")).alias("above")))
    full = (nodes.join(sums, ["d1", "d2"], "left").join(above, ["d1", "d2"]).join(_ends(shared), ["d1", "d2"], "left")
            .select("p1", "p2", "conv_id", "depth", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
                    (F.coalesce("all_own", F.lit(0)) - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
    tail = alone.select("p1", "p2", F.col("conv").alias("conv_id"), "depth", F.lit(1).cast("long").alias("n_convs"),
                        F.expr("CAST(NOT last AS LONG)").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                        F.lit(0).cast("long").alias("saved_tokens"),
                        F.when(F.col("last"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(EMPTY).alias("ends_sha256"),
                        "parent_single")
    open_ends = full.unionByName(tail.filter("NOT parent_single").drop("parent_single"))
    linked = _with_parent(open_ends, nodes, counts)
    inner = tail.filter("parent_single").drop("parent_single").withColumn("parent_conv", F.col("conv_id"))
    out = linked.unionByName(inner)
    # A parent that was emitted locally belongs to the same conversation.
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv", "conv_id"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def crc32_mod(parts: int):
    """How many first turns to take over: crc32 of the decimal id, modulo ``parts``."""
    def taken(conv: int) -> int:
        return zlib.crc32(str(conv).encode()) % parts
    return taken
