"""Near-duplicate texts: one-permutation hashing with optimal densification, banded buckets, star edges.

A text's set holds the hashes of its distinct shingles of some words. One hash function deals the set into
bins and keeps the least value of each; an empty bin copies a full one found by a hashed walk. Bands
of bins give buckets. Within a bucket members are paired with a centre only, never with each other,
and pairs are confirmed on full sets. Exact copies share a node from the start.

Stars alone can miss a link between two members that both differ from their centre. So buckets that
still hold several components are closed afterwards: what lies outside the main component of a bucket
meets that component and the other outsiders, block against block inside a task. No row is made per
pair: a block pair gives the links that join components, and each pair of different components that
share a bucket is tested on full sets until one link is found; nothing is capped. Before sets are
compared, pairs are held against a digest of four bits per bin: what is left out has fewer agreeing bins
than a pair at the threshold has, less 4 standard deviations, about as unlikely as sharing no bucket.

Rows with null or empty text are linked with nothing; rows without a doc_id too, and they are kept
with a null component. Repeated rows count as copies of one another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.common import settled, stored
from notegrid.llm.graph import components
from notegrid.llm.text_arrays import mix, shingle_hashes, texts, word_hashes

BINS = 128
BAND = 4
BITS = 7  # of BINS
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _walks(steps: int = 64) -> np.ndarray:
    """For each bin the bins tried in turn when it is empty; the same for every text."""
    at = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(steps, dtype=np.uint64)[None]
    return (mix(at + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - BITS)).astype(np.int64)


WALKS = _walks()


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least hash per bin of sorted distinct ``shingles`` (at least one), empty bins filled."""
    out = np.full(BINS, EMPTY)
    bins = (shingles >> np.uint64(64 - BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out[bins[first]] = shingles[first]
    full = out != EMPTY
    if full.all():
        return out
    empty = np.flatnonzero(~full)
    tried = full[WALKS[empty]]
    step = tried.argmax(1)
    source = WALKS[empty, step]
    for k in np.flatnonzero(~tried[np.arange(len(empty)), step]):  # next full bin, should the walk find none
        later = np.flatnonzero(full)
        source[k] = later[np.searchsorted(later, empty[k]) % len(later)]
    # The copied value is tied to the walk's step, so that two texts agree only if they took the same way.
    out[empty] = mix(out[source] + step.astype(np.uint64) + np.uint64(1))
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, BAND)
    key = np.arange(len(rows), dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)
    for k in range(BAND):
        key = mix(key ^ rows[:, k])
    return key


def nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each bin, packed into eight 64-bit values."""
    part = (mix(sig) >> np.uint64(60)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(part, axis=1)


def set_key(shingles: np.ndarray) -> int:
    """64-bit name of a set: the same for equal sets."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) ^ np.uint64(len(shingles))]))[0].astype(np.int64))


DIGEST = [f"s{k}" for k in range(BINS // 16)]


def _sketch(words: int):
    def sketch(batches):
        for batch in batches:
            sizes, nodes, keys, digests = [], [], [], []
            for text in texts(batch.column("text")):
                s = shingle_hashes(word_hashes(text), words)
                sizes.append(len(s))
                if len(s):
                    sig = signature(s)
                    nodes.append(set_key(s))
                    keys.append(bands(sig).astype(np.int64))
                    digests.append(nibbles(sig).astype(np.int64))
                else:
                    nodes.append(None)
                    keys.append(None)
                    digests.append(np.zeros(len(DIGEST), np.int64))
            digest = np.stack(digests) if digests else np.zeros((0, len(DIGEST)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                 *(pa.array(np.ascontiguousarray(digest[:, k])) for k in range(len(DIGEST)))], ["doc_id", "n_shingles", "node", "bands", *DIGEST])
    return sketch


def _agreeing() -> Column:
    """How many of the bins of node and centre agree, by their digests."""
    apart = []
    for d in DIGEST:
        x = F.col(d).bitwiseXOR(F.col(f"c_{d}"))
        any_ = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        apart.append(F.bit_count(any_.bitwiseAND(F.lit(0x1111111111111111))))
    return F.lit(BINS) - sum(apart[1:], apart[0])


def _plausible(percent: int) -> Column:
    """Enough agreeing bins for a pair at the threshold; small sets fill few bins, so they vary more."""
    m = percent / 100 + (1 - percent / 100) / 16
    drawn = F.least(F.lit(110.0), F.least("size", "c_size") * 0.7)
    return _agreeing() >= BINS * (m - 4 * F.sqrt(F.lit(m * (1 - m)) / drawn))


def _sets(words: int):
    def sets_of(batches):
        for batch in batches:
            nodes, sets = [], []
            for text in texts(batch.column("text")):
                s = shingle_hashes(word_hashes(text), words)
                nodes.append(set_key(s) if len(s) else None)
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "shingles": pa.array(sets, pa.binary())})
    return sets_of


def with_node(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with the name of each text's shingle set as ``node``, null for texts without words."""
    def named(batches):
        for batch in batches:
            sets = (shingle_hashes(word_hashes(text), words) for text in texts(batch.column("text")))
            node = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, node], [*batch.schema.names, "node"])
    return docs.mapInArrow(named, T.StructType([*docs.schema.fields, T.StructField("node", T.LongType())]))


def _linked(pairs: pd.DataFrame, sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The pairs of one cell whose full sets are similar enough."""
    held = {n: np.frombuffer(x, np.uint64) for n, x in zip(sets["node"], sets["shingles"])}
    keep = []
    for u, v in zip(pairs["hub"], pairs["spoke"]):
        x, y = held[u], held[v]
        both = len(np.intersect1d(x, y, assume_unique=True))
        keep.append(100 * both >= percent * (len(x) + len(y) - both))
    return pairs.loc[keep, ["a", "b"]]


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, side: int = 256) -> DataFrame:
    """Links among ``pairs`` (a, b, area, hub, spoke).

    Pairs of an area share their nodes, so a set is sent once to each cell of about ``side`` hubs by
    ``side`` spokes of an area, not once per pair.
    """
    wide = pairs.groupBy("area").agg(F.approx_count_distinct("hub").alias("hubs"), F.approx_count_distinct("spoke").alias("spokes"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(F.col(n) / side)).cast("int")
    cells = settled(pairs.join(wide, "area").select(
        F.xxhash64("area", part("hub", "hubs"), part("spoke", "spokes")).alias("cell"), "a", "b", "hub", "spoke"))
    needed = (cells.select(F.col("cell").alias("at"), F.explode(F.array("hub", "spoke")).alias("node")).distinct().join(sets, "node"))
    return (cells.groupBy("cell").cogroup(needed.groupBy("at"))
            .applyInPandas(lambda x, y: _linked(x, y, percent), "a long, b long"))


def _member_filter(ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """A bit map of at most ``bits`` hashed ids: (word, bits), never more than bits / 64 rows."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    return (ids.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, int(pmod(xxhash64(doc_id), {bits}L) & 63))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("map")))


def _participants(docs: DataFrame, wanted: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Texts of the wanted ids: a bit map of fixed size, broadcast, drops nearly all others before the shuffle."""
    slim = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    near = (slim.withColumn("word", F.shiftright(at, 6)).join(F.broadcast(_member_filter(wanted, bits)), "word")
            .filter(F.expr(f"(map & shiftleft(1L, int(pmod(xxhash64(doc_id), {bits}L) & 63))) != 0"))
            .select("doc_id", "text"))
    return near.join(wanted, "doc_id", "left_semi")


def _order(salt: int, per_bucket: bool) -> Column:
    return F.xxhash64("node", F.lit(salt), F.col("bucket")) if per_bucket else F.xxhash64("node", F.lit(salt))


def _least_agreeing(percent: int, drawn) -> np.ndarray:
    """The bound of ``_plausible`` for the sizes of the smaller sets."""
    m = percent / 100 + (1 - percent / 100) / 16
    return BINS * (m - 4 * np.sqrt(m * (1 - m) / np.minimum(110.0, drawn * 0.7)))


def _joining(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (of roots) between side 0 and side 1, or within side 0 where there is no other, that join components."""
    group = group.sort_values("node")
    side = group["side"].to_numpy()
    node, root, size = (group[c].to_numpy() for c in ("node", "root", "size"))
    digest = group[DIGEST].to_numpy().view(np.uint64)
    band = np.stack(group["bands"].to_list())
    held = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not group["cross"].iloc[0]
    up: dict[int, int] = {}

    def top(x):
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x
    out = []
    for k, i in enumerate(one):
        other = one[k + 1:] if within else two
        fit = other[(root[other] != root[i]) & (100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))]
        x = digest[fit] ^ digest[i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        agree = BINS - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)
        near = agree >= _least_agreeing(percent, np.minimum(size[fit], size[i]))
        fit, agree = fit[near], agree[near]
        shared = (band[fit] == band[i]).any(1)
        fit, agree = fit[shared], agree[shared]
        for j in fit[np.argsort(-agree, kind="stable")]:
            a, b = top(root[i]), top(root[j])
            if a == b:
                continue
            both = len(np.intersect1d(held[i], held[j], assume_unique=True))
            if 100 * both >= percent * (size[i] + size[j] - both):
                up[max(a, b)] = min(a, b)
                out.append((root[i], root[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _closing(placed: DataFrame, known: DataFrame, sets: DataFrame, percent: int, side: int = 1024, side_bytes: int = 32 << 20,
             salts: int = 8) -> DataFrame:
    """Links (a, b) of roots that join the components of each open bucket. placed: bucket, node, root.

    The area of a component holds its members in the buckets where it is the largest one, and all others
    of those buckets. An area of one block is one cell; of a larger one, every block of outsiders meets every
    block of outsiders and of members.
    """
    crowd = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = crowd.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("area"))
    inside = placed.join(main, "bucket").select("area", "node", (F.col("root") == F.col("area")).alias("inner")).distinct()
    inside = settled(inside.join(known.select("node", F.col("size").alias("weight")), "node"))
    outer = ~F.col("inner")
    part = lambda c, w: F.ceil(F.greatest(F.sum(c.cast("long")) / side, F.sum(F.when(c, w).otherwise(0)) * 8 / side_bytes)).cast("int")
    wide = inside.groupBy("area").agg(F.count("*").alias("all"), F.sum("weight").alias("heavy"),
                                      part(outer, F.col("weight")).alias("ob"), part(F.col("inner"), F.col("weight")).alias("ib"))
    wide = wide.withColumn("whole", (F.col("all") <= side) & (F.col("heavy") * 8 <= side_bytes))
    salt = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(salts)).cast("int").alias("salt")
    placed_in = inside.select("area", "node", "inner", salt).join(wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["area", "salt"])
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("inner"), F.greatest("ib", F.lit(1))).otherwise(F.greatest("ob", F.lit(1)))).cast("int")
    cell = "named_struct('i', {i}, 'j', {j}, 'side', {side}, 'cross', {cross})"
    cells = F.when(F.col("whole"), F.expr("array(" + cell.format(i="-1", j="-1", side="0", cross="false") + ")")).when(
        F.col("inner"), F.expr("transform(sequence(0, ob - 1), o -> " + cell.format(i="o", j="ob + k", side="1", cross="true") + ")")).otherwise(F.expr(
            "concat(transform(sequence(0, ob - 1), o -> " + cell.format(i="least(o, k)", j="greatest(o, k)", side="int(k > o)", cross="k != o") + "), "
            "transform(sequence(0, ib - 1), o -> " + cell.format(i="k", j="ob + o", side="0", cross="true") + "))"))
    sent = placed_in.withColumn("k", own).select("node", "area", F.explode(cells).alias("c")).select("node", "area", "c.*")
    full = sent.join(known.select("node", "root", "size", "bands", *DIGEST), "node").join(sets, "node")
    return full.groupBy("area", "i", "j").applyInPandas(lambda g: _joining(g, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, star_rounds: int = 1, words: int = 2,
                    nodes_too: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; links at Jaccard >= percent / 100 of ``words``-word shingles.

    With ``nodes_too`` also node, the name of the row's set, and root, the name of its component: rows of one id may be in two.
    """
    spark = docs.sparkSession
    rows = stored(docs.select("doc_id", F.col("text")).mapInArrow(
        _sketch(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, node long, bands array<long>, "
                + ", ".join(f"{d} long" for d in DIGEST)))
    linkable = rows.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = stored(linkable.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"),
                                                F.first("n_shingles").alias("size"), *(F.first(d).alias(d) for d in DIGEST)))
    member = nodes.select(F.posexplode("bands").alias("band", "bucket"), "node")
    shared = (member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"))
    member = settled(member.join(shared, "bucket").select("bucket", "node"))
    wanted = (member.select("node").distinct().join(nodes.select("node", "first_id"), "node")
              .select(F.col("first_id").alias("doc_id")))
    sets = (_participants(docs, settled(wanted)).mapInArrow(_sets(words), "node long, shingles binary")
            .groupBy("node").agg(F.first("shingles").alias("shingles")))
    sets = stored(sets)

    known = settled(member.select("node").distinct().join(nodes.select("node", "size", "bands", *DIGEST), "node"))
    root = known.select("node", F.col("node").alias("root"))

    def joined(edges):  # edges of roots
        new = components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
        return settled(root.join(new, "root", "left").select("node", F.coalesce("to", "root").alias("root")))

    def still_open():
        placed = member.join(root, "node")
        open_ = (placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
                 .select("bucket"))
        return settled(placed.join(open_, "bucket"))

    for turn in range(star_rounds):
        placed = still_open()
        if placed.isEmpty():
            break
        placed = placed.join(known.drop("bands"), "node")
        order = _order(turn, turn > 0)
        centre = placed.groupBy("bucket").agg(F.min(F.struct(order.alias("o"), F.col("node").alias("c"), F.col("root").alias("c_root"),
                                                             F.col("size").alias("c_size"), *(F.col(d).alias(f"c_{d}") for d in DIGEST))).alias("s"))
        found = placed.join(centre.select("bucket", "s.*"), "bucket").filter("root != c_root")
        found = found.filter(f"100 * least(size, c_size) >= {percent} * greatest(size, c_size)").filter(_plausible(percent))
        pairs = (found.groupBy(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
                 .agg(F.min(F.struct(F.col("c").alias("area"), F.col("c").alias("hub"), F.col("node").alias("spoke"), "root", "c_root")).alias("p"))
                 .select(F.col("p.root").alias("a"), F.col("p.c_root").alias("b"), "p.area", "p.hub", "p.spoke"))
        root = joined(settled(_confirm(settled(pairs), sets, percent)))
    placed = still_open()
    if not placed.isEmpty():
        whole = settled(known.join(root, "node"))
        root = joined(settled(_closing(placed, whole, sets, percent)))
    first = root.join(nodes.select("node", "first_id"), "node")
    first = settled(first.join(first.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
                    .select("node", "root", "component_id"))
    single = nodes.select("node", "first_id").join(first, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("component_id", "first_id").alias("component_id"))
    extra = ["node", "root"] if nodes_too else []
    out = rows.select("doc_id", "n_shingles", "node").join(single, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *extra)
