"""Near-copies among vectors: spherical k-means cells, blocked cosine products within the cells.

Centres are fitted on a bounded sample; every vector then has a home cell. A pair over the threshold
may lie across a border, so a vector also visits the cells of other centres it is close to the border
of: cell c, unless its depth (v . (home - c)) / |home - c| exceeds ``reach``. A pair is missed only if
either vector lies deeper than that on its side of the border, so they are more than 2 reach apart;
with reach = sqrt((1 - threshold) / 2), half the distance at the threshold, no pair can be missed. Vectors at home are compared with each other and
with visitors, in blocks of bounded size, so a full cell is many tasks. A task returns a number of
links per vector and a forest of links, never the pairs. Equal vectors are one node with a count.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, vectors
of different widths not with each other: each width has centres and cells of its own. Rows with a null vec_id take part; their component is the smallest id
there is. Repeated rows are links of one another.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.llm.common import settled, stored
from notegrid.llm.graph import components
from notegrid.llm.vectors import matrix, usable, width_counts


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True).clip(1e-300)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means: centres of length one that maximise the cosine to their vectors."""
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    centres = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        best = np.concatenate([(x[i:i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        size = np.linalg.norm(sums, axis=1)
        ok = size > 1e-9
        centres[ok] = sums[ok] / size[ok, None]
    return centres


def _assign(nodes: DataFrame, centres: dict[int, tuple[int, np.ndarray]], reach: float) -> DataFrame:
    """(node, n, vector, home, cells): the home cell and all cells visited. ``centres``: width -> (first cell, centres)."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)  # at most most_cells rows, and one per width

    def work(batches):
        apart = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                widths = pc.list_value_length(piece.column("embedding"))
                for width in pc.unique(widths).to_pylist():
                    part = piece.filter(pc.equal(widths, width))
                    first, c = shared.value[width]
                    if width not in apart:
                        apart[width] = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-12))
                    x = _unit(matrix(part.column("embedding").to_pylist(), width))
                    close = x @ c.T
                    home = close.argmax(1)
                    depth = (close[np.arange(len(x)), home][:, None] - close) / apart[width][home]
                    inside = depth <= reach
                    inside[np.arange(len(x)), home] = True
                    row, cell = np.nonzero(inside)
                    ends = np.searchsorted(row, np.arange(len(x) + 1))
                    cells = [first + cell[ends[i]:ends[i + 1]] for i in range(len(x))]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node"), part.column("n"), pa.array([v.tobytes() for v in x], pa.binary()),
                         pa.array((first + home).astype(np.int32)), pa.array(cells, pa.list_(pa.int32()))], ["node", "n", "v", "home", "cells"])
    return nodes.select("node", "n", "embedding").mapInArrow(work, "node long, n long, v binary, home int, cells array<int>")


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that connect what ``linked`` (rows left, columns right) connects: at most one per node."""
    label_l, label_r = left.copy(), right.copy()
    top = np.int64(np.iinfo(np.int64).max)
    r = np.flatnonzero(linked.any(1))
    c = np.flatnonzero(linked.any(0))
    sub = linked[np.ix_(r, c)]
    label_l, label_r = left[r], right[c]
    while len(r):
        new_l = np.minimum(label_l, np.where(sub, label_r[None], top).min(1))
        new_r = np.minimum(label_r, np.where(sub, new_l[:, None], top).min(0))
        if (new_l == label_l).all() and (new_r == label_r).all():
            break
        label_l, label_r = new_l, new_r
    a = np.concatenate([left[r], right[c]])
    b = np.concatenate([label_l, label_r])
    keep = a != b
    return a[keep], b[keep]


def _compare(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One block pair: side 0 are rows at home, side 1 a second block at home or visitors; else one block with itself."""
    out = []
    one = group[group["side"] == 0]
    two = group[group["side"] == 1]
    rows = lambda g: np.frombuffer(b"".join(g["v"]), np.float64).reshape(len(g), -1)
    if len(one) and (len(two) or not group["cross"].iloc[0]):
        other = two if group["cross"].iloc[0] else one
        linked = rows(one) @ rows(other).T >= threshold
        a, b = one["node"].to_numpy(), other["node"].to_numpy()
        linked &= a[:, None] != b[None]
        if group["visit"].iloc[0] and linked.any():
            # Both may visit each other's cell: such a pair counts in the cell with the smaller number.
            cell = int(group["cell"].iloc[0])
            homes, at = np.unique(other["home"].to_numpy(), return_inverse=True)
            goes = np.array([np.isin(homes, x) for x in one["cells"]]).reshape(len(one), len(homes))
            linked &= ~(goes & (homes < cell)[None])[:, at]
        n_one, n_two = one["n"].to_numpy(), other["n"].to_numpy()
        hits = linked @ n_two
        out.append(pd.DataFrame({"a": a[hits > 0], "b": pd.array([None] * int((hits > 0).sum()), "Int64"), "links": hits[hits > 0]}))
        if group["cross"].iloc[0]:
            back = n_one @ linked
            out.append(pd.DataFrame({"a": b[back > 0], "b": pd.array([None] * int((back > 0).sum()), "Int64"), "links": back[back > 0]}))
        u, w = _forest(linked, a, b)
        out.append(pd.DataFrame({"a": u, "b": pd.array(w, "Int64"), "links": np.zeros(len(u), np.int64)}))
    if not out:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": pd.array([], "Int64"), "links": np.zeros(0, np.int64)})
    return pd.concat(out, ignore_index=True)


def link_vectors(nodes: DataFrame, threshold: float = 0.95, reach: float | None = None, per_cell: int = 512,
                 most_cells: int = 4096, sample: int = 20_000, block: int = 1024) -> DataFrame:
    """(a, b, links): links counted per node (b null), and forest edges (links 0). nodes: node, n, embedding."""
    reach = math.sqrt((1 - threshold) / 2) if reach is None else reach
    counts = width_counts(nodes)
    total = sum(counts.values())
    share = min(1.0, sample / max(total, 1))
    held = (nodes.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
            .select("node", "embedding").limit(2 * sample).toPandas().sort_values("node"))
    held_of = dict(list(held["embedding"].groupby(held["embedding"].map(len)))) if len(held) else {}
    centres, first = {}, 0
    for width, n in counts.items():
        x = matrix(held_of[width], width) if width in held_of else np.eye(1, width)  # too rare for the sample: one cell
        centres[width] = first, fit_centres(x, max(1, min(most_cells * n // total, n // per_cell, len(x))))
        first += len(centres[width][1])
    placed = stored(_assign(nodes, centres, reach))
    each = placed.select("home", F.explode("cells").alias("cell"), "node", "n", "v", "cells")
    at_home = F.col("home") == F.col("cell")
    size = each.groupBy("cell").agg(F.sum(at_home.cast("int")).alias("h"), F.sum((~at_home).cast("int")).alias("r"))
    size = size.select(F.col("cell").alias("c"), F.expr(f"int(ceil(h / {block}))").alias("hb"), F.expr(f"int(ceil(r / {block}))").alias("rb"))
    # One row per cell: most_cells at most, and one per width.
    each = each.join(F.broadcast(settled(size)), F.expr("cell = c")).filter("hb > 0")
    own = F.pmod(F.xxhash64("node", F.lit(9)), F.when(at_home, F.col("hb")).otherwise(F.greatest("rb", F.lit(1)))).cast("int")
    each = each.withColumn("k", own)
    tasks = F.when(at_home, F.expr("""concat(
        transform(sequence(0, hb - 1), o -> named_struct('i', least(k, o), 'j', greatest(k, o), 'side', int(k > o), 'cross', k != o, 'visit', false)),
        if(rb > 0, transform(sequence(0, rb - 1), o -> named_struct('i', k, 'j', o, 'side', 0, 'cross', true, 'visit', true)), array()))""")).otherwise(
        F.expr("transform(sequence(0, hb - 1), o -> named_struct('i', o, 'j', k, 'side', 1, 'cross', true, 'visit', true))"))
    spread = each.select("cell", "home", "node", "n", "v", "cells", F.explode(tasks).alias("t")).select(
        "cell", "home", "node", "n", "v", F.when(F.col("t.visit") & (F.col("t.side") == 0), F.col("cells")).alias("cells"), "t.*")
    return (spread.groupBy("cell", "visit", "i", "j").applyInPandas(lambda g: _compare(g, threshold), "a long, b long, links long"))


def near_vectors(rows: DataFrame, threshold: float = 0.95, **how) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    key = F.xxhash64("embedding")
    good = usable(rows.select("vec_id", "embedding"))
    nodes = stored(good.groupBy(key.alias("node")).agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"),
                                                       F.min("vec_id").alias("first")))
    found = stored(link_vectors(nodes, threshold, **how))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    placed = nodes.select("node", "n", "first").join(counts, "node", "left").join(roots, "node", "left")
    placed = settled(placed.select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                                   F.coalesce("root", "node").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = placed.join(lowest, "root").select("node", "n_links", "component_id")
    keyed = rows.select("vec_id", "embedding").withColumn("node", key)
    v = F.col("embedding")
    fit = (v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
           & F.exists(v, lambda x: x != 0))
    out = keyed.select("vec_id", F.when(F.coalesce(fit, F.lit(False)), F.col("node")).alias("node")).join(placed, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
