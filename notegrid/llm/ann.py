"""Nearest vectors by inner product through collision counting over single projections.

Vectors are hashed into blocks of bounded size. A block keeps one sorted array per projection on an
orthonormal direction. For a query a window around its own projection is opened in every array; a
vector that falls into the windows of more than a set share of the projections is a candidate and its
inner product is computed exactly. Windows widen step by step (virtual rehashing: no array is built
anew) until enough candidates are verified: ``least`` times k and a share ``verify`` of the block. Inner products become distances by one more component per
vector that brings all vectors of a block to the same length.

Queries are dealt in blocks to all vector blocks, so every vector is indexed and seen by every query;
each cell of that grid is one task of bounded size and returns its best ``k`` per query, and the best
of these are ranked. With ``verify`` = 1 the search is exact.

Vectors that are null, empty, zero or hold null or non-finite components take no part. A query meets
the vectors of its own width; each width has blocks of its own. Candidates with the query's vec_id are
its own row; of query rows that share a vec_id the smallest vector asks. Rows without a vec_id are no
queries and no candidates. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.llm.common import stored
from notegrid.llm.vectors import matrix, usable, width_counts


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, x: np.ndarray, projections: int, seed: int):
        self.x = x
        length = np.sqrt((x * x).sum(1))
        self.top = float(length.max())
        full = np.concatenate([x, np.sqrt(np.maximum(self.top ** 2 - length ** 2, 0))[:, None]], 1)
        d = full.shape[1]
        axes = np.random.default_rng(seed).normal(size=(d, d))
        self.axes = np.linalg.qr(axes)[0][:, :min(projections, d)]
        p = full @ self.axes
        self.order = np.ascontiguousarray(np.argsort(p, 0, kind="stable").T)
        self.values = np.ascontiguousarray(np.sort(p, 0).T)

    def project(self, q: np.ndarray) -> np.ndarray:
        """Queries at the length of the longest vector; that changes no order of inner products."""
        q = q / np.sqrt((q * q).sum(1, keepdims=True)) * self.top
        return np.concatenate([q, np.zeros((len(q), 1))], 1) @ self.axes

    def search(self, q: np.ndarray, own: list[np.ndarray], k: int, share: float, verify: float, least: float,
               cover: float, growth: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (rows, inner products) of its best ``k`` candidates; ``own`` are rows to leave out."""
        n, m = len(self.x), len(self.order)
        at = self.project(q)
        some = np.linspace(0, n - 1, min(n, 256)).astype(int)
        near = np.abs(self.values[:, some][:, None, :] - at[:64].T[:, :, None])
        width0 = float(np.quantile(near, cover)) or self.top * 1e-6 or 1e-12
        need, enough = share * m, least * k + verify * n
        edges: list[tuple[np.ndarray, np.ndarray]] = []  # per step, first and past-last places of all windows

        def windows(step: int) -> tuple[np.ndarray, np.ndarray]:
            while len(edges) <= step:
                width = width0 * growth ** len(edges)
                edges.append((np.stack([np.searchsorted(v, c - width) for v, c in zip(self.values, at.T)]),
                              np.stack([np.searchsorted(v, c + width, side="right") for v, c in zip(self.values, at.T)])))
            return edges[step]

        out = []
        for i in range(len(q)):
            count = np.zeros(n, np.int64)
            step = 0
            while True:
                low, high = (e[:, i].tolist() for e in windows(step))
                if step == 0:
                    ring = [o[s:e] for o, s, e in zip(self.order, low, high)]
                else:  # only what the wider windows add
                    ring = ([o[s:e] for o, s, e in zip(self.order, low, low_before)]
                            + [o[s:e] for o, s, e in zip(self.order, high_before, high)])
                count += np.bincount(np.concatenate(ring), minlength=n)
                rows = np.flatnonzero(count >= need)
                if len(rows) >= min(enough, n):
                    break
                low_before, high_before = low, high
                step += 1
            rows = rows[~np.isin(rows, own[i])] if len(own[i]) else rows
            score = self.x[rows] @ q[i]
            if len(rows) > k:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                keep = score >= edge  # all ties with the last place; ids decide later
                rows, score = rows[keep], score[keep]
            out.append((rows, score))
        return out


def _search(group: pd.DataFrame, k: int, how: dict) -> pd.DataFrame:
    x, q = group[~group["is_query"]].sort_values("vec_id"), group[group["is_query"]]
    names = ["query_id", "vec_id", "score"]
    if not len(x) or not len(q):
        return pd.DataFrame({n: np.zeros(0, np.int64 if n != "score" else float) for n in names})
    ids, width = x["vec_id"].to_numpy(), int(group["width"].iloc[0])
    index = Index(matrix(x["embedding"], width), how["projections"], how["seed"])
    qid = q["vec_id"].to_numpy()
    own = [np.arange(np.searchsorted(ids, i), np.searchsorted(ids, i, side="right")) for i in qid]
    found = index.search(matrix(q["embedding"], width), own, k, how["share"], how["verify"], how["least"], how["cover"], how["growth"])
    parts = []
    for i, (rows, score) in zip(qid, found):
        best = np.lexsort((ids[rows], -score))[:k]
        parts.append((np.full(len(best), i), ids[rows][best], score[best]))
    return pd.DataFrame({n: np.concatenate([p[j] for p in parts]) for j, n in enumerate(names)})


def nearest(rows: DataFrame, is_query: Column, k: int = 20, block: int = 8192, query_block: int = 512, projections: int = 64,
            share: float = 0.6, verify: float = 0.1, least: float = 12.0, cover: float = 0.46, growth: float = 1.06, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows found for each query row."""
    good = stored(usable(rows.select("vec_id", "embedding").filter("vec_id IS NOT NULL"))
                  .withColumn("asks", F.coalesce(is_query, F.lit(False))))
    width = F.size("embedding").alias("width")
    asked = good.filter("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries_of = width_counts(asked)
    sizes = [(w, -(-n // block), -(-queries_of[w] // query_block)) for w, n in width_counts(good).items() if w in queries_of]
    cells = sum(b * q for _, b, q in sizes)
    grid = F.broadcast(rows.sparkSession.createDataFrame(sizes, "width int, blocks int, query_blocks int"))  # a row per width
    key = F.xxhash64("vec_id", "embedding")
    vectors = good.select("vec_id", "embedding", width).join(grid, "width").select(
        "width", "vec_id", "embedding", F.pmod(key, F.col("blocks")).cast("int").alias("block"),
        F.explode(F.expr("sequence(0, query_blocks - 1)")).alias("query_block"), F.lit(False).alias("is_query"))
    queries = asked.select("vec_id", "embedding", width).join(grid, "width").select(
        "width", "vec_id", "embedding", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
        F.pmod(key, F.col("query_blocks")).cast("int").alias("query_block"), F.lit(True).alias("is_query"))
    how = {"projections": projections, "share": share, "verify": verify, "least": least, "cover": cover, "growth": growth, "seed": seed}
    found = (vectors.unionByName(queries).repartition(max(cells, 1), "width", "block", "query_block")
             .groupBy("width", "block", "query_block")
             .applyInPandas(lambda g: _search(g, k, how), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
