import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notegrid.llm import ann, vector_dedup

ROWS = "vec_id long, embedding array<float>, label int, node string, score string, block string"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v], 0, "clash", "clash", "clash")
                                  for i, v in enumerate(vectors)], ROWS)


def odd(d):
    return [None, [], [0.0] * d, [math.nan] + [1.0] * (d - 1), [math.inf] + [0.0] * (d - 1), [None] + [1.0] * (d - 1), [1.0] * (d + 1)]


def brute_links(rows, threshold):
    good = {i: np.array(v, np.float64) for i, v in rows if v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    x = np.array([good[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    label = np.arange(len(ids))
    while True:
        new = np.where(linked, label[None], len(ids)).min(1)
        if (new == label).all():
            break
        label = new
    return {i: (int(linked[k].sum()) - 1, ids[label[k]]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block", [8, 1024])
def test_near_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 8))
    vectors = [*base, *(base[0] + rng.normal(size=(70, 8)) * 0.12), *(base[rng.integers(0, 60, 90)] + rng.normal(size=(90, 8)) * 0.2), base[3], base[3],
               base[4] * 1e-20, base[5] * 1e18]
    vectors = [np.asarray(v, np.float32).tolist() for v in vectors] + odd(8)
    df = table(spark, vectors)
    got = {r.vec_id: r for r in vector_dedup.near_vectors(df, 0.95, per_cell=12, block=block).collect()}
    want = brute_links(list(enumerate(vectors)), 0.95)
    assert len(got) == len(vectors)
    for i in got:
        n, component = want.get(i, (0, i))
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, component, component == i), i


def test_near_vectors_of_no_rows_and_of_none_usable(spark):
    df = table(spark, odd(8)[:6])
    assert all(r.kept and r.n_links == 0 for r in vector_dedup.near_vectors(df).collect())
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_every_width_are_compared_with_their_own(spark):
    rng = np.random.default_rng(3)
    vectors, widths = [], (8, 3, 2, 1)
    for d in widths:
        base = rng.normal(size=(20, d))
        vectors += [*base, *(base[:10] * 3), *(base + rng.normal(size=(20, d)) * 0.05)]
    vectors = [np.asarray(v, np.float32).tolist() for v in vectors] + [[1.0, 0.0], [1.0, 0.0, 0.0]]
    df = table(spark, vectors)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(df, 0.95, per_cell=4, block=16).collect()}
    assert len(got) == len(vectors)
    for d in widths:
        own = [(i, v) for i, v in enumerate(vectors) if len(v) == d]
        x = np.array([v for _, v in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= 0.95
        for k, (i, _) in enumerate(own):
            assert got[i][0] == linked[k].sum() - 1, (d, i)
            assert all(got[j][1] == got[i][1] for j, _ in (own[m] for m in np.flatnonzero(linked[k])))
    rows = ann.nearest(df, F.col("vec_id") % 20 == 0, 5, block=16, verify=1.0).collect()
    for i in range(0, len(vectors), 20):
        q = np.array(vectors[i], np.float64)
        want = sorted((-(np.array(v, np.float64) @ q), j) for j, v in enumerate(vectors) if len(v) == len(q) and j != i)[:5]
        found = [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == i]
        assert [j for j, _ in found] == [j for _, j in want] and np.allclose([s for _, s in found], [-s for s, _ in want])


def test_the_smallest_of_query_rows_with_one_id_asks(spark):
    df = table(spark, [[2.0, 0.0]]).unionByName(table(spark, [[1.0, 5.0], [3.0, 1.0]]))
    got = [(r.query_id, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()]
    assert got == [(0, 1, 8.0)]


def best(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            scored = sorted(((-(v @ q), j) for j, v in good if j != i))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def test_exact_when_all_is_verified_and_recall_otherwise(spark):
    rng = np.random.default_rng(2)
    vectors = [np.asarray(v * rng.uniform(0.5, 2), np.float32).tolist() for v in rng.normal(size=(1500, 16))] + odd(16)
    vectors[40] = vectors[41] = vectors[1200]  # ties
    df = table(spark, vectors)
    want = best(list(enumerate(vectors)), 20)
    rows = ann.nearest(df, F.col("vec_id") % 20 == 0, 20, block=400, query_block=30, verify=1.0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]] and np.allclose([s for _, s in got[i]], [s for _, s in want[i]], rtol=1e-12)
    rows = ann.nearest(df, F.col("vec_id") % 20 == 0, 20, block=800, verify=0.1).collect()
    found = {(r.query_id, r.vec_id) for r in rows}
    truth = {(i, j) for i, near in want.items() for j, _ in near}
    assert len(found & truth) >= 0.9 * len(truth) and all(sum(r.query_id == i for r in rows) == 20 for i in want)


def test_few_rows(spark):
    df = table(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()]
    assert sorted(got) == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert ann.nearest(df.limit(1), F.col("vec_id") % 20 == 0, 20).count() == 0
