import re

import pytest

from notegrid.llm import mixing

DOCS = "doc_id long, source string, text string, size string, places int"


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, full = share * sum(sizes.values()), {}, set()
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / sum(w[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def rows(n=900):
    out = []
    for i in range(n):
        source = "hot" if i % 3 else [None, "a", "é", "b", "Z", "tiny"][i // 3 % 6]
        out.append((i, source, f"w{i} " * (i * 7919 % 90), "clash", 1))
    return out + [(5000, "a", None, None, None), (5001, "a", "", None, None), (5002, "none", " ", None, None),
                  (None, "a", "x y z", None, None), (5003, "a", "rep " * 40, None, None), (5003, "a", "rep " * 40, None, None),
                  (5004, "b", "long " * 30_000, None, None)]


@pytest.mark.parametrize("block_rows", [4, 512])
def test_targets_are_met_and_shards_hold_their_quotas(spark, block_rows):
    data = rows()
    docs = spark.createDataFrame(data, DOCS)
    got = mixing.mix(docs, block_rows=block_rows, shards=4).collect()
    assert len(got) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, s, t, *_ in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = fill(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == size(r.text) and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == sum(p["words"] for p in r.places)
        assert r["_in_size"] in ("clash", None)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1, s
    again = mixing.mix(docs.repartition(7), block_rows=block_rows, shards=4).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken, [tuple(p) for p in r.places])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len({p["shard"] for r in got for p in r.places}) == 4 or block_rows == 512


def test_splitting_tree_keeps_quotas(spark):
    blocks = spark.createDataFrame([(1, 97), (2, 13), (3, 0), (4, 401)], "rank int, n long")
    got = mixing.shard_quotas(blocks, 8, seed=3).collect()
    for rank, n in ((1, 97), (2, 13), (4, 401)):
        runs = sorted((r["first"], r["upto"]) for r in got if r["rank"] == rank)
        assert runs[0][0] == 0 and runs[-1][1] == n and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    total = {}
    for r in got:
        total[r.shard] = total.get(r.shard, 0) + r["upto"] - r["first"]
    assert max(total.values()) - min(total.values()) <= 4
    share = [r["upto"] - r["first"] for r in got if r["rank"] == 4]
    assert 30 <= min(share) and max(share) <= 70


def test_mixed_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "s", " ".join(f"w{k}" for k in range(10)), None, None) for i in range(7)], DOCS)
    mixed = mixing.mixed_rows(mixing.mix(docs.select("doc_id", "source", "text")), ["doc_id", "text"]).collect()
    assert sum(len(r.text.split()) for r in mixed) == 105
    assert mixing.mix(docs.limit(0)).count() == 0
