import random
import re

import numpy as np

from notegrid.llm import minhash
from notegrid.llm.text_arrays import pair_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, n_shingles string, node int, component_id string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(map(tuple, [w])) if w else frozenset()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    low = {i: i for i, _ in sets if i is not None}
    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return {(i, len(s), None if i is None else find(i)) for i, s in sets}


def corpus(seed, n_groups, group):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, group)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = corpus(3, 25, 14) + corpus(4, 2, 60)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    rows += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "one"), (9004, "ONE "), (None, rows[0][1]), (9005, "one two"),
             (9006, "long " + "x" * 700_000 + " end"), (9007, "a b " * 200_000)]
    docs = spark.createDataFrame([(i, t, None, "clash", 1, "clash") for i, t in rows], DOCS)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_last_round_finds_what_stars_miss(spark):
    rows = [(k, t) for k, (_, t) in enumerate(corpus(5, 2, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, star_rounds=0).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for overlap in (0.5, 0.8, 0.95):
        n = 40  # fewer shingles than bins: most bins are filled by copying
        agree = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)
            both = int(round(2 * n * overlap / (1 + overlap)))
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n:2 * n - both]]))
            agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(agree) - both / (2 * n - both)) < 0.06


def test_words_are_hashed_alike_wherever_they_stand():
    whole = np.frombuffer(b"Aa bb\tcc aa", np.uint8)
    h = word_hashes(whole)
    assert len(h) == 4 and h[0] == h[3] and len(set(h.tolist())) == 3
    long = ("word other " * 100_000).encode()
    h = word_hashes(np.frombuffer(long, np.uint8))
    assert len(h) == 200_000 and len(np.unique(h)) == 2 and len(pair_hashes(h)) == 2
