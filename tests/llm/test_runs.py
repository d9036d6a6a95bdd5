import hashlib
import random
import zlib

import numpy as np
import pytest

from notegrid.llm import queries
from notegrid.llm.runs import collapse, find_runs, lyndon_lengths, periodic_runs


def brute_lyndon(symbols):
    n = len(symbols)
    return [max((j - i for j in range(i + 1, n + 1) if all(symbols[i:j] < symbols[k:j] for k in range(i + 1, j))), default=0) for i in range(n)]


def brute_runs(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def test_lyndon_words_under_both_orders():
    rng = random.Random(3)
    for _ in range(600):
        word = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(12))]
        assert lyndon_lengths(word) == brute_lyndon(word)
        assert lyndon_lengths(word, falling=True) == brute_lyndon([-x for x in word])


def test_walls_part_the_text():
    assert lyndon_lengths([0, 1, -1, 0, 1, 2]) == [2, 1, 0, 3, 2, 1]


def repetitive(rng):
    out = []
    for _ in range(rng.randrange(1, 7)):
        unit = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 6))]
        out += unit * rng.randrange(1, 7) + unit[:rng.randrange(len(unit) + 1)]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        words = repetitive(rng)
        assert find_runs(np.array(words, np.int64)) == brute_runs(words), words


@pytest.mark.parametrize("words, want", [
    ([], []), ([1] * 5, []), ([1] * 6, [(0, 6, 1)]), ([1, 2] * 3, []), ([1, 2] * 4, [(0, 8, 2)]),
    ([9, 1, 2, 1, 2, 1, 2, 1, 2, 1, 8], [(1, 9, 2)]), ([7] * 6 + [8] * 6, [(0, 6, 1), (6, 6, 1)])])
def test_edges_of_length_and_exponent(words, want):
    assert find_runs(np.array(words, np.int64)) == want


def test_long_texts_take_time_in_proportion():
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 60_000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for words in ([5] * 60_000, list(range(6)) * 10_000, list(range(60_000)), fibonacci[1]):
        runs = find_runs(np.array(words, np.int64))
        assert len(runs) <= 1
        assert not runs or runs[0][:2] == (0, 60_000)


def test_too_few_periods_are_refused():
    with pytest.raises(ValueError):
        find_runs(np.zeros(9, np.int64), times=2)


def expected(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = " ".join(collapse(words, runs))
    return (doc_id, len(runs), *top, None if not runs else 1000 * top[1] // top[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_over_small_documents(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a b " * 30, "é x é x\ty\x1cz " * 9, "x " * 4000]
    texts += [rng.choice([" ", "\n", "  ", "\x0b"]).join(f"w{x}" for x in repetitive(rng)) for _ in range(150)]
    texts += [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(80))) for _ in range(100)]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == [expected(k, t) for k, t, _ in rows]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _, _ in rows) > 10


def test_operator_keeps_rows_and_gives_the_text(spark):
    rows = [(None, "go go go go go go on", 1), (7, "go go go go go go on", 2), (7, "go go go go go go on", 2), (8, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = periodic_runs(docs, with_text=True).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_runs, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (None, 1, [(0, 6, 1)], "go on"), (7, 1, [(0, 6, 1)], "go on"), (7, 1, [(0, 6, 1)], "go on"), (8, 0, [], "")]
    assert periodic_runs(docs.filter("doc_id > 100")).collect() == []
