import random
import re

import pytest
from pyspark.sql import functions as F

from notegrid.operators.similar import held_in, lookup_or_suggest, similar_names


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def points(target, name):
    t, f, score = target.strip().lower(), name.split("/")[-1].lower(), 0
    if len(t) >= 4 and len(f) >= 4:
        score += 50 * (f.startswith(t) or t.startswith(f)) + 30 * (t in f or f in t)
    words = lambda x: [w for w in re.split(r"[\s\-_]+", x) if len(w) >= 2]
    score += 10 * sum(any(w == x or (len(w) >= 4 and len(x) >= 4 and (w in x or x in w)) for x in words(f)) for w in words(t))
    if len(t) < 20 and len(f) < 20:
        allowed, d = max(1, min(len(t), len(f)) // 5), edits(t, f)
        score += 15 * (allowed + 1 - d) if d <= allowed else 0
    return score


def brute(targets, names, limit):
    out = set()
    for target in {t for t in targets if t is not None and t.strip()}:
        scored = [(-points(target, n), n.lower(), n) for n in {n for n in names if n} if n.lower() != target.strip().lower()]
        for rank, (score, _, name) in enumerate(sorted(s for s in scored if s[0] <= -10)[:limit], 1):
            out.add((target, name, -score, rank))
    return out


def ask(spark, targets, names, **how):
    got = similar_names(spark.createDataFrame([(t,) for t in targets], "target string"),
                        spark.createDataFrame([(n,) for n in names], "name string"), **how).collect()
    assert len(got) == len(set(map(tuple, got)))
    return set(map(tuple, got))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["order", "orders", "reorder", "red", "lavender", "lace", "cust", "customer", "ab", "a", "0001", "10001", "Straße", "blue", "bluebell"]
    names = [f"Order {k}" for k in range(60)] + [f"Customer {k:09d}" for k in range(40)] + [f"NATION_{k}" for k in range(25)]
    names += [rng.choice([" ", "-", "_", "  "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 5))) for _ in range(120)]
    names += ["a/b/Order 7", "x/NATION_3", None, "", "ORDER 7", "abcdefghijklmnopqrs", "abcdefghijklmnopqrstu"]

    def bent(s):
        s = list(s)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(s) + 1)
            s[k:k + rng.randrange(2)] = rng.choice(["", "x", "0", "o", " "])
        return "".join(s)
    targets = [bent(rng.choice([n for n in names if n])) for _ in range(120)] + ["order", "Order", " customer  ", "order order 3", "", "  ", None, "zzzz", "NATOIN_3"]
    return targets, names


@pytest.mark.parametrize("seed, limit, rare", [(1, 5, 200), (2, 3, 4)])
def test_equals_scoring_every_pair(spark, seed, limit, rare):
    targets, names = corpus(seed)
    assert ask(spark, targets, names, limit=limit, rare=rare) == brute(targets, names, limit)


def test_cases(spark):
    one = lambda target, names: [n for _, n, _, _ in sorted(ask(spark, [target], names), key=lambda r: r[3])]
    assert one("Greeting", ["Greeting Card", "greeting", "Meeting"]) == ["Greeting Card"]
    assert one("Gardn", ["Garden", "Guard", "Gate"]) == ["Garden"]
    assert one("airborne", ["AI", "ne", "orne"]) == ["orne"]
    assert one("nothing-alike", ["_odd-one", "____", "Verse"]) == []
    assert one("Tests", [f"Test{k}" for k in range(7)]) == [f"Test{k}" for k in range(5)]


def test_empty_inputs(spark):
    assert ask(spark, ["order"], []) == set() and ask(spark, [], ["order"]) == set()


def test_held_texts(spark):
    short = spark.createDataFrame([(x,) for x in ("abcd", "bcde", "abc", "zzzz", "abcdabcd")], "short string")
    long = spark.createDataFrame([(x,) for x in ("abcde", "abcd", "xabcdx", "abc")], "long string")
    assert {tuple(r) for r in held_in(short, long).collect()} == {
        ("abcd", "abcde"), ("abcd", "abcd"), ("abcd", "xabcdx"), ("bcde", "abcde")}


@pytest.mark.parametrize("hot", [0, 30, 10_000])
def test_far_edits_are_found_by_halves_and_busy_halves_by_the_edits_left(spark, hot):
    from notegrid.operators.similar import _far_edits, _near_edits
    rng = random.Random(hot)

    def bent(s):
        s = list(s)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(s) + 1)
            s[k:k + rng.randrange(2)] = rng.choice(["", "x", "0", "1", "\u0001"])
        return "".join(s)
    names = sorted({f"{x} {k:0{d}d}" for x, d in (("supplier", 9), ("order", 5), ("customer\u0001", 8)) for k in range(60)})
    texts = sorted({bent(n.replace("pp", "p")) for n in names})
    got = {(r.t, r.f) for r in _far_edits(spark.createDataFrame([(t,) for t in texts], "t string"),
                                          spark.createDataFrame([(n,) for n in names], "f string"), hot).collect()}
    size = lambda t, f: edits(t, f) if 10 <= len(t) < 20 and 10 <= len(f) < 20 else 99
    assert got >= {(t, f) for t in texts for f in names if size(t, f) <= min(len(t), len(f)) // 5}
    assert all(size(t, f) <= 3 for t, f in got)
    near = _near_edits(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(n,) for n in names], "f string"))
    assert {tuple(r) for r in near.collect()} >= {(t, f) for t in texts for f in names if edits(t, f) <= 1 and max(len(t), len(f)) < 20}


def test_lookup_or_suggest(spark):
    notes = spark.createDataFrame([("A/Garden.md", "Garden"), ("B/Garden.md", "Garden"), ("A/Gate.md", "Gate")], "path string, name string")
    aliases = spark.createDataFrame([("A/Gate.md", "Door")], "path string, alias string")
    queries = spark.createDataFrame([("Gate",), ("door",), ("Garden",), ("Gardn.md",), ("Qqqq",)], "query string")
    got = {r.query: r for r in lookup_or_suggest(queries, notes, aliases).collect()}
    assert (got["Gate"].path, got["Gate"].suggestions, got["Gate"].ambiguous) == ("A/Gate.md", [], False)
    assert got["door"].tier == "alias" and got["Garden"].ambiguous and got["Garden"].suggestions == []
    assert [tuple(s) for s in got["Gardn.md"].suggestions] == [("Garden", 2, None)] and got["Gardn.md"].ambiguous
    assert got["Qqqq"].suggestions == [] and not got["Qqqq"].ambiguous


def test_held_texts_meet_few_others_however_many_share_short_runs(spark, monkeypatch):
    from notegrid.operators import similar as S
    made, settle = [], S.settle
    monkeypatch.setattr(S, "settle", lambda df: made.append(settle(df)) or made[-1])
    short = spark.createDataFrame([("00000123",), ("0000",), ("abc",)], "short string")
    names = [f"{k:09d}" for k in range(0, 3000, 3)]
    got = S.held_in(short, spark.createDataFrame([(n,) for n in names], "long string"))
    assert {tuple(r) for r in got.collect()} == {(s, n) for s in ("00000123", "0000") for n in names if s in n}
    assert made[-1].filter("g <> '0000'").count() == sum("00000123" in n for n in names)
