import random

import pytest
from pyspark.sql import functions as F

from notegrid.operators import hierarchy as H
from notegrid.operators import lineage as G
from notegrid.operators import resolve as R
from notegrid.operators import workflow as Wf
from notegrid.types import compile_types


def walk(parents, node):
    seen, at = [], parents.get(node)
    while at is not None and at not in seen:
        seen.append(at)
        at = parents.get(at)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_and_cycles_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(30)]
    parents = {n: rnd.choice(nodes) for n in nodes if rnd.random() < 0.85}
    edges = spark.createDataFrame(list(parents.items()), "child string, parent string")
    got = {(r["path"], r["ancestor"]): r["depth"] for r in H.closure(edges).collect()}
    want = {(n, a): i + 1 for n in parents for i, a in enumerate(walk(parents, n))}
    assert got == want
    members = {r["path"] for r in H.parent_cycles(edges).collect()}
    assert members == {n for n in parents if n in walk(parents, n)}


def test_long_chain_needs_few_rounds(spark):
    edges = spark.range(1, 3000).select(F.col("id").cast("string").alias("child"),
                                        (F.col("id") - 1).cast("string").alias("parent"))
    row = H.forest(edges).agg(F.max("depth").alias("d"), F.count_distinct("root").alias("r")).first()
    assert (row["d"], row["r"]) == (2999, 1)


def test_would_cycle_judges_each_proposal_alone(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "child string, parent string")
    asked = spark.createDataFrame([("a", "c"), ("a", "x"), ("c", "a"), ("q", "q")], "child string, parent string")
    got = {(r["child"], r["parent"]) for r in H.would_cycle(edges, asked).collect()}
    assert got == {("a", "c"), ("q", "q")}


def test_components_of_a_random_graph(spark):
    rnd = random.Random(5)
    pairs = [(f"{rnd.randrange(60):02d}", f"{rnd.randrange(60):02d}") for _ in range(45)]
    label = {}
    for a, b in pairs:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(60):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in G.components(
        spark.createDataFrame(pairs, "child string, parent string")).collect()}
    assert got == label


SCHEMA = compile_types({"types": {
    "project": {"fields": {"lead": {"kind": "relation", "source": ["person"]}, "any": {"kind": "relation"}}},
    "person": {"fields": {"aliases": {"kind": "list", "alias": True}}}, "place": {}}})


def test_source_type_beats_same_name_elsewhere(spark):
    notes = spark.createDataFrame([("P/Ann", "Ann", "person"), ("L/Ann", "Ann", "place"), ("P/Bo", "Bo", "person"),
                                   ("L/Rome", "Rome", "place")], "path string, name string, type string")
    aliases = spark.createDataFrame([("P/Bo", "Bob", "person"), ("P/Ann", "Rome", "person")],
                                    "path string, alias string, type string")
    index = R.target_index(R.name_rows(notes, aliases))
    links = spark.createDataFrame([(i, "project", f, raw) for i, (f, raw) in enumerate([
        ("lead", "[[ann]]"), ("any", "[[Ann]]"), ("lead", "[[L/Ann]]"), ("lead", "[[Bob|him]]"), ("lead", "[[Rome]]"),
        ("lead", "[[Zed]]")])], "src_path int, src_type string, field string, raw string")
    got = {r["src_path"]: (r["resolution"], r["resolved_path"]) for r in R.resolve_links(links, index, SCHEMA).collect()}
    assert got == {0: ("unique", "P/Ann"), 1: ("ambiguous", None), 2: ("unique", "L/Ann"), 3: ("unique", "P/Bo"),
                   4: ("no-source-match", "L/Rome"), 5: ("none", None)}


def test_index_of_asked_keys_shuffles_no_other_names(spark):
    notes = spark.createDataFrame([("P/Ann", "Ann", "person"), ("L/Ann", "Ann", "place"), *[(f"L/X{i}", f"X{i}", "place") for i in range(50)]],
                                  "path string, name string, type string")
    aliases = spark.createDataFrame([("P/Ann", "Bob", "person"), ("L/X1", "other", "place")], "path string, alias string, type string")
    links = spark.createDataFrame([(i, "project", f, raw) for i, (f, raw) in enumerate([
        ("lead", "[[ann#h|she]]"), ("any", "[[Ann]]"), ("lead", "[[L/Ann]]"), ("lead", "[[BOB]]"), ("lead", "[[Zed]]"), ("lead", "")])],
        "src_path int, src_type string, field string, raw string")
    targets = R.name_rows(notes, aliases)
    asked = R.asked_index(targets, links)
    assert {r["key"] for r in asked.collect()} == {"ann", "l/ann", "bob"}
    assert sorted(R.resolve_links(links, asked, SCHEMA).collect()) == sorted(R.resolve_links(links, R.target_index(targets), SCHEMA).collect())
    ambiguous = R.resolve_links(links, asked, SCHEMA).filter("resolution = 'ambiguous'")
    found = R.link_candidates(ambiguous, targets)
    assert sorted((r["key"], r["path"]) for r in found.collect()) == [("ann", "L/Ann"), ("ann", "P/Ann")]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" in \
        found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().executedPlan().toString()


def test_previous_values_across_quiet_days(spark):
    rows = [(1, "k", "2024-01-01 10:00:00", "a"), (2, "k", "2024-01-01 11:00:00", "b"), (3, "k", "2024-01-09 01:00:00", "b"),
            (4, "k", "2024-01-20 01:00:00", "a"), (5, "z", "2024-01-20 01:00:00", "b")]
    log = spark.createDataFrame(rows, "id int, key string, t string, v string").withColumn("t", F.to_timestamp("t"))
    got = {r["id"]: r["before"] for r in Wf.previous_values(log, "key", "t", "id", "v").collect()}
    assert got == {1: None, 2: "a", 3: "b", 4: "b", 5: None}
    assert {r["id"] for r in Wf.transitions(log, "key", "t", "id", "v", "b").collect()} == {2, 5}


def test_previous_values_of_a_busy_key_in_one_day(spark):
    """A third of the log is one key within one day; it lies in many pieces and comes back in order."""
    import random
    rng = random.Random(3)
    rows = [(k, "hot" if k % 3 == 0 else rng.choice(["a", "b", None]), f"2024-01-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:00",
             rng.choice(["x", "y", None])) for k in range(900)]
    log = spark.createDataFrame(rows, "id int, key string, t string, v string").withColumn("t", F.to_timestamp("t"))
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r["before"] for r in Wf.previous_values(log, "key", "t", "id", "v").collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    want, last = {}, {}
    for k, key, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        want[k], last[key] = last.get(key), v
    assert got == want


def test_free_names_fill_gaps_in_order(spark):
    from notegrid.operators.naming import free_names
    notes = spark.createDataFrame([("Plan",), ("Plan 2",), ("Plan 4",), ("Solo 3",)], "name string")
    wanted = spark.createDataFrame([(f"p{i}", "Plan") for i in range(4)] + [("q0", "Solo"), ("q1", "Solo"), ("q2", "Solo")],
                                   "path string, want string")
    got = {r["path"]: r["free_name"] for r in free_names(wanted, notes, ["path"]).collect()}
    assert got == {"p0": "Plan 3", "p1": "Plan 5", "p2": "Plan 6", "p3": "Plan 7", "q0": "Solo", "q1": "Solo 2", "q2": "Solo 4"}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(H, "settle", lambda df, f=H.settle: rounds.append(1) or f(df))
    n = 3000
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(n)], "child string, parent string")
    asked = spark.createDataFrame([(f"n{n}", "n0"), ("n7", "n0"), ("n0", "n7"), ("x", "n1"), ("n5", "n5"), ("n2999", "n1500"), ("n1500", "n2999")],
                                  "child string, parent string")
    got = {(r["child"], r["parent"]) for r in H.would_cycle(chain, asked).collect()}
    assert got == {(f"n{n}", "n0"), ("n7", "n0"), ("n5", "n5"), ("n2999", "n1500")}
    assert len(rounds) < 60
    rounds.clear()
    short = chain.limit(200)
    assert H.closure(short).count() == 200 * 201 // 2
    assert len(rounds) < 40


def test_rings_are_above_what_hangs_below_them(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("e", "d"), ("f", "d")], "child string, parent string")
    asked = spark.createDataFrame([(x, y) for x in "abcdef" for y in "abcdef"], "child string, parent string")
    above = {"a": "abc", "b": "abc", "c": "abc", "d": "abcd", "e": "abcde", "f": "abcdf"}
    got = {(r["child"], r["parent"]) for r in H.would_cycle(edges, asked).collect()}
    assert got == {(x, y) for y, seen in above.items() for x in seen}
    pairs = {(r["path"], r["ancestor"]): r["depth"] for r in H.closure(edges).collect()}
    assert pairs[("a", "a")] == 3 and pairs[("e", "c")] == 3 and pairs[("e", "b")] == 2 and ("e", "e") not in pairs and len(pairs) == 9 + 3 + 4 + 4


def test_tree_rows_number_a_forest_in_reading_order(spark):
    import random
    rng = random.Random(11)
    names = {f"p{k}": rng.choice(["a", "b", "c", f"n{k}"]) for k in range(400)}
    parent = {}
    for k in range(1, 400):
        if k < 60:
            parent[f"p{k}"] = f"p{k - 1}"  # a long chain
        elif k < 200:
            parent[f"p{k}"] = "p7"  # a busy parent
        elif k < 330:
            parent[f"p{k}"] = f"p{rng.randrange(k)}"
        elif k < 340:
            parent[f"p{k}"] = f"p{330 + (k - 329) % 10}"  # a ring, and a row below it
    parent["p340"], parent["p341"], parent["p342"] = "p335", "p340", "elsewhere"
    children, order = {}, []
    for c, p in parent.items():
        children.setdefault(p, []).append(c)

    def visit(node, root, depth):
        order.append((node, names[node], root, depth, len(order) + 1))
        for c in sorted(children.get(node, []), key=lambda x: (names[x], x)):
            visit(c, root, depth + 1)
    for r in sorted((p for p in names if parent.get(p) not in names), key=lambda x: (names[x], x)):
        visit(r, r, 0)
    assert 300 < len(order) < 400
    notes = spark.createDataFrame(list(names.items()), "path string, name string")
    edges = spark.createDataFrame(list(parent.items()), "child string, parent string")
    got = H.tree_rows(notes, edges)
    assert got.columns == ["path", "name", "root", "depth", "ord"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[4]) == order
    top = sorted(map(tuple, H.tree_rows(notes, edges, max_depth=2).collect()), key=lambda r: r[4])
    assert [r[:4] for r in top] == [r[:4] for r in order if r[3] < 2] and [r[4] for r in top] == list(range(1, len(top) + 1))
    assert H.tree_rows(notes.limit(0), edges).collect() == []


def test_would_cycle_doubles_no_steps_it_does_not_take(spark, monkeypatch):
    from notegrid.operators import hierarchy
    made, settle = [], hierarchy.settle
    monkeypatch.setattr(hierarchy, "settle", lambda df: made.append(df.columns) or settle(df))
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("y", "x")], "child string, parent string")
    asked = spark.createDataFrame([("a", "d"), ("b", "d"), ("c", "d"), ("a", "c"), ("d", "a"), ("x", "d"), ("x", "y"), ("c", "c")], "child string, parent string")
    got = {tuple(r) for r in hierarchy.would_cycle(edges, asked).collect()}
    assert got == {("a", "d"), ("b", "d"), ("c", "d"), ("a", "c"), ("x", "y"), ("c", "c")}
    assert made.count(["at", "up"]) == 1  # three steps are one and two: one doubling
