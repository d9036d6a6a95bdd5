import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from notegrid.llm import prefix_trie as pt


def brute(rows, family=1, taken=pt.no_repeats):
    """Nodes of the trie by plain dictionaries; rows are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), role or "", key, text or ""))
    turns = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        base = c - (c % family if c >= 0 else -(-c % family))
        rebuilt[c] = turns.get(base, [])[:taken(c)] + mine[taken(c):]
    nodes = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        white = "".join(" " if ch in " \t\n\x0b\f\r" else ch for ch in path[-1][1]) if path else ""
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(nodes[path]) - 1) * len([w for w in white.split(" ") if w]) + sum(saved[k] for k in kids[path])
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids[path]), leaves[path],
                    saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture
def scattered(spark):
    """Several partitions whatever the size, so that conversations and families run across them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def rows_of(seed, convs=45, most=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-25, 90), convs):
        for t in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b", "x", "", None, "  y\n z"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(scattered, seed):
    rows = rows_of(seed)
    df = scattered.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = pt.prefix_trie(df, family=20, taken=pt.crc32_mod(4))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 20, pt.crc32_mod(4))


def test_long_copies_and_small_sketch(scattered, monkeypatch):
    """Two copies of one long conversation, a hot first turn, and a sketch far too small: more is shuffled, the rows stay."""
    monkeypatch.setattr(pt, "BLOCK", 16)
    rows = [(c, t, "user", f"t{t} w") for c in (5, 40) for t in range(70)]
    rows += [(c, t, "user", "hello there" if t == 0 else f"{c} {t}") for c in range(100, 140) for t in range(3)]
    rows += [(c, 0, "user", "same") for c in range(200, 230)]
    df = scattered.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    monkeypatch.setattr(pt, "_shared_bits", full_cells(pt._shared_bits))
    got = pt.prefix_trie(df)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def full_cells(real):
    def some(rows, width):
        bits = real(rows, width)
        bits[::2] = 0xFFFFFFFF  # false alarms in half of all cells
        return bits
    return some


def test_turnless_conversations_belong_to_the_root(scattered):
    first = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(first, 0, "user", "gone"), (30, 0, "user", "stays")]
    df = scattered.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, pt.prefix_trie(df, 20, pt.crc32_mod(4)).collect()), key=repr)
    assert got == brute(rows, 20, pt.crc32_mod(4))
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 2 and root[7] == hashlib.sha256(str(first).encode() if zlib.crc32(b"30") % 4 == 0 else f"{first},30".encode()).hexdigest()


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 0, "user", "x", "x")], SCHEMA)
    assert pt.prefix_trie(df).collect() == []
    assert pt.prefix_trie(df.limit(0)).collect() == []
    one = spark.createDataFrame([(3, None, None, None, "x"), (3, None, None, None, "x")], SCHEMA)
    assert sorted(map(tuple, pt.prefix_trie(one).collect()), key=repr) == brute([(3, None, None, None)] * 2)
