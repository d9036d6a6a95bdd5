import datetime

import json
import uuid

from pyspark.sql import functions as F

from notegrid.sources import notes as N
from notegrid.sources import sinks as K
from notegrid.streaming.changes import judge_batch, stream_notes, stream_transitions
from notegrid.types import compile_types

SCHEMA = compile_types({"types": {"idea": {"output_dir": "Ideas", "fields": {"b": {"kind": "text"}, "a": {"kind": "text"}}}}})


def write(root, files):
    for rel, text in files.items():
        target = root / rel
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")


def test_read_write_round_trip(spark, tmp_path):
    root = tmp_path / "in"
    write(root, {"Ideas/One+1 %.md": "---\ntype: idea\na: 2024-01-05\nb: yes\nn: [1, null]\n---\nbody\n---\nmore",
                 "Ideas/Plain.md": "no header", ".hidden/x.md": "---\na: 1\n---\n", "Ideas/bad.md": "---\na: [1\n---\nrest"})
    notes = N.read_notes(spark, str(root), SCHEMA)
    rows = {r["path"]: r for r in notes.select("*", F.to_json("fm").alias("j")).collect()}
    assert set(rows) == {"Ideas/One+1 %", "Ideas/Plain", "Ideas/bad"}
    one = rows["Ideas/One+1 %"]
    assert json.loads(one["j"]) == {"type": "idea", "a": "2024-01-05", "b": "yes", "n": [1, None]}
    assert one["body"] == "body\n---\nmore" and one["directory_type"] == "idea"
    assert rows["Ideas/Plain"]["j"] is None and rows["Ideas/bad"]["error"]

    out = tmp_path / f"out-{uuid.uuid4().hex}"
    K.write_files(notes.withColumn("raw", K.render(notes, SCHEMA)), str(out))
    again = N.read_notes(spark, str(out), SCHEMA)
    pick = lambda df: sorted((r["path"], r["j"], r["body"]) for r in df.select(
        "path", F.to_json("fm").alias("j"), "body").collect())
    assert pick(notes) == pick(again)
    text = (out / "Ideas/One+1 %.md").read_text()
    assert text.index('b: "yes"') < text.index('a: "2024') < text.index("n: [1,null]")


def test_ignore_rules_nest_and_override(spark):
    paths = ["Drafts/a", "Drafts/keep/b", "Work/tmp/c", "Work/tmp", "Work/d", "x/Drafts/e"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = N.ignore_patterns(df, [("", "/Drafts/\n!/Drafts/keep/\n"), ("Work", "tmp/\n")])
    assert sorted(r[0] for r in kept.collect()) == ["Drafts/keep/b", "Work/d", "Work/tmp", "x/Drafts/e"]


def test_structure_scan_and_repair(spark):
    raws = ["intro\n---\ntype: t\na: 1\na:\n---\nbody", "---\nk: v \nt: |\n  x \nu: 2\n---\n", "plain", "---\nk: 1\nk: 2\n"]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "path string, raw string")
    got = sorted((r["path"], r["code"], r["field"], r["auto_fixable"]) for r in N.structural_issues(df).collect())
    assert got == [("0", "duplicate-frontmatter-keys", "a", True), ("0", "frontmatter-not-at-top", None, True),
                   ("1", "trailing-whitespace", "k", True)]
    fixed = {r["path"]: r["raw"] for r in df.select("path", N.fix_structure(F.col("raw")).alias("raw")).collect()}
    assert fixed["0"] == "---\ntype: t\na: 1\n---\nintro\nbody" and fixed["2"] == "plain"


def test_stream_batches_carry_state(spark):
    def log(rows):
        return spark.createDataFrame(rows, "id int, k string, t string, v string").withColumn("t", F.to_timestamp("t"))

    first, state = judge_batch(log([(1, "k", "2024-01-01", "a"), (2, "k", "2024-01-02", "e"), (3, "z", "2024-01-01", "e")]),
                               None, "k", "t", "id", "v", "e")
    assert {r["id"] for r in first.collect()} == {2, 3}
    second, after = judge_batch(log([(4, "k", "2024-01-03", "e"), (5, "z", "2023-12-31", "a"), (6, "n", "2024-01-03", "e")]),
                                state, "k", "t", "id", "v", "e")
    assert {r["id"] for r in second.collect()} == {6}
    assert {r["k"]: r["last_value"] for r in after.collect()} == {"k": "e", "z": "e", "n": "e"}


def test_stream_waits_and_judges_late_rows_in_their_place(spark, tmp_path):
    kind = "id long, k string, t timestamp, v string, more int"
    at = lambda m: datetime.datetime(2024, 1, 1, m // 60, m % 60)
    seen = {}

    def batch(rows):
        spark.createDataFrame([(*r, 1) for r in rows], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = stream_transitions(log, str(tmp_path / "run"), "k", "t", "id", "v", "e", "30 minutes",
                               on_entries=lambda rows, n: seen.__setitem__(n, [tuple(r) for r in rows.collect()]))
        q.awaitTermination()
        return q

    batch([(1, "a", at(1), "e"), (2, "a", at(20), "e"), (3, "b", at(5), "x")] + [(100 + k, f"k{k}", at(2), "x") for k in range(40)])
    assert not [r for rows in seen.values() for r in rows]
    batch([(4, "a", at(10), "x"), (5, "b", at(15), "e"), (6, "b", at(15), "e"), (7, "a", at(25), None)])  # 4 is late and makes 2 an entry
    last = batch([(8, "b", at(300), "x"), (9, None, at(300), "x")])
    rows = sorted((r for rows in seen.values() for r in rows), key=lambda r: r[2])
    assert rows == [("a", at(1), 1, "e", None), ("a", at(20), 2, "e", "x"), ("b", at(15), 5, "e", "x")]
    batch([(10, "a", at(310), "e"), (11, "a", at(3), "e")])  # 11 is later than the delay
    last = batch([(12, "z", at(900), "e")])
    rows = sorted((r for rows in seen.values() for r in rows), key=lambda r: r[2])
    assert rows[3:] == [("a", at(310), 10, "e", None)]
    state = [p["stateOperators"][0]["numRowsUpdated"] for p in last.recentProgress if p["stateOperators"]]
    assert sum(state) < 20  # of more than forty keys


def test_notes_stream(spark, tmp_path):
    write(tmp_path / "v", {"Ideas/a.md": "---\ntype: idea\n---\nx"})
    q = stream_notes(spark, str(tmp_path / "v"), SCHEMA).select("path", "type").writeStream.format("memory") \
        .queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT * FROM seen").collect()] == [("Ideas/a", "idea")]


def test_stream_makes_one_state_call_and_timer_per_key_and_batch():
    import pandas as pd

    from notegrid.streaming.changes import Entered

    class Kept:
        def __init__(self):
            self.rows, self.calls, self.timers = [], 0, []

        def appendList(self, rows):
            self.calls, self.rows = self.calls + 1, self.rows + rows

        def put(self, rows):
            self.calls, self.rows = self.calls + 1, rows

        update = put
        get = lambda self: iter(self.rows)
        exists = lambda self: bool(self.rows)
        clear = lambda self: self.rows.clear()
        registerTimer = lambda self, at: self.timers.append(at)

    class Handle(Kept):
        def getListState(self, *_):
            return self

        def getValueState(self, *_):
            state = Kept()
            state.get = lambda: state.rows
            return state

    handle, judge = Handle(), Entered(["k", "t", "id", "v"], ["timestamp", "bigint", "string"], "e")
    judge.init(handle)
    rows = pd.DataFrame({"t": pd.to_datetime(range(1000, 0, -1), unit="s"), "id": range(1000), "v": ["e", "x"] * 500})
    list(judge.handleInputRows(("k",), iter([rows]), None))
    assert (handle.calls, handle.timers) == (1, [1001])

    class Now:
        getCurrentWatermarkInMs = lambda self: 500_500

    found = list(judge.handleExpiredTimer(("k",), Now(), None))[0]
    assert len(found) == 250 and handle.timers == [1001, 501_001] and len(handle.rows) == 500
    assert list(judge.handleExpiredTimer(("k",), Now(), None)) == []


def test_many_files_are_few_tasks(spark, tmp_path):
    notes = spark.range(600).select(F.concat(F.lit("F"), F.col("id") % 3, F.lit("/n"), "id").alias("path"),
                                    F.concat(F.lit("---\nzeta: "), "id", F.lit("\n---\nbody")).alias("raw"))
    K.write_files(notes, str(tmp_path / "many"))
    assert not list((tmp_path / "many").rglob("*.part"))
    back = N.read_notes(spark, str(tmp_path / "many"))
    assert back.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {(r["path"], r["z"]) for r in back.select("path", F.try_variant_get("fm", "$.zeta", "bigint").alias("z")).collect()} == {
        (f"F{i % 3}/n{i}", i) for i in range(600)}
    assert spark.conf.get(N.LIST_BY_TASKS) == "32"


def test_plain_headers_read_as_yaml_does():
    yaml, loader = N.yaml_tools()()
    read = N.plain_header()()
    plain = ['a: "x: #y, [z]"\nb-c: 12\nd_1: -7\ne: true\nf: false\ng: null', 'a: ""\na: 0', 'z: "2024-01-01"']
    for text in plain:
        assert read(text) == yaml.load(text, Loader=loader) and read(text) is not None
    for text in ["", "a: x", 'a: "\\n"', 'a: "é"', "a: 012", "a: -0", "a: 1.5", "a: 2024-01-01", "a:", "a: [1]", "  a: 1", "true: 1", "Null: 1", "a: True",
                 'a: "x" ', "a: 1\n", "a: 1\r", "a: 1 # c", "1: 2", "a: 1234567890123456789"]:
        assert read(text) is None, text


def test_tasks_list_and_read_notes_as_spark_does(spark, tmp_path, monkeypatch):
    for k in range(30):
        folder = tmp_path / f"A{k % 3}" / ("deep" if k % 2 else ".") / "x y"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"Nöte {k}.md").write_text(f"---\ntype: t\nk: {k}\n---\nBody {k}\n" * (k > 0))
    for name in ("_draft.md", ".hidden.md", "_metadata.md", "_a=b.md", "plain.txt", "Top.md", ".git/in.md", "_old/in.md", "A0/dir.md/in.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    cols = ["path", "name", "folder", "ext", "size", "mtime", "body", "raw", "error"]
    want = sorted(tuple(r) for r in N.parse_notes(N._listed(spark, str(tmp_path)), str(tmp_path)).select(*cols).collect())
    monkeypatch.setattr(N, "LIST_ROWS", 4)
    monkeypatch.setattr(N, "READ_BYTES", 10)
    monkeypatch.setattr(N, "_listed", None)  # the driver lists nothing
    for root in (str(tmp_path), f"file:{tmp_path}/"):
        got = N.read_notes(spark, root)
        assert sorted(tuple(r) for r in got.select(*cols).collect()) == want and len(want) == 32
        assert "FileScan" not in got._jdf.queryExecution().toString()
    assert N.read_notes(spark, str(tmp_path / "A1" / "deep")).count() == 5
    (tmp_path / "none").mkdir()
    assert N.read_notes(spark, str(tmp_path / "none")).count() == 0
