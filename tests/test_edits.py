import json

import pytest
from pyspark.sql import functions as F

from notegrid.operators import bulk as B
from notegrid.operators import evolve as V
from notegrid.operators import headers as E
from notegrid.operators import relative as RD
from notegrid.operators import repair as X
from notegrid.operators import rules as Q
from notegrid.plans.audit import audit
from notegrid.types import compile_types

SCHEMA = compile_types({"types": {
    "idea": {"output_dir": "Ideas", "fields": {
        "status": {"kind": "select", "options": ["raw", "done"], "required": True, "default": "raw"},
        "effort": {"kind": "number"}, "archived": {"kind": "boolean"}, "due": {"kind": "date"},
        "labels": {"kind": "list"}, "aliases": {"kind": "list", "alias": True},
        "parent": {"kind": "relation", "source": ["idea"]}}}}})


def heads(df):
    return {r["path"]: json.loads(r["j"]) for r in df.select("path", F.to_json("fm").alias("j")).collect()}


MESSY = {
    "Ideas/a": {"type": "idea", "status": "RAW", "effort": "3", "archived": "true", "due": "2024/5/1", "labels": ["x", "x", None]},
    "Ideas/b": {"type": "idea", "status": "", "effort": [7], "labels": "solo", "Due": "2024-01-02", "parent": "[[a]"},
    "Ideas/c": {"type": "idea", "status": "done", "label": ["q"], "aliases": ["A", " ", "A"], "parent": "a"},
}


def test_repairs_reach_a_state_without_fixable_field_issues(notes_of):
    notes = notes_of(MESSY)
    fixed = E.apply_changes(notes, X.repair_fields(notes, SCHEMA))
    assert heads(fixed) == {
        "Ideas/a": {"type": "idea", "status": "raw", "effort": 3, "archived": True, "due": "2024-05-01", "labels": ["x"]},
        "Ideas/b": {"type": "idea", "status": "raw", "effort": 7, "labels": ["solo"], "due": "2024-01-02", "parent": "[[a]]"},
        "Ideas/c": {"type": "idea", "status": "done", "labels": ["q"], "aliases": ["A"], "parent": "[[a]]"}}
    assert Q.field_issues(fixed, SCHEMA).filter("auto_fixable").count() == 0


def test_audit_of_clean_notes_is_empty_and_codes_are_checked(notes_of):
    notes = notes_of({"Ideas/x": {"type": "idea", "status": "done", "due": "2024-01-01"}})
    assert audit(notes, SCHEMA, "2024-06-01").count() == 0
    with pytest.raises(ValueError, match="unknown issue code"):
        audit(notes, SCHEMA, "2024-06-01", only=["nonsense"])


def test_bulk_chain_sees_earlier_steps_and_rename_conflict_stops(notes_of):
    notes = notes_of({"n": {"tags": "a"}, "m": {"tags": ["a", "b"], "z": 1}})
    steps = [B.bulk_append("tags", "c"), B.bulk_remove("tags", "a"), B.bulk_rename("tags", "labels")]
    assert heads(B.bulk_apply(notes, steps)) == {"n": {"labels": ["c"]}, "m": {"labels": ["b", "c"], "z": 1}}
    assert heads(E.apply_changes(notes, B.bulk(notes, steps))) == heads(B.bulk_apply(notes, steps))
    with pytest.raises(Exception, match="already exists"):
        B.bulk(notes, [B.bulk_rename("tags", "z")]).collect()


@pytest.mark.parametrize("text,value", [("true", True), ("3", 3), ("2.5", 2.5), ("x y", "x y"), ("", None)])
def test_literals(text, value):
    assert B.literal(text) == value


def test_a_migration_applied_twice_changes_nothing(notes_of):
    notes = notes_of({"n": {"s": "old", "t": "x", "l": "[[A]]"}, "m": {"s": ["new", "old"], "u": 1}})
    steps = [V.migrate_options("s", ["new"]), V.migrate_widen("t"), V.migrate_rename("u", "v"),
             V.migrate_add("k", '"d"'), V.migrate_links("l", "markdown")]
    once = V.migrate_apply(notes, steps)
    assert heads(once) == {"n": {"t": ["x"], "l": "[A](A.md)", "k": "d"}, "m": {"s": ["new"], "v": 1, "k": "d"}}
    assert V.migrate(once, steps).count() == 0


def test_relative_dates(spark):
    c = [("b", 1, "equal", "a", 1, "mon"), ("c", 1, "equal", "b", 1, "d"), ("r", 1, "equal", "s", 0, "d"), ("s", 1, "equal", "r", 0, "d"),
         ("t", 1, "equal", "r", 0, "d"), ("u", 1, "equal", "gone", 0, "d"), ("w", 1, "after", "a", 0, "d")]
    constraints = spark.createDataFrame(c, "node string, ord int, kind string, target string, amount int, unit string")
    anchors = spark.createDataFrame([("a", "2024-01-31")], "node string, day string").withColumn("day", F.to_date("day"))
    got = {r["node"]: (str(r["day"]), r["resolution"]) for r in RD.relative_dates(constraints, anchors).collect()}
    assert got == {"b": ("2024-03-02", "ok"), "c": ("2024-03-03", "ok"), "r": ("None", "cycle"), "s": ("None", "cycle"),
                   "t": ("None", "cycle"), "u": ("None", "unanchored"), "w": ("None", "unanchored")}
