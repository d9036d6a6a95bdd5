"""The audit plan knows every code and asks for what its rules read."""

import pytest
from pyspark.sql import functions as F

from notegrid.operators.rules import validate_rows
from notegrid.plans.audit import audit, is_root
from notegrid.types import compile_types

SCHEMA = compile_types({"types": {
    "album": {"output_dir": "A", "fields": {"songs": {"kind": "relation", "source": ["song"], "multiple": True, "owned": True}}},
    "song": {"output_dir": "B", "fields": {"status": {"kind": "text"}, "due": {"kind": "date"}, "next": {"kind": "relation", "source": ["song"]},
                                           "parent": {"kind": "relation", "source": ["song"]}}}}})
ID = "{0}0000000-0000-4000-8000-000000000000".format


def links(spark, *rows):
    return spark.createDataFrame(list(rows), "src_path string, src_type string, field string, raw string")


@pytest.mark.parametrize("code,needs", [("stale-reference", "links"), ("parent-cycle", "links"), ("owned-wrong-location", "links"),
                                        ("missing-body-section", "sections"), ("frontmatter-not-at-top", "raw"),
                                        ("missing-successor", "recurrence"), ("relative-date-cycle", "relative")])
def test_rules_without_their_input_are_refused(notes_of, code, needs):
    with pytest.raises(ValueError, match=needs):
        audit(notes_of({"B/a": {"type": "song"}}), SCHEMA, "2024-01-01", only=[code])


def test_all_codes_in_one_run(notes_of, spark):
    notes = notes_of({
        "A/X/X": {"type": "album"}, "A/Y/Y": {"type": "album"}, "B/s": {"type": "song", "parent": "[[t]]"}, "B/t": {"type": "song", "parent": "[[s]]"},
        "B/u": {"type": "song", "id": ID("a"), "forked-from": ID("b")}, "B/v": {"type": "song", "id": ID("a")},
        "B/w": {"type": "song", "status": "done", "due": "2024-05-01"}, "B/both": {"type": "song"}})
    raw = F.when(F.col("path") == "B/v", "text\n---\ntype: song\n---\n").otherwise("---\ntype: song\n---\n")
    found = links(spark, ("B/s", "song", "parent", "[[t]]"), ("B/t", "song", "parent", "[[s]]"), ("A/X/X", "album", "songs", "[[u]]"),
                  ("A/X/X", "album", "songs", "[[both]]"), ("A/Y/Y", "album", "songs", "[[both]]"), ("B/v", "song", "next", "[[u]]"),
                  ("B/v", "song", "next", "[[gone]]"))
    rel = (spark.createDataFrame([("B/s", 1, "equal", "B/t", 0, "d"), ("B/t", 1, "equal", "B/s", 0, "d")],
                                 "node string, ord int, kind string, target string, amount int, unit string"),
           spark.createDataFrame([], "node string, day date"))
    got = audit(notes.withColumn("raw", raw), SCHEMA, "2024-06-01", links=found, relative=rel,
                recurrence={"trigger_field": "status", "trigger_value": "done", "base": "due"}).collect()
    assert {(r["path"], r["code"]) for r in got if r["code"] != "unknown-field"} >= {
        ("B/s", "parent-cycle"), ("B/t", "parent-cycle"), ("B/u", "duplicate-note-id"), ("B/v", "duplicate-note-id"),
        ("B/u", "dangling-forked-from"), ("B/w", "missing-successor"), ("B/u", "owned-wrong-location"), ("B/both", "owned-ambiguous-owner"),
        ("B/v", "owned-note-referenced"), ("B/v", "stale-reference"), ("B/v", "frontmatter-not-at-top"), ("B/s", "relative-date-cycle")}
    roots = {r["path"] for r in is_root(notes, found, SCHEMA).collect()}
    assert "B/s" not in roots and {"A/X/X", "B/u"} <= roots


def test_rules_are_compiled_and_headers_read_again_only_for_keys_in_doubt(notes_of):
    from notegrid.operators import rules as Q
    schema = compile_types({"types": {"task": {"output_dir": "T", "fields": {"status": {"kind": "text", "required": True}, "due": {"kind": "text"}}}}})
    notes = notes_of({"T/a": {"type": "task", "status": "", "Status": "x"}, "T/b": {"type": "task", "status": "y", "Status": "x"},
                      "T/c": {"type": "task", "Due": "x", "due": " "}, "T/d": {"type": "task", "dues": [], "due": "x"}})
    rows = Q.field_issues(notes, schema, ["empty-string-required", "unknown-field", "frontmatter-key-casing"]).collect()
    assert sorted((r.path, r.code, r.field, r.auto_fixable) for r in rows) == [
        ("T/a", "empty-string-required", "status", False), ("T/a", "frontmatter-key-casing", "Status", True), ("T/a", "unknown-field", "Status", True),
        ("T/b", "frontmatter-key-casing", "Status", False), ("T/b", "unknown-field", "Status", False),
        ("T/c", "frontmatter-key-casing", "Due", True), ("T/c", "unknown-field", "Due", True), ("T/d", "unknown-field", "dues", False)]
    plan = Q.field_issues(notes, schema, ["empty-string-required", "invalid-boolean-coercion"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan


def test_validate_rows_is_the_write_time_check(spark, notes_of):
    schema = compile_types({"types": {
        "area": {"output_dir": "Areas"}, "person": {"output_dir": "People"},
        "task": {"output_dir": "Tasks", "fields": {
            "status": {"kind": "select", "required": True, "options": ["open", "done"], "default": "open"},
            "size": {"kind": "number"}, "hot": {"kind": "boolean"}, "tags": {"kind": "list"}, "due": {"kind": "date", "required": True},
            "area": {"kind": "relation", "source": ["area"]}, "people": {"kind": "relation", "source": ["person"], "multiple": True}}}}})
    task = lambda **f: {"type": "task", "due": "2024-01-15", **f}
    notes = notes_of({
        "Areas/Home": {"type": "area"}, "Areas/Twin": {"type": "area"}, "Areas/b/Twin": {"type": "area"}, "People/Ann": {"type": "person"},
        "Tasks/good": task(status="", size="12 days", hot="false", area="[[home|x]]", people=["[[Ann]]", " ", "[[People/Ann]]", "Bob"]),
        "Tasks/kinds": task(size=[3], hot="True", tags="solo", status="opne", odd=1),
        "Tasks/links": task(area="[[Ann]]", people=["[[Ann]]", "[[Nobody]]", "[[Areas/Home]]"]),
        "Tasks/many": task(area="[[Twin]]"), "Tasks/path": task(area="[[Areas/b/Twin]]"),
        "Tasks/undated": {"type": "task", "due": " "}, "Tasks/gone": {"type": "task"}})
    got = {r.path: r for r in validate_rows(notes, schema).collect()}
    said = {p: sorted((x.code, x.field, x.value) for x in r.problems) for p, r in got.items()}
    assert got["Tasks/good"].valid and said["Tasks/good"] == [] and said["Tasks/path"] == [] and said["Areas/Home"] == []
    assert said["Tasks/kinds"] == [("invalid_option_value", "status", "opne"), ("invalid_type", "hot", "True"), ("invalid_type", "size", "[3]"),
                                   ("invalid_type", "tags", "solo"), ("unknown_field", "odd", "1")]
    assert (got["Tasks/kinds"].errors, got["Tasks/kinds"].warnings, got["Tasks/kinds"].valid) == (4, 1, False)
    assert said["Tasks/links"] == [("invalid_context_source", "area", "[[Ann]]"), ("invalid_context_source", "people", "[[Areas/Home]]"),
                                   ("invalid_context_source", "people", "[[Nobody]]")]
    assert said["Tasks/many"] == [("invalid_context_source", "area", "[[Twin]]")]
    assert said["Tasks/undated"] == [("required_field_missing", "due", " ")] and said["Tasks/gone"] == [("required_field_missing", "due", None)]
