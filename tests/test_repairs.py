"""Repairs and edits on values that used to be corrupted by them."""

import json

import pytest
from pyspark.sql import functions as F

from notegrid.operators import bulk as B
from notegrid.operators import derive as D
from notegrid.operators import headers as E
from notegrid.operators import mentions as M
from notegrid.operators import repair as X
from notegrid.operators import rules as Q
from notegrid.operators.fork import fork_rows
from notegrid.sources.notes import dedupe_paths
from notegrid.types import compile_types

SCHEMA = compile_types({"types": {
    "album": {"output_dir": "A", "fields": {"songs": {"kind": "relation", "source": ["song"], "multiple": True, "owned": True}}},
    "song": {"output_dir": "B", "fields": {
        "tags": {"kind": "list", "required": True, "default": ["x, y", "z"]}, "plays": {"kind": "number", "required": True, "default": 3},
        "days": {"kind": "date", "multiple": True}, "refs": {"kind": "list"}, "near": {"kind": "relation", "source": ["song"]}}}}})


def heads(df):
    return {r["path"]: json.loads(r["j"]) for r in df.select("path", F.to_json("fm").alias("j")).collect()}


FULL = {"tags": ["t"], "plays": 1}


def test_notes_with_their_owner_are_in_place(notes_of):
    notes = notes_of({"A/X/X": {"type": "album"}, "A/X/songs/S": {"type": "song", **FULL}, "A/X/other/T": {"type": "song", **FULL},
                      "A/X/songs/Y": {"type": "album"}, "B/U": {"type": "song", **FULL}, "C/songs/V": {"type": "song", **FULL}})
    wrong = {r["path"] for r in Q.note_issues(notes, SCHEMA, "2024-01-01", ["wrong-directory"]).collect()}
    assert wrong == {"A/X/other/T", "C/songs/V"}
    assert {r["path"]: r["new_path"] for r in X.fix_location(notes, SCHEMA).collect()} == {"A/X/other/T": "B/T", "C/songs/V": "B/V"}


def test_defaults_keep_their_form(notes_of):
    notes = notes_of({"B/s": {"type": "song", "tags": [], "plays": ""}})
    assert heads(E.apply_changes(notes, X.repair_fields(notes, SCHEMA))) == {"B/s": {"type": "song", "tags": ["x, y", "z"], "plays": 3}}
    got = {r["field"]: r["value"] for r in D.apply_defaults(notes, SCHEMA, "2024-01-01").collect()}
    assert got == {"tags": '["x, y", "z"]', "plays": "3"}


def test_copies_of_quoted_names_and_typed_defaults(notes_of):
    notes = notes_of({'B/say "hi"': {"type": "song", "id": 'i"d'}})
    row = fork_rows(notes, SCHEMA).select("path", F.to_json("fm").alias("j")).first()
    head = json.loads(row["j"])
    assert head["name"] == 'say "hi" copy' and head["forked-from"] == 'i"d' and head["tags"] == ["x, y", "z"] and head["plays"] == 3


def test_links_are_mended_where_the_rule_says_so(notes_of):
    notes = notes_of({"B/s": {"type": "song", **FULL, "near": " [[Z]", "refs": ["[[A]", "[B]]", "plain", "[[C]]"]}})
    fixed = E.apply_changes(notes, X.repair_fields(notes, SCHEMA))
    head = heads(fixed)["B/s"]
    assert head["near"].strip() == "[[Z]]" and head["refs"] == ["[[A]]", "[[B]]", "plain", "[[C]]"]
    assert Q.field_issues(fixed, SCHEMA).filter("code = 'malformed-wikilink'").count() == 0


def test_numbers_in_date_lists_become_text(notes_of):
    notes = notes_of({"B/s": {"type": "song", **FULL, "days": [2024, "2024-05-01"]}})
    assert heads(E.apply_changes(notes, X.repair_fields(notes, SCHEMA)))["B/s"]["days"] == ["2024", "2024-05-01"]


@pytest.mark.parametrize("text", ["nan", "inf", "1_000", "1e5", "٣"])
def test_words_that_only_look_like_numbers_stay_text(text):
    assert B.literal(text) == text


def test_mentions_keep_the_text_as_written(spark):
    names = spark.createDataFrame([("F/Émile Zola", "Émile Zola"), ("F/¡Hola!", "¡Hola!")], "path string, name string")
    notes = spark.createDataFrame([("F/x", "x", "F", "note", "Read Émile Zola today.")], "path string, name string, folder string, type string, body string")
    assert [r["text"] for r in M.mentions(notes, M.surfaces(names, None)).collect()] == ["Émile Zola"]


def test_paths_are_folded(spark):
    paths = ["a/b", "a/./b", "./a/b", "a/c/../b", "a//b", "x", "a/././b", "y/../x"]
    got = dedupe_paths(spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, n int")).collect()
    assert sorted(r["path"] for r in got) == ["./a/b", "x"]


def test_long_digit_runs_sort_by_value(spark):
    from notegrid.functions.values import natural_key
    runs = ["n9", "n10", "n" + "9" * 99, "n1" + "0" * 99, "n1" + "0" * 120, "n2" + "0" * 120]
    df = spark.createDataFrame([(r,) for r in reversed(runs)], "t string")
    assert [r["t"] for r in df.orderBy(natural_key(F.col("t"))).collect()] == runs


def test_moves_in_repairs_do_not_collide(spark):
    rows = [("A/x:", "x:", "A", "t"), ("A/x", "x", "A", "t"), ("A/y:", "y:", "A", "t"), ("A/y?", "y?", "A", "t"), ("B/z", "z", "B", "t")]
    notes = spark.createDataFrame(rows, "path string, name string, folder string, type string")
    named = {r["path"]: r["error"] for r in X.fix_name(notes).collect()}
    assert named["A/x:"] == "destination exists" and set(named) == {"A/x:", "A/y:", "A/y?"}
    schema = compile_types({"types": {"t": {"output_dir": "C"}}})
    placed = {r["path"]: (r["new_path"], r["error"]) for r in X.fix_location(notes, schema, notes.select(
        F.regexp_replace("path", "^B/", "C/").alias("path"))).collect()}
    assert placed["B/z"] == ("C/z", "destination exists") and placed["A/x"] == ("C/x", None)


def test_only_the_target_of_a_stale_link_changes(spark):
    stale = spark.createDataFrame([("s", "f", raw, "Jon") for raw in ["[[Jon#Jon|Jon said]]", "[Jon](Jon.md)", '"[[ Jon ]]"', "Jon"]],
                                  "src_path string, field string, raw string, target string")
    close = spark.createDataFrame([("Jon", "John", 1)], "query string, name string, distance int")
    assert sorted(r["new_raw"] for r in X.fix_stale_link(stale, close).collect()) == sorted(
        ["[[John#Jon|Jon said]]", "[Jon](John.md)", '"[[ John ]]"', "John"])


def test_adoption_fills_values_of_every_kind(spark, notes_of):
    schema = compile_types({"types": {"t": {"output_dir": "T", "fields": {
        "n": {"kind": "number", "required": True, "default": 3}, "b": {"kind": "boolean", "value": False},
        "l": {"kind": "list", "required": True, "default": ["a", 1]}, "free": {"kind": "text", "default": "no"},
        "day": {"kind": "date", "value": "$TODAY"}, "q": {"kind": "text", "value": 'say "é"'}}}}})
    notes = spark.createDataFrame([("T/a", None, "T", "t")], "path string, type string, folder string, directory_type string") \
        .withColumn("fm", F.parse_json(F.lit('{"n": 1}')))
    assert {r["field"]: r["new"] for r in X.fix_adopt(notes, schema).collect()} == {
        "type": '"t"', "b": "false", "l": '["a", 1]', "q": '"say \\"é\\""'}


def test_blanks_go_beside_block_scalars(spark):
    raw = "---\ntype: t  \nnote: |  \n  kept  \n\n  too\t\nlast: x\t\n---\nbody  \n"
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(X.fix_whitespace(F.col("raw")).alias("r")).first()["r"] == \
        "---\ntype: t\nnote: |\n  kept  \n\n  too\t\nlast: x\n---\nbody  \n"


def test_unknown_fields_are_ranked_by_kind_shape_and_edits(spark, notes_of):
    schema = compile_types({"types": {"t": {"output_dir": "T", "fields": {
        "due-date": {"kind": "date"}, "count": {"kind": "number"}, "counts": {"kind": "list"}, "member": {"kind": "text"},
        "members": {"kind": "relation", "source": ["t"], "multiple": True}, "status-type": {"kind": "text"}}}}})
    notes = notes_of({"T/a": {"type": "t", "Due Date": "2024-01-01", "coun": 3, "membr": "x", "Count_s": 5, "zzz": 1, "--": 1},
                      "T/b": {"type": "t", "Due Date": "x", "due-date": "y", "due_dat": "z"},
                      "T/c": {"type": "t", "due_date": 7}})
    got = {(r["path"], r["field"]): (r["expected"], r["auto_fixable"]) for r in Q.field_issues(notes, schema, ["unknown-field"]).collect()}
    assert got == {
        ("T/a", "Due Date"): ("due-date", True), ("T/a", "coun"): ("count", False), ("T/a", "membr"): ("member", False),
        ("T/a", "Count_s"): ("counts, count", False), ("T/a", "zzz"): (None, False), ("T/a", "--"): (None, False),
        ("T/b", "Due Date"): ("due-date", False), ("T/b", "due_dat"): ("due-date", False), ("T/c", "due_date"): ("due-date", False)}
    moved = {(r["path"], r["field"]): r["new_field"] for r in X.repair_fields(notes, schema, ["fix_key"]).collect()}
    assert moved == {("T/a", "Due Date"): "due-date"}


def test_repairs_are_columns_and_the_first_names_the_change(spark, notes_of):
    schema = compile_types({"types": {"t": {"output_dir": "T", "fields": {
        "b": {"kind": "boolean"}, "n": {"kind": "number"}, "s": {"kind": "select", "options": ["Open", "Done"], "required": True, "default": "Open"}}}}})
    notes = notes_of({"T/a": {"type": "t", "b": "True", "n": "7", "s": "open"}, "T/b": {"type": "t", "B": True, "s": ""}, "T/c": {"type": "t", "n": 1, "s": "Done"}})
    changes = X.repair_fields(notes, schema)
    assert sorted((r["path"], r["operation"], r["field"], r["old"], r["new"], r["new_field"]) for r in changes.collect()) == [
        ("T/a", "fix_boolean", "b", '"True"', "true", None), ("T/a", "fix_enum_case", "s", '"open"', '"Open"', None),
        ("T/a", "fix_scalar", "n", '"7"', "7", None), ("T/b", "fix_default", "s", '""', '"Open"', None),
        ("T/b", "fix_key", "B", "true", "true", "b")]
    assert X.repair_fields(notes, schema, ["fix_key"]).count() == 1 and X.repair_fields(notes, schema, []).count() == 0
    # The generator gets a finished column: what stands inside it would be interpreted.
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(made" in plan
