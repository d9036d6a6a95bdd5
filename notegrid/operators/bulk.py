"""Bulk edits: operations over many headers, planned as changes and applied in the same pass."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.operators import headers as E
from notegrid.operators.fields import shape_of
from notegrid.operators.naming import side_by_side


def literal(text: str):
    """Command text as a value: true/false, a number, other text; empty text clears."""
    if text == "":
        return None
    if text in ("true", "false"):
        return text == "true"
    if not re.fullmatch(r"-?\d+(\.\d+)?", text, re.ASCII):
        return text
    number = float(text)
    return int(text.partition(".")[0]) if "." not in text or number.is_integer() else number


def _value(value) -> tuple[Column, Column]:
    body = json.dumps(value)
    return F.parse_json(F.lit(body)), F.lit(body)


def _parts(h: Column, field: str):
    v = F.try_element_at(h, F.lit(field))
    return v, F.to_json(v), F.array_contains(F.map_keys(h), field)


def bulk_set(field: str, value):
    if value is None:
        return bulk_clear(field)
    parsed, body = _value(value)

    def step(h: Column, seq: int):
        _, old, _ = _parts(h, field)
        made = F.when(~F.coalesce(old == body, F.lit(False)), E.change(seq, "set", F.lit(field), old, body))
        return made, E.put(h, F.lit(field), parsed)
    return step


def _remove_key(operation: str, field: str):
    def step(h: Column, seq: int):
        _, old, present = _parts(h, field)
        return F.when(present, E.change(seq, operation, F.lit(field), old, None)), E.drop(h, F.lit(field))
    return step


def bulk_clear(field: str):
    return _remove_key("clear", field)


def bulk_delete(field: str):
    return _remove_key("delete", field)


def bulk_rename(field: str, new_field: str):
    """Move a value to a new key; a note that already has the new key stops the run."""
    def step(h: Column, seq: int):
        v, old, present = _parts(h, field)
        taken = F.array_contains(F.map_keys(h), new_field)
        stop = F.raise_error(F.lit(f"cannot rename '{field}' to '{new_field}': it already exists"))
        made = F.when(present & taken, stop.cast(E.CHANGE)).when(
            present, E.change(seq, "rename", F.lit(field), old, old, F.lit(new_field)))
        return made, E.put(E.drop(h, F.lit(field)), F.lit(new_field), v)
    return step


def rename_conflicts(notes: DataFrame, field: str, new_field: str) -> DataFrame:
    keys = F.map_keys(E.held(F.col("fm")))
    return notes.filter(F.array_contains(keys, field) & F.array_contains(keys, new_field)).select("path")


def bulk_append(field: str, value):
    parsed, body = _value(value)

    def step(h: Column, seq: int):
        v, old, _ = _parts(h, field)
        shape = F.coalesce(shape_of(v), F.lit("null"))
        items = v.try_cast("array<variant>")
        inside = F.exists(items, lambda x: F.to_json(x) == body)
        after = F.when(shape == "list", F.concat(items, F.array(parsed))) \
            .when(shape == "null", F.array(parsed)).otherwise(F.array(v, parsed))
        same = F.when(shape == "list", inside).otherwise((shape != "null") & (old == body))
        made = F.when(~F.coalesce(same, F.lit(False)), E.change(
            seq, "append", F.lit(field), old, F.to_json(after)))
        return made, E.put(h, F.lit(field), F.parse_json(F.to_json(after)))
    return step


def bulk_remove(field: str, value):
    _, body = _value(value)

    def step(h: Column, seq: int):
        v, old, _ = _parts(h, field)
        is_list = F.coalesce(shape_of(v) == "list", F.lit(False))
        items = v.try_cast("array<variant>")
        kept = F.filter(items, lambda x: ~F.coalesce(F.to_json(x) == body, F.lit(False)))
        gone = is_list & (F.size(kept) < F.size(items))
        alone = ~is_list & F.coalesce(old == body, F.lit(False))
        after = F.to_json(kept)
        made = F.when(gone, E.change(seq, "remove", F.lit(field), old, after)) \
            .when(alone, E.change(seq, "remove", F.lit(field), old, None))
        return made, F.when(gone, E.put(h, F.lit(field), F.parse_json(after))) \
            .otherwise(E.drop(h, F.lit(field)))
    return step


def bulk(notes: DataFrame, steps) -> DataFrame:
    """Planned changes of a chain of operations."""
    return E.changes_of(E.fold(notes, steps))


def bulk_apply(notes: DataFrame, steps) -> DataFrame:
    """Notes after the chain, in one pass without a join."""
    return E.applied(E.fold(notes, steps))


def bulk_limit(changes: DataFrame, n: int) -> DataFrame:
    """Only the changes of the first n changed notes in path order."""
    first = changes.select("path").distinct().orderBy("path").limit(n)
    return changes.join(first, "path", "left_semi")


def bulk_summary(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    affected = changes.agg(F.count_distinct("path").alias("affected"),
                           F.count(F.lit(1)).alias("n_changes"))
    return side_by_side(candidates.agg(F.count(F.lit(1)).alias("matched")), affected)


def backup_rows(notes: DataFrame, changes: DataFrame, operation: str) -> DataFrame:
    """Copies of the rows about to change, with what is going to happen to them."""
    return notes.join(changes.select("path"), "path", "left_semi") \
        .withColumn("backup_of", F.lit(operation))


# ---------------------------------------------------------------- moves

def destinations(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """``asked`` (path, new_path, ...) with an error where the place is taken or, but for the first path, claimed twice."""
    claims = asked.groupBy("new_path").agg(F.count(F.lit(1)).alias("claims"),
                                           F.min("path").alias("first_path"))
    existing = notes.select(F.col("path").alias("new_path")).distinct().withColumn("taken", F.lit(True))
    return asked.join(claims, "new_path").join(existing, "new_path", "left").select(
        *asked.columns, F.when(F.col("taken"), "destination exists")
        .when((F.col("claims") > 1) & (F.col("path") != F.col("first_path")), "destination claimed twice")
        .alias("error"))


def bulk_move(notes: DataFrame, selected: DataFrame, folder: str) -> DataFrame:
    """(path, name, new_path, error): a taken or doubly claimed destination is skipped with an error."""
    target = F.concat(F.lit(folder + "/"), "name")
    return destinations(selected.select("path", "name", target.alias("new_path")).filter("path <> new_path"), notes)


def relink(links: DataFrame, moves: DataFrame, notes: DataFrame) -> DataFrame:
    """(src_path, field, raw, new_raw): links to moved notes rewritten, keeping heading and text.

    ``links`` are resolved. The new target is the bare name where it stays unique, else the path.
    """
    done = moves.filter("error IS NULL").select(F.col("path").alias("resolved_path"), "name", "new_path")
    after = notes.select("path", "name").join(
        moves.filter("error IS NULL").select("path", F.element_at(F.split("new_path", "/"), -1)
                                             .alias("new_name")), "path", "left") \
        .select(F.coalesce("new_name", "name").alias("last_name"))
    names = after.groupBy("last_name").agg(F.count(F.lit(1)).alias("same"))
    done = done.withColumn("last_name", F.element_at(F.split("new_path", "/"), -1)).join(names, "last_name")
    target = F.when(F.col("same") == 1, F.col("last_name")).otherwise(F.col("new_path"))
    rest = F.regexp_extract("raw", r"^\[\[[^|#\]]*([^\]]*)\]\]$", 1)
    new_raw = F.when(F.startswith("raw", F.lit("[[")), F.concat(F.lit("[["), target, rest, F.lit("]]"))) \
        .otherwise(F.concat(F.regexp_extract("raw", r"^(\[.+\]\()", 1), target, F.lit(".md)")))
    out = links.join(done, "resolved_path").withColumn("new_raw", new_raw)
    return out.filter("raw <> new_raw").select("src_path", "field", "raw", "new_raw")
