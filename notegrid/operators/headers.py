"""Edits of dynamic headers, expressed as change tables.

changes: path, seq, operation, field, old, new, new_field; values are JSON text, null means the
key is absent. Edits of one note are folded inside its row, so planning a bulk edit never shuffles;
applying a change table costs one join on the note path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.session import spread

HELD = "map<string,variant>"
CHANGE = ("struct<seq int, operation string, field string, old string, new string, "
          "new_field string>")


def held(fm: Column) -> Column:
    """Header as a map, empty when there is none."""
    return F.coalesce(fm.try_cast(HELD), F.from_json(F.lit("{}"), HELD))


def json_text(c: Column) -> Column:
    """JSON literal of a text value."""
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def value_json(h: Column, key: str) -> Column:
    return F.to_json(F.try_element_at(h, F.lit(key)))


def put(h: Column, key: Column, value: Column) -> Column:
    rest = F.map_filter(h, lambda k, v: k != key)
    return F.map_concat(rest, F.create_map(key, value))


def drop(h: Column, key: Column) -> Column:
    return F.map_filter(h, lambda k, v: k != key)


def change(seq: int, operation: str, field: Column, old: Column, new: Column | None,
           new_field: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(seq).alias("seq"), F.lit(operation).alias("operation"),
                    field.cast("string").alias("field"), old.alias("old"),
                    (none if new is None else new).alias("new"),
                    (none if new_field is None else new_field).alias("new_field"))


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def fold(notes: DataFrame, steps) -> DataFrame:
    """Run edit steps over each header. A step maps (header, seq) to (change or null, header);
    every step sees the result of the one before. Adds ``h`` and ``done``.

    The running state is bound by name at each step, so the expression grows with the number of
    steps and not with its powers.
    """
    def run(step, seq: int):
        def on_state(s: Column) -> Column:
            made, after = step(s["h"], seq)
            return let(made, lambda c: F.struct(
                F.when(c.isNotNull(), after).otherwise(s["h"]).alias("h"),
                F.concat(s["done"], F.array_compact(F.array(c))).alias("done")))
        return on_state

    state = F.struct(held(F.col("fm")).alias("h"), F.array().cast(f"array<{CHANGE}>").alias("done"))
    for seq, step in enumerate(steps):
        state = let(state, run(step, seq))
    df = spread(notes).withColumn("state", state)
    return df.withColumn("h", F.col("state.h")).withColumn("done", F.col("state.done")).drop("state")


def changes_of(folded: DataFrame) -> DataFrame:
    # No test for emptiness before the explode: it would run every step a second time.
    return folded.select("path", F.explode("done").alias("c")).select("path", "c.*")


def applied(folded: DataFrame) -> DataFrame:
    keep = [c for c in folded.columns if c not in ("h", "done", "fm")]
    return folded.select(*keep, F.to_variant_object("h").alias("fm"))


def apply_changes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes with a change table applied; a note's changes are few and are replayed in order."""
    per_note = changes.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(
        "seq", "operation", "field", "old", "new", "new_field"))).alias("todo"))
    joined = notes.join(per_note, "path", "left")

    def step(h: Column, c: Column) -> Column:
        target = F.coalesce(c["new_field"], c["field"])
        cleared = F.map_filter(h, lambda k, v: (k != c["field"]) & (k != target))
        return F.when(c["new"].isNull(), drop(h, c["field"])).otherwise(
            F.map_concat(cleared, F.create_map(target, F.parse_json(c["new"]))))

    replayed = F.aggregate("todo", held(F.col("fm")), step)
    keep = [c for c in notes.columns if c != "fm"]
    return joined.select(*keep, F.when(F.col("todo").isNull(), F.col("fm"))
                         .otherwise(F.to_variant_object(replayed)).alias("fm"))
