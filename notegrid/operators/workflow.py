"""Workflow rules over change tables: transitions, guards, effects, successors, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notegrid.functions.dates import add_offset, partial_date
from notegrid.operators.naming import free_names
from notegrid.session import settle


def previous_values(log: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """Adds ``before``: the value the same key had just before, null first.

    A segmented scan: the log is range-partitioned by key and time, so a key that owns a large share
    of it lies in many pieces, whatever stretch of time it falls into. Inside a piece a window finds
    the predecessor; the first row of a key in a piece takes the last value of the key's piece
    before, from a table of one row per key and piece.
    """
    order = [F.col(key), F.col(time), F.col(tie)]
    rows = settle(log.repartitionByRange(*order).withColumn("piece_", F.spark_partition_id()))
    inner = W.partitionBy("piece_", key).orderBy(time, tie)
    rows = rows.withColumn("n_", F.row_number().over(inner)).withColumn("in_", F.lag(value).over(inner))
    last = rows.groupBy(key, "piece_").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(time, tie)).alias("last_"))
    chain = last.withColumn("carry_", F.lag("last_").over(W.partitionBy(key).orderBy("piece_"))) \
        .filter("carry_ IS NOT NULL").select(F.col(key).alias("key_"), "piece_", F.col("carry_.v").alias("carry_"), F.lit(1).alias("n_"))
    joined = rows.join(chain, rows[key].eqNullSafe(chain["key_"]) & (rows["piece_"] == chain["piece_"]) & (rows["n_"] == chain["n_"]), "left") \
        .select(*[rows[c] for c in log.columns], rows["n_"], rows["in_"], "carry_")
    before = F.when(F.col("n_") == 1, F.col("carry_")).otherwise(F.col("in_"))
    return joined.withColumn("before", before).drop("n_", "in_", "carry_")


def transitions(log: DataFrame, key: str, time: str, tie: str, value: str, entered: str) -> DataFrame:
    """Log rows at which the watched field enters a value (text compare)."""
    known = previous_values(log, key, time, tie, value)
    return known.filter((F.col(value) == entered) & ~F.col("before").eqNullSafe(F.lit(entered)))


def guard_check(subjects: DataFrame, links: DataFrame, notes: DataFrame, satisfied: Column,
                failed: Column | None = None, stale: Column | None = None,
                minimum: int = 1) -> DataFrame:
    """Status of one requirement per subject: satisfied, failed, stale, unresolved or missing.

    ``links`` are resolved (src_path, resolved_path, resolution). Each note's status is worked
    out once; per subject only counts are kept.
    """
    no = F.lit(False)
    state = F.when(F.coalesce(no if stale is None else stale, no), "stale") \
        .when(F.coalesce(no if failed is None else failed, no), "failed") \
        .when(F.coalesce(satisfied, no), "satisfied").otherwise("failed")
    judged = links.join(notes.select(F.col("path").alias("resolved_path"), state.alias("state")),
                        "resolved_path", "left").withColumn(
        "state", F.when(F.col("resolution") == "unique", F.coalesce("state", F.lit("unresolved")))
        .otherwise("unresolved"))
    per = judged.groupBy(F.col("src_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n_targets"),
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("unresolved", "stale", "failed", "satisfied")])
    zero = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(zero("n_targets") < minimum, "missing").when(zero("n_unresolved") > 0, "unresolved") \
        .when(zero("n_stale") > 0, "stale").when(zero("n_failed") > 0, "failed").otherwise("satisfied")
    return subjects.select("path").distinct().join(per, "path", "left").select(
        "path", zero("n_targets").alias("n_targets"), zero("n_satisfied").alias("n_satisfied"),
        status.alias("status"), (status != "satisfied").alias("blocked"))


def effect_patches(entered: DataFrame, links: DataFrame, assignments: dict[str, str],
                   now: str, today: str, actor: str) -> DataFrame:
    """(path, target, error, field, value): assignments for the single linked note of each
    transition, or why there is none."""
    per = links.groupBy(F.col("src_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("resolution") == "unique").alias("good"),
        F.min("resolved_path").alias("target"))
    joined = entered.select("path").distinct().join(per, "path")
    error = F.when(F.col("n") > 1, "several-targets").when(F.col("good") == 0, "unresolved") \
        .when(F.col("target") == F.col("path"), "self")
    words = {"$NOW": now, "$TODAY": today, "$ACTOR": actor}
    sets = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(words.get(v, v)).alias("value"))
                     for k, v in assignments.items()])
    ok = joined.withColumn("error", error).withColumn("s", F.explode(F.when(
        F.col("error").isNull(), sets).otherwise(F.slice(sets, 1, 1))))
    return ok.select("path", F.when(F.col("error").isNull(), F.col("target")).alias("target"), "error",
                     F.when(F.col("error").isNull(), F.col("s.field")).alias("field"),
                     F.when(F.col("error").isNull(), F.col("s.value")).alias("value"))


def recurrence_issues(notes: DataFrame, trigger_field: str, trigger_value: str,
                      base: str, date_ok: Column | None = None) -> DataFrame:
    """(path, code): done notes without successor, and ones whose base date cannot be used."""
    due = notes.filter(F.col(trigger_field) == trigger_value).filter(
        F.coalesce(F.trim("next"), F.lit("")) == "")
    full = F.coalesce(partial_date(F.col(base))["precision"] == "day", F.lit(False))
    if date_ok is not None:
        full = full & date_ok
    return due.select("path", F.explode(F.array_compact(F.array(
        F.when(full, F.lit("missing-successor")), F.when(~full, F.lit("invalid-recurrence")))))
        .alias("code"))


def spawn_successors(due: DataFrame, notes: DataFrame, name: Column, base: str, amount: int, unit: str,
                     trigger_field: str, reset: str | None) -> DataFrame:
    """New notes for finished recurring ones: name with a free number, shifted date, reset
    trigger, ``prev``; and ``next_link`` for the old note. Unusable base dates are errors.
    """
    first = partial_date(F.col(base))
    day = F.when(first["precision"] == "day", first["first_day"])
    wanted = due.select("path", F.col("name").alias("old_name"), name.alias("want"),
                        F.date_format(add_offset(day, F.lit(amount), F.lit(unit)), "yyyy-MM-dd").alias("date"),
                        day.isNull().alias("bad"))
    named = free_names(wanted.filter("NOT bad").drop("bad"), notes, ["path"])
    ok = named.select("path", F.col("free_name").alias("name"), F.col("date").alias(base),
                      F.lit(reset).alias(trigger_field),
                      F.concat(F.lit("[["), "old_name", F.lit("]]")).alias("prev"),
                      F.concat(F.lit("[["), "free_name", F.lit("]]")).alias("next_link"),
                      F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    bad = wanted.filter("bad").select("path", none.alias("name"), none.alias(base), none.alias(trigger_field),
                                      none.alias("prev"), none.alias("next_link"),
                                      F.lit("base date missing or partial").alias("error"))
    return ok.unionByName(bad)


def retention_actions(due: DataFrame, action: str, references: DataFrame | None = None,
                      archive: str = "Archive", tombstone: dict[str, str] | None = None) -> DataFrame:
    """(path, action, detail): archive moves, tombstone assignments, or deletes of notes that
    nothing refers to. ``references(path)`` lists referred notes."""
    if action == "archive":
        return due.select("path", F.lit("archive").alias("action"), F.concat(
            F.lit(archive + "/"), F.element_at(F.split("path", "/"), -1)).alias("detail"))
    if action == "tombstone":
        sets = F.array(*[F.lit(f"{k}={v}") for k, v in (tombstone or {}).items()])
        return due.select("path", F.lit("tombstone").alias("action"), F.explode(sets).alias("detail"))
    if action != "delete":
        raise ValueError(f"unknown action: {action}")
    return due.join(references.select("path").distinct(), "path", "left_anti").select(
        "path", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("detail"))


def delete_plan(selected: DataFrame, links: DataFrame, guard: DataFrame) -> DataFrame:
    """Selected rows with how many other notes link to them and their lineage block.

    Link text is compared ignoring case with the name and the path of each row. Sources are counted
    per text and joined as counts, so links to a name that many rows share multiply nothing; only
    links that spell a path are looked at one by one, for sources that also use the name.
    """
    text = F.lower(F.regexp_extract("raw", r"^\[\[([^|#\]]+)", 1))
    used = links.select("src_path", text.alias("key")).filter("key <> ''").distinct()
    rows = selected.select("path", F.lower("name").alias("by_name"), F.lower("path").alias("by_path"))
    per_key = used.groupBy(F.col("key").alias("by_name")).agg(F.count(F.lit(1)).alias("n_name"))
    itself = used.select(F.col("src_path").alias("path"), F.col("key").alias("by_name"), F.lit(1).alias("itself"))
    named = used.select("src_path", F.col("key").alias("by_name"))
    spelt = rows.filter("by_name <> by_path").join(used, F.col("by_path") == F.col("key")).filter("src_path <> path") \
        .join(named, ["src_path", "by_name"], "left_anti").groupBy("path").agg(F.count(F.lit(1)).alias("n_path"))
    n = F.coalesce("n_name", F.lit(0)) - F.coalesce("itself", F.lit(0)) + F.coalesce("n_path", F.lit(0))
    return rows.join(per_key, "by_name", "left").join(itself, ["path", "by_name"], "left").join(spelt, "path", "left") \
        .join(guard.select("path", "block"), "path", "left").select("path", n.cast("bigint").alias("n_sources"), "block")
