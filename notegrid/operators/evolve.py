"""Schema evolution: diff two compiled schemas, classify, and migrate headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions import links as L
from notegrid.operators import headers as E
from notegrid.operators.fields import shape_of
from notegrid.types import TypeSchema

ASPECTS = ["kind", "options", "source_types", "required", "multiple", "default", "granularity"]


def diff_types(old: DataFrame, new: DataFrame) -> DataFrame:
    """(type, change, from_parent, to_parent) between two types tables."""
    a = old.select("type", F.col("parent").alias("from_parent"), F.lit(True).alias("in_old"))
    b = new.select("type", F.col("parent").alias("to_parent"), F.lit(True).alias("in_new"))
    both = a.join(b, "type", "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed") \
        .when(~F.col("from_parent").eqNullSafe(F.col("to_parent")), "reparented")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(
        "type", "change", "from_parent", "to_parent")


def diff_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    """(type, field, change, aspects) over effective fields of types in both schemas."""
    shared = old.select("type").distinct().intersect(new.select("type").distinct())
    side = lambda df, tag: df.join(shared, "type", "left_semi").select(
        "type", "field", F.struct(*ASPECTS, "static_value").alias(tag))
    both = side(old, "a").join(side(new, "b"), ["type", "field"], "full_outer")
    aspects = F.array_compact(F.array(*[
        F.when(~F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")), x) for x in ASPECTS]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed") \
        .when(F.size(aspects) > 0, "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").withColumn(
        "aspects", F.when(F.col("change") == "changed", aspects))


def classify_changes(types: DataFrame, fields: DataFrame) -> DataFrame:
    """(type, field, op, safe, detail): one row per migration operation."""
    a, b = F.col("a"), F.col("b")
    has = lambda x: F.coalesce(F.array_contains("aspects", x), F.lit(False))
    op = lambda name, safe, detail=F.lit(None): F.struct(
        F.lit(name).alias("op"), F.lit(safe).alias("safe"), detail.cast("string").alias("detail"))
    old_n, new_n = F.size(a["options"]), F.size(b["options"])
    removed = F.array_except(a["options"], b["options"])
    allowed = F.array_join(b["options"], ", ")
    exposed = lambda s: s["required"] & s["default"].isNull()
    ops = F.array_compact(F.array(
        F.when(F.col("change") == "added", op("add-field", True, F.coalesce(b["default"], b["static_value"]))),
        F.when(F.col("change") == "removed", op("remove-field", False)),
        F.when(has("options") & (new_n > 0) & ((old_n == 0) | (F.size(removed) > 0)),
               op("clear-invalid-options", False, allowed)),
        F.when(has("options") & (new_n == 0) & (F.size(removed) > 0),
               op("review-field", False, F.lit("options removed"))),
        F.when(has("multiple") & b["multiple"], op("widen-to-multiple", True)),
        F.when(has("multiple") & ~b["multiple"], op("review-field", False, F.lit("no longer multiple"))),
        F.when((has("required") | has("default")) & exposed(b) & ~exposed(a),
               op("review-field", False, F.lit("required without default"))),
        F.when(has("source_types") & (F.size(F.array_except(a["source_types"], b["source_types"])) > 0),
               op("review-field", False, F.lit("source narrowed"))),
        F.when(has("kind"), op("review-field", False, F.lit("kind changed"))),
        F.when(has("granularity"), op("review-field", False, F.lit("granularity changed")))))
    field_ops = fields.select("type", "field", F.explode(ops).alias("o")).select("type", "field", "o.*")
    type_ops = types.select("type", F.lit(None).cast("string").alias("field"),
                            F.concat(F.when(F.col("change") == "added", "add")
                                     .when(F.col("change") == "removed", "remove").otherwise("reparent"),
                                     F.lit("-type")).alias("op"),
                            (F.col("change") == "added").alias("safe"),
                            F.lit(None).cast("string").alias("detail"))
    return field_ops.unionByName(type_ops)


def suggest_version(ops: DataFrame, current: str) -> DataFrame:
    major, minor, *_ = (int(x) for x in current.split("."))
    return ops.agg(F.count_if(~F.col("safe")).alias("review"), F.count_if("safe").alias("safe")).select(
        "review", "safe", F.when(F.col("review") > 0, f"{major + 1}.0.0")
        .when(F.col("safe") > 0, f"{major}.{minor + 1}.0").otherwise(current).alias("version"))


# ---------------------------------------------------------------- header migrations
# Each step is a fold step of ``headers``; ``of_type`` limits one to a type.

def of_type(type_name: str, step):
    def limited(h: Column, seq: int):
        made, after = step(h, seq)
        return F.when(F.col("type") == type_name, made), after
    return limited


def migrate_add(field: str, default_json: str):
    def step(h: Column, seq: int):
        gone = ~F.array_contains(F.map_keys(h), field)
        none = F.lit(None).cast("string")
        return (F.when(gone, E.change(seq, "add-field", F.lit(field), none, F.lit(default_json))),
                E.put(h, F.lit(field), F.parse_json(F.lit(default_json))))
    return step


def migrate_remove(field: str):
    def step(h: Column, seq: int):
        return (F.when(F.array_contains(F.map_keys(h), field), E.change(
            seq, "remove-field", F.lit(field), E.value_json(h, field), None)), E.drop(h, F.lit(field)))
    return step


def migrate_rename(field: str, new_field: str):
    def step(h: Column, seq: int):
        keys, old = F.map_keys(h), E.value_json(h, field)
        can = F.array_contains(keys, field) & ~F.array_contains(keys, new_field)
        return (F.when(can, E.change(seq, "rename-field", F.lit(field), old, old, F.lit(new_field))),
                E.put(E.drop(h, F.lit(field)), F.lit(new_field), F.try_element_at(h, F.lit(field))))
    return step


def migrate_options(field: str, allowed: list[str]):
    """Scalars outside the options are removed, lists lose the items outside them."""
    def step(h: Column, seq: int):
        v = F.try_element_at(h, F.lit(field))
        old, shape = F.to_json(v), shape_of(v)
        items = v.try_cast("array<variant>")
        kept = F.filter(items, lambda x: F.coalesce(x.try_cast("string").isin(allowed), F.lit(False)))
        listed = (shape == "list") & (F.size(kept) < F.size(items))
        text = v.try_cast("string")
        scalar = shape.isin("string", "number", "boolean") & (text != "") & ~text.isin(allowed)
        made = F.when(listed, E.change(seq, "clear-invalid-options", F.lit(field), old, F.to_json(kept))) \
            .when(scalar, E.change(seq, "clear-invalid-options", F.lit(field), old, None))
        after = F.when(F.coalesce(listed, F.lit(False)), E.put(h, F.lit(field), F.parse_json(F.to_json(kept)))) \
            .otherwise(E.drop(h, F.lit(field)))
        return made, after
    return step


def migrate_widen(field: str):
    def step(h: Column, seq: int):
        v = F.try_element_at(h, F.lit(field))
        shape, old = shape_of(v), F.to_json(v)
        can = v.isNotNull() & ~shape.isin("null", "list") & (old != '""')
        new = F.concat(F.lit("["), old, F.lit("]"))
        return (F.when(can, E.change(seq, "widen-to-multiple", F.lit(field), old, new)),
                E.put(h, F.lit(field), F.parse_json(new)))
    return step


def migrate_links(field: str, style: str):
    """Relation values, scalar or list, in the chosen link format."""
    def step(h: Column, seq: int):
        v = F.try_element_at(h, F.lit(field))
        shape, old = shape_of(v), F.to_json(v)
        one = lambda t: E.json_text(L.link_format(t, style))
        items = F.transform(v.try_cast("array<variant>"), lambda x: F.when(
            shape_of(x) == "string", one(x.try_cast("string"))).otherwise(F.to_json(x)))
        text = v.try_cast("string")
        new = F.when(shape == "list", F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))) \
            .when((shape == "string") & (F.trim(text) != ""), one(text)).otherwise(old)
        return (F.when(F.coalesce(new != old, F.lit(False)), E.change(
            seq, "normalize-links", F.lit(field), old, new)), E.put(h, F.lit(field), F.parse_json(new)))
    return step


def migrate(notes: DataFrame, steps) -> DataFrame:
    return E.changes_of(E.fold(notes, steps))


def migrate_apply(notes: DataFrame, steps) -> DataFrame:
    return E.applied(E.fold(notes, steps))


def migrate_preview(changes: DataFrame, cap: int = 200) -> DataFrame:
    """Before and after of the first changed notes, in path order."""
    return changes.orderBy("path", "seq").limit(cap)


def migrate_blocker(changes: DataFrame, notes: DataFrame, schema: TypeSchema) -> DataFrame:
    """Planned changes that would empty a required field without default; these stop a run."""
    spark = notes.sparkSession
    required = F.broadcast(spark.createDataFrame(
        [(t, f) for t, fs in schema.fields.items() for f, d in fs.items()
         if d.get("required") and d.get("default") is None], "type string, field string"))
    empties = changes.filter(F.col("new").isNull() | F.col("new").isin("null", '""', "[]") |
                             F.col("new_field").isNotNull())
    return empties.join(notes.select("path", "type"), "path").join(required, ["type", "field"], "left_semi")


def migration_log(ops: DataFrame, from_version: str, to_version: str, folder: str) -> DataFrame:
    """Append the applied operations to the log table and return what was written."""
    rows = ops.select("*", F.lit(from_version).alias("from_version"), F.lit(to_version).alias("to_version"))
    rows.write.mode("append").parquet(folder)
    return rows
