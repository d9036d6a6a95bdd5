"""The long field view of dynamic headers, and profiles over it.

``explode_fields`` turns each note's VARIANT header into one row per key with its value shape.
It is a generator without a shuffle; everything after it aggregates with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.session import spread
from notegrid.types import TypeSchema

# Fixed value: text that reads as a date, with or without month, day and time.
DATE_LIKE = r"^\d{4}(-\d{2}(-\d{2}(T[\d:.]+Z?)?)?)?$"


def shape_of(v: Column) -> Column:
    """string / number / boolean / list / object / null of a VARIANT value."""
    s = F.schema_of_variant(v)
    return F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean") \
        .when(s.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(s, F.lit("DECIMAL")), "number") \
        .when(F.startswith(s, F.lit("ARRAY")), "list").when(F.startswith(s, F.lit("OBJECT")), "object") \
        .when(s.isin("DATE", "TIMESTAMP", "TIMESTAMP_NTZ"), "string").otherwise("null")


def explode_fields(notes: DataFrame, *keep: str) -> DataFrame:
    """(path, type, key, v, shape, s, items) plus kept columns; ``s`` is the scalar as text."""
    fm = F.col("fm").try_cast("map<string,variant>")
    rows = notes.select("path", "type", *keep, F.explode(fm).alias("key", "v"))
    rows = rows.withColumn("shape", shape_of(F.col("v")))
    scalar = F.col("shape").isin("string", "number", "boolean")
    return rows.withColumn("s", F.when(scalar, F.col("v").try_cast("string"))) \
        .withColumn("items", F.when(F.col("shape") == "list", F.col("v").try_cast("array<variant>")))


def value_shape(shape: Column, s: Column, items: Column) -> Column:
    """Descriptive shape: text that reads as a date is a date, blank values are empty."""
    return F.when(shape == "null", "empty") \
        .when(shape == "string", F.when(F.trim(s) == "", "empty")
              .when(F.trim(s).rlike(DATE_LIKE), "date").otherwise("string")) \
        .when(shape == "list", F.when(F.size(items) == 0, "empty").otherwise("list")) \
        .otherwise(shape)


def classified(fields: DataFrame) -> DataFrame:
    return fields.select("path", "type", "key", value_shape(
        F.col("shape"), F.col("s"), F.col("items")).alias("value_shape"))


def field_facts(notes: DataFrame) -> DataFrame:
    """Per field: notes using it, its share of notes with a header, counts per shape, mixed."""
    shapes = classified(explode_fields(spread(notes))).groupBy("key", "value_shape").agg(
        F.count(F.lit(1)).alias("n"))
    headed = notes.filter(F.size(F.map_keys(F.col("fm").try_cast("map<string,variant>"))) > 0) \
        .agg(F.count(F.lit(1)).alias("headed")).scalar()
    count = lambda s: F.coalesce(
        F.sum(F.when(F.col("value_shape") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}")
    facts = shapes.groupBy("key").agg(
        F.sum("n").alias("n"), *[count(s) for s in ("string", "number", "boolean", "date", "list",
                                                    "object", "empty")],
        (F.count_if(F.col("value_shape") != "empty") > 1).alias("mixed"))
    return facts.select(
        *[c for c in facts.columns if c != "mixed"], "mixed",
        F.round(F.col("n") / headed, 6).alias("share"))


def baseline_shapes(shapes: DataFrame) -> DataFrame:
    """Most common non-empty shape per field; ties go to the smaller name."""
    counts = shapes.filter("value_shape <> 'empty'").groupBy("key", "value_shape").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.groupBy("key").agg(F.min_by(
        "value_shape", F.struct(-F.col("n"), F.col("value_shape"))).alias("baseline"))


def diverging_rows(notes: DataFrame) -> DataFrame:
    """Notes whose shape differs from the most common one of the field."""
    shapes = classified(explode_fields(spread(notes)))
    # One row per distinct key; the optimizer broadcasts it only while it is small.
    base = baseline_shapes(shapes)
    return shapes.filter("value_shape <> 'empty'").join(base, "key").filter(
        "value_shape <> baseline").select("path", "key", "value_shape", "baseline")


def field_drift(notes: DataFrame, schema: TypeSchema) -> DataFrame:
    """(field, drift): used but undeclared, or declared but unused anywhere."""
    used = notes.select(F.explode(F.map_keys(F.col("fm").try_cast("map<string,variant>")))
                        .alias("field")).distinct().filter("field <> 'type'")
    declared = schema.fields_table(notes.sparkSession).select("field").distinct()
    return used.join(F.broadcast(declared), "field", "left_anti").select(
        "field", F.lit("undeclared").alias("drift")).unionByName(
        declared.join(used, "field", "left_anti").select("field", F.lit("unused").alias("drift")))


def option_drift(notes: DataFrame, schema: TypeSchema) -> DataFrame:
    """Values outside the options declared for their field anywhere, with how many notes."""
    options = {}
    for fields in schema.fields.values():
        for name, d in fields.items():
            if d.get("options"):
                options.setdefault(name, set()).update(d["options"])
    dim = F.broadcast(notes.sparkSession.createDataFrame(
        [(k, sorted(v)) for k, v in options.items()], "key string, options array<string>"))
    rows = explode_fields(spread(notes)).join(dim, "key")
    texts = F.when(F.col("shape") == "list", F.transform(
        "items", lambda i: F.trim(i.try_cast("string")))).otherwise(F.array(F.trim("s")))
    values = rows.select("path", "key", "options", F.explode(F.array_distinct(
        F.filter(texts, lambda x: x.isNotNull() & (x != "")))).alias("value"))
    return values.filter(~F.array_contains("options", F.col("value"))).groupBy("key", "value").agg(
        F.count(F.lit(1)).alias("n_notes"), F.min("path").alias("first_path"))


def undocumented_types(schema: TypeSchema, spark) -> DataFrame:
    """Types and their own fields that lack a description."""
    types = schema.types_table(spark).filter("description IS NULL").select(
        F.lit("type").alias("what"), "type", F.lit(None).cast("string").alias("field"))
    fields = schema.fields_table(spark).filter("description IS NULL").select(
        F.lit("field").alias("what"), "type", "field")
    return types.unionByName(fields)
