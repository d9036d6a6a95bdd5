"""Derived fields, defaults, templates and constraints."""

from __future__ import annotations

import json
import re
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions.values import safe_name
from notegrid.operators import headers as E
from notegrid.operators.naming import free_names
from notegrid.types import TypeSchema

SPARK_TYPE = {"string": "string", "number": "double", "boolean": "boolean", "date": "date"}


def derive_plan(schema: TypeSchema, type_name: str, known: list[str]) -> list[tuple[str, str, str, list[str]]]:
    """(field, expression, type, inputs) in dependency order; unknown inputs, self references and
    rings are errors."""
    derived = {f: d["derived"] for f, d in schema.fields[type_name].items() if d.get("derived")}
    inputs = {}
    for field, d in derived.items():
        bare = re.sub(r"'[^']*'", "", d["expression"])
        words = set(re.findall(r"[A-Za-z_]\w*(?!\w|\s*\()", bare))
        used = sorted(w for w in words if w in derived or w in known)
        if field in used:
            raise ValueError(f"derived field {field} refers to itself")
        missing = [w for w in d.get("inputs", []) if w not in derived and w not in known]
        if missing:
            raise ValueError(f"derived field {field} uses unknown field {missing[0]}")
        inputs[field] = used
    try:
        order = list(TopologicalSorter({f: [u for u in used if u in derived]
                                        for f, used in inputs.items()}).static_order())
    except CycleError as e:
        raise ValueError(f"derived fields form a cycle: {' -> '.join(e.args[1])}") from e
    return [(f, derived[f]["expression"], derived[f].get("type", "string"), inputs[f]) for f in order]


def derive_fields(df: DataFrame, schema: TypeSchema, type_name: str) -> DataFrame:
    """Adds the type's virtual columns. A stored column of the same name is ignored; a null input
    gives null; the declared type is enforced with a safe cast."""
    names = [f for f, d in schema.fields[type_name].items() if d.get("derived")]
    df = df.drop(*[n for n in names if n in df.columns])
    for field, expression, kind, inputs in derive_plan(schema, type_name, df.columns):
        value = F.expr(f"try_cast(({expression}) AS {SPARK_TYPE[kind]})")
        missing = F.lit(False)
        for name in inputs:
            missing = missing | F.col(name).isNull()
        df = df.withColumn(field, F.when(missing, F.lit(None)).otherwise(value))
    return df


def apply_defaults(notes: DataFrame, schema: TypeSchema, asof: str) -> DataFrame:
    """(path, field, value) of blank declared fields: the fixed value wins over the default.

    Values other than text are JSON. The declared fields of a type ride along as one small array, so the check is row-local.
    """
    from notegrid.operators.rules import blank_value
    rows = []
    for t, fields in schema.fields.items():
        fill = []
        for f, d in fields.items():
            value = d.get("value", d.get("default"))
            if value is None or d.get("derived"):
                continue
            if value in ("$NOW", "$TODAY"):
                value = asof
            fill.append((f, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)))
        rows.append((t, fill))
    dim = F.broadcast(notes.sparkSession.createDataFrame(
        rows, "type string, fill array<struct<field:string,value:string>>"))
    h = E.held(F.col("fm"))
    wanted = notes.join(dim, "type").select("path", h.alias("h"), F.explode("fill").alias("f"))
    blank = blank_value(F.try_element_at("h", F.col("f.field")))
    return wanted.filter(F.coalesce(blank, F.lit(True))).select("path", "f.field", "f.value")


PLACEHOLDER = r"\{([^{}]+)\}"
DATE_WORDS = {"YYYY": "yyyy", "DD": "dd"}


def fill_template(template: str, columns: dict[str, Column], day: Column) -> Column:
    """Template text with ``{field}``, ``{date}`` and ``{date:FMT}``; null when a field is missing."""
    parts, at = [], 0
    for m in re.finditer(PLACEHOLDER, template):
        parts.append(F.lit(template[at:m.start()]))
        token = m[1]
        if token == "date":
            parts.append(F.date_format(day, "yyyy-MM-dd"))
        elif token.startswith("date:"):
            fmt = token[5:]
            for a, b in DATE_WORDS.items():
                fmt = fmt.replace(a, b)
            parts.append(F.date_format(day, fmt))
        elif token in columns:
            value = columns[token].cast("string")
            parts.append(F.when(value != "", value))
        else:
            parts.append(F.lit(None).cast("string"))
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def stamp_notes(rows: DataFrame, name_pattern: str, body: str, defaults: dict[str, str], asof: str) -> DataFrame:
    """New notes from a template: defaults fill gaps, placeholders are replaced, names are made
    portable; a missing placeholder leaves the name unresolved (null)."""
    filled = rows
    for field, value in defaults.items():
        c = F.lit(value)
        filled = filled.withColumn(field, F.coalesce(F.when(F.col(field).cast("string") != "", F.col(field)), c)
                                   if field in rows.columns else c)
    day = F.lit(asof).cast("date")
    columns = {c: F.col(c) for c in filled.columns}
    named = fill_template(name_pattern, columns, day)
    blanks = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in filled.columns}
    text = F.lit("")
    at = 0
    for m in re.finditer(PLACEHOLDER, body):  # in bodies an unknown placeholder stays as written
        token = m[1]
        piece = fill_template(m[0], columns, day) if token.startswith("date") else \
            blanks.get(token, F.lit(m[0]))
        text = F.concat(text, F.lit(body[at:m.start()]), piece)
        at = m.end()
    text = F.concat(text, F.lit(body[at:]))
    return filled.withColumn("new_name", safe_name(named)).withColumn("new_body", text)


def check_constraints(df: DataFrame, constraints: list[tuple[str, str, str, str]]) -> DataFrame:
    """(path, field, rule, message) for each broken (field, rule, predicate, message)."""
    checks = [F.when(~F.coalesce(F.expr(predicate), F.lit(False)),
                     F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"),
                              F.lit(message).alias("message")))
              for field, rule, predicate, message in constraints]
    return df.select("path", F.explode(F.array_compact(F.array(*checks))).alias("c")).select("path", "c.*")


def stamp_related(rows: DataFrame, instances: list[tuple[str, str]], notes: DataFrame) -> DataFrame:
    """(path, type, name, no): declared companion notes of each new row, under free names."""
    made = F.array(*[F.struct(F.lit(t).alias("type"), fill_template(
        p, {"name": F.col("name")}, F.lit(None).cast("date")).alias("want")) for t, p in instances])
    wanted = rows.select("path", F.explode(made).alias("m")).select("path", "m.type", "m.want")
    return free_names(wanted, notes, ["path", "type"]).select(
        "path", "type", F.col("free_name").alias("name"), "no")
