"""Automatic repairs as change tables over the field context of the rules.

Each repair answers, for one field of one note, "what JSON should stand here instead" or null.
They are row-local, so planning every repair of a corpus is one scan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions import dates as D
from notegrid.functions import links as L
from notegrid.functions.values import coerce_boolean, coerce_number, safe_name
from notegrid.operators import headers as E
from notegrid.operators import rules as Q
from notegrid.operators.bulk import destinations
from notegrid.operators.fields import shape_of
from notegrid.operators.naming import side_by_side
from notegrid.types import TypeSchema

TEXT = E.json_text


def _typed_json(text: Column, kind: Column) -> Column:
    """JSON of a text coerced to a declared kind; null when it does not fit."""
    number = F.when(coerce_number(text).isNotNull(), F.regexp_replace(F.trim(text), r"^(-?)0+(?=\d)", "$1"))
    return F.when(kind == "number", number) \
        .when(kind == "boolean", coerce_boolean(text).cast("string")).otherwise(TEXT(text))


def _default_json() -> Column:
    """The declared default as written in the schema; a text is coerced to the field's kind."""
    c = F.col
    single = F.when(F.startswith("default_json", F.lit('"')), _typed_json(c("default"), c("kind"))).otherwise(c("default_json"))
    return F.when(c("multiple") & ~F.startswith("default_json", F.lit("[")),
                  F.concat(F.lit("["), F.when(F.startswith("default_json", F.lit('"')), TEXT(c("default"))).otherwise(c("default_json")),
                           F.lit("]"))) \
        .when(c("multiple"), c("default_json")).otherwise(single)


def fix_default() -> Column:
    c = F.col
    return F.when(c("declared") & c("required") & c("default").isNotNull() & Q._blank(), _default_json())


def fix_scalar() -> Column:
    c = F.col
    want, shape = Q._expected_scalar(), c("shape")
    single = F.get("items", 0)
    base = c("declared") & c("derived_expr").isNull()
    scalar = base & ~Q._is_list_field()
    return F.when(base & Q._is_list_field() & shape.isin("string", "number", "boolean"),
                  F.concat(F.lit("["), F.to_json("v"), F.lit("]"))) \
        .when(scalar & (shape == "list") & (F.size("items") == 1) & (c("kind") != "relation"),
              _typed_json(single.try_cast("string"), want)) \
        .when(scalar & (shape == "string") & (F.trim("s") != "") & want.isin("number", "boolean"),
              _typed_json(c("s"), want)) \
        .when(scalar & shape.isin("number", "boolean") & (want == "string") & (
            (c("kind") != "date") | D.acceptable_date(c("s"), c("granularity"))), TEXT(c("s")))


def fix_date() -> Column:
    c = F.col
    return F.when(c("declared") & (c("kind") == "date") & c("shape").isin("string", "number")
                  & (F.trim("s") != "") & ~D.acceptable_date(c("s"), c("granularity"))
                  & D.acceptable_date(D.suggest_date(c("s")), c("granularity")), TEXT(D.suggest_date(c("s"))))


def fix_list() -> Column:
    """Drop null and blank items, flatten a lone nested list, make numbers text, drop repeats."""
    c = F.col
    nested = (F.size("items") == 1) & F.coalesce(F.forall(
        F.get("items", 0).try_cast("array<variant>"), lambda x: shape_of(x) == "string"), F.lit(False)) \
        & (shape_of(F.get("items", 0)) == "list")
    flat = F.when(nested, F.get("items", 0).try_cast("array<variant>")).otherwise(c("items"))
    texts = F.transform(flat, lambda x: F.when(x.isNull() | (shape_of(x) == "null"), F.lit(None))
                        .when(shape_of(x).isin("string", "number", "boolean"), x.try_cast("string"))
                        .otherwise(F.concat(F.lit("\u0000"), F.to_json(x))))
    good = F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (F.trim(t) != "")))
    new = F.concat(F.lit("["), F.array_join(F.transform(good, lambda t: F.when(
        F.startswith(t, F.lit("\u0000")), F.substr(t, F.lit(2), F.length(t))).otherwise(TEXT(t))), ","), F.lit("]"))
    keeps_one = ~c("required") | (F.size(good) > 0)
    whole_alias = ~c("alias") | F.forall("items", lambda x: shape_of(x) == "string")
    applies = c("declared") & Q._is_list_field() & (c("shape") == "list") & keeps_one & whole_alias \
        & ((c("kind") != "date") | F.exists("items", lambda x: shape_of(x) == "number"))
    return F.when(applies & (new != F.to_json("v")), new)


def fix_link(style: str = "wikilink") -> Column:
    """Missing bracket first, then the configured link format."""
    c = F.col
    def made(s: Column) -> Column:
        mended = F.when(Q.broken_link(s), Q.mended_link(s)).otherwise(s)
        return F.when(c("declared") & (c("kind") == "relation") & (F.trim(s) != ""), L.link_format(F.trim(mended), style)).otherwise(mended)

    items = F.concat(F.lit("["), F.array_join(F.transform("items", lambda v: F.when(
        F.coalesce((shape_of(v) == "string") & Q.broken_link(v.try_cast("string")), F.lit(False)), TEXT(made(v.try_cast("string")))).otherwise(F.coalesce(F.to_json(v), F.lit("null")))), ","), F.lit("]"))
    listed = F.exists("items", lambda v: F.coalesce((shape_of(v) == "string") & Q.broken_link(v.try_cast("string")), F.lit(False)))
    return F.when((c("shape") == "string") & (c("s") != "") & (made(c("s")) != c("s")), TEXT(made(c("s")))) \
        .when((c("shape") == "list") & listed, items)


def fix_boolean() -> Column:
    c = F.col
    return F.when(c("declared") & (c("kind") == "boolean") & (c("shape") == "string"),
                  coerce_boolean(c("s")).cast("string"))


def fix_enum_case() -> Column:
    c = F.col
    same = F.filter("options", lambda o: F.lower(o) == F.lower("s"))
    return F.when(c("declared") & (c("shape") == "string") & ~F.array_contains("options", c("s"))
                  & (F.size(same) == 1), TEXT(F.get(same, 0)))


def fix_key() -> Column:
    """Declared key a misspelt one should become: same letters, number, or, if the value fits, same words."""
    same = F.filter("names", lambda n: F.lower(n) == F.lower("key"))
    plural = F.concat("key", F.lit("s"))
    single = F.expr("substring(key, 1, length(key) - 1)")
    target = F.when(F.size(same) == 1, F.get(same, 0)) \
        .when(F.array_contains("names", plural), plural) \
        .when(F.endswith("key", F.lit("s")) & F.array_contains("names", single), single) \
        .otherwise(Q.key_target())
    open_target = ~Q._conflict(target)
    return F.when(~F.array_contains("names", F.col("key")) & ~F.col("key").isin(Q.NATIVE_FIELDS)
                  & target.isNotNull() & open_target, target)


VALUE_FIXES = {"fix_default": fix_default, "fix_enum_case": fix_enum_case, "fix_boolean": fix_boolean,
               "fix_date": fix_date, "fix_list": fix_list, "fix_link": fix_link,
               "fix_scalar": fix_scalar}


def repair_fields(notes: DataFrame, schema: TypeSchema, only: list[str] | None = None) -> DataFrame:
    """Changes for every repairable field; the first repair that applies names the change."""
    chosen = {k: f for k, f in VALUE_FIXES.items() if only is None or k in only}
    rows = Q.field_context(notes, schema)
    # Answers are columns of their own: no lambda stands around a repair, so that it is compiled, and each is worked out once.
    none = F.lit(None).cast("string")
    key = fix_key() if only is None or "fix_key" in only else none
    rows = rows.select("path", "key", "v", *[f().cast("string").alias(f"{k}_") for k, f in chosen.items()], key.alias("to_key_"))
    operation = F.coalesce(*[F.when(F.col(f"{k}_").isNotNull(), F.lit(k)) for k in chosen], none)
    change = F.struct(F.lit(0).alias("seq"), F.coalesce(operation, F.lit("fix_key")).alias("operation"), F.col("key").alias("field"),
                      F.to_json("v").alias("old"), F.coalesce(*[F.col(f"{k}_") for k in chosen], F.to_json("v")).alias("new"),
                      F.col("to_key_").alias("new_field"))
    made = F.when(F.coalesce(operation, F.col("to_key_")).isNotNull(), F.array(change))
    # Exploded rather than filtered, so that no repair is worked out twice.
    return rows.select("path", made.alias("made")).select("path", F.explode("made").alias("c")).select("path", "c.*")


def fix_adopt(notes: DataFrame, schema: TypeSchema) -> DataFrame:
    """Typeless notes in a type's folder get that type, its fixed values, and the defaults of required
    fields, of whatever kind; values that depend on the day (``$...``) are left to whoever writes."""
    def given(d: dict):
        return d.get("value", d.get("default") if d.get("required") else None)

    rows = [(t, f, json.dumps(v, ensure_ascii=False, default=str)) for t, fields in schema.fields.items() for f, v in [
        ("type", t), *[(f, given(d)) for f, d in fields.items()]]
        if v is not None and not (isinstance(v, str) and v.startswith("$"))]
    dim = F.broadcast(notes.sparkSession.createDataFrame(
        rows, "directory_type string, field string, value string"))
    keys = F.map_keys(E.held(F.col("fm")))
    lost = notes.filter(F.col("type").isNull() & F.col("directory_type").isNotNull()).select(
        "path", "directory_type", keys.alias("keys"))
    return lost.join(dim, "directory_type").filter(~F.array_contains("keys", F.col("field"))).select(
        "path", F.lit(0).alias("seq"), F.lit("fix_adopt").alias("operation"), "field",
        F.lit(None).cast("string").alias("old"), F.col("value").alias("new"),
        F.lit(None).cast("string").alias("new_field"))


def fix_stale_link(stale: DataFrame, close: DataFrame) -> DataFrame:
    """(src_path, field, raw, new_raw): a dead link becomes the one name close to it.

    ``close(query, name, distance)`` lists names within two edits; more than one is no answer.
    """
    single = close.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")) \
        .filter("n = 1")
    # Only the target changes: heading and display text may spell the same name.
    opened = F.greatest(F.instr("raw", "[["), F.when(L.is_markdown_link(F.col("raw")), F.instr("raw", "](")).otherwise(0), F.lit(1))
    at = F.expr("locate(target, raw, opened)")
    return stale.join(single, F.col("target") == F.col("query")).withColumn("opened", opened).withColumn("at", at).select(
        "src_path", "field", "raw", F.expr("substring(raw, 1, at - 1) || name || substring(raw, at + length(target))").alias("new_raw"))


def fix_location(notes: DataFrame, schema: TypeSchema, existing: DataFrame | None = None) -> DataFrame:
    """(path, new_path, error): misplaced notes go to their type's folder, unless they sit with their
    owner. Places taken by a note of ``existing`` (default ``notes``) or claimed twice are errors."""
    dim = F.broadcast(notes.sparkSession.createDataFrame(
        list(schema.output_dir.items()), "type string, output_dir string"))
    rows = notes.join(dim, "type")
    if any(d.get("owned") for fields in schema.fields.values() for d in fields.values()):
        rows = rows.join(Q.well_owned(notes, schema).select("path"), "path", "left_anti")
    out = rows.filter(
        (F.col("folder") != F.col("output_dir")) & ~F.startswith("folder", F.concat("output_dir", F.lit("/"))))
    out = out.select("path", F.concat("output_dir", F.lit("/"), "name").alias("new_path"))
    return destinations(out, notes if existing is None else existing)


def fix_name(notes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(path, new_path, error): names that are not portable get their portable form, errors as in ``fix_location``."""
    safe = safe_name(F.col("name"))
    out = notes.filter(safe != F.col("name")).select("path", F.concat("folder", F.lit("/"), safe).alias("new_path"))
    return destinations(out, notes if existing is None else existing)


def fix_sections(notes: DataFrame, sections: dict[str, list[tuple[int, str]]]) -> DataFrame:
    """(path, body): missing declared headings appended in declared order."""
    from notegrid.operators.search import heading_pattern, prose_mask
    masked, body = prose_mask(F.col("body")), F.rtrim("body")
    text = F.lit("")
    for t, declared in sections.items():
        for level, title in declared:
            lacks = (F.col("type") == t) & ~F.col("masked").rlike(heading_pattern(level, title))
            text = F.concat(text, F.when(lacks, F.lit("\n\n" + "#" * level + f" {title}\n")).otherwise(""))
    rows = notes.withColumn("masked", masked).withColumn("added", text)
    return rows.filter("added <> ''").select("path", F.concat(body, "added").alias("body"))


def fix_whitespace(raw: Column) -> Column:
    """Header lines without trailing blanks; the body and block scalars, whose lines are indented, stay as they are."""
    head = F.regexp_extract(raw, r"\A(---\n[\s\S]*?\n---\n?)", 1)
    rest = F.substring(raw, F.length(head) + 1, F.length(raw))
    clean = F.regexp_replace(head, r"(?m)^([^\s:#][^:\n]*:[ \t]*\S.*?)[ \t]+$", "$1")
    return F.when(head == "", raw).otherwise(F.concat(clean, rest))


def fix_summary(issues: DataFrame, changes: DataFrame, after: DataFrame) -> DataFrame:
    """fixed / skipped / remaining counts of a repair run."""
    before = issues.agg(F.count_if("auto_fixable").alias("fixable"),
                        F.count_if(~F.col("auto_fixable")).alias("skipped"))
    fixed = changes.agg(F.count(F.lit(1)).alias("fixed"))
    left = after.agg(F.count(F.lit(1)).alias("remaining"))
    return side_by_side(before, fixed, left)
