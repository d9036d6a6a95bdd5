"""Quality rules.

A rule is a Column of issues over one row of a *context*: a note, a field, a resolved link or a
body. All rules of a context run in one pass over it, so asking for every rule reads the data
once per context and shuffles only where links are resolved. Type knowledge comes from the
schema-sized dimension tables, which are broadcast.

issues: path, code, severity, field, value, list_index, expected, suggestion, auto_fixable
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions import dates as D
from notegrid.functions import links as L
from notegrid.functions import text as X
from notegrid.functions.values import coerce_boolean, coerce_number, safe_name
from notegrid.operators.fields import explode_fields, shape_of
from notegrid.operators.lineage import valid_id
from notegrid.operators.naming import side_by_side
from notegrid.operators.resolve import asked_index, name_rows
from notegrid.session import spread
from notegrid.sources.notes import read_owned
from notegrid.types import TypeSchema

# Keys every note may carry without declaring them.
NATIVE_FIELDS = ["tags", "aliases", "cssclasses", "publish", "type"]
BUILTIN_FIELDS = ["id", "name", "forked-from"]

ISSUE = ("struct<code string, severity string, field string, value string, list_index int, "
         "expected string, suggestion string, auto_fixable boolean>")


def no() -> Column:
    return F.lit(False)


def issue(code: str, severity: str, *, field=None, value=None, index=None, expected=None,
          suggestion=None, fix=None) -> Column:
    def text(x):
        if x is None:
            return F.lit(None).cast("string")
        return F.lit(x) if isinstance(x, str) else x.cast("string")

    return F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), text(field).alias("field"),
        text(value).alias("value"),
        (F.lit(None) if index is None else index).cast("int").alias("list_index"),
        text(expected).alias("expected"), text(suggestion).alias("suggestion"),
        (no() if fix is None else fix).cast("boolean").alias("auto_fixable"))


def one(condition: Column, made: Column) -> Column:
    """A list with the issue, or an empty list. No lambda stands around the rule, so that it is compiled."""
    return F.when(F.coalesce(condition, no()), F.array(made)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def per_item(condition, make, guard: Column) -> Column:
    """One issue per list item; ``condition`` and ``make`` take (item, index)."""
    items = F.transform("items", lambda v, i: F.when(F.coalesce(condition(v, i), no()), make(v, i)))
    return F.when(F.coalesce(guard, no()), F.array_compact(items)).otherwise(
        F.array().cast(f"array<{ISSUE}>"))


# ---------------------------------------------------------------- field context

def field_context(notes: DataFrame, schema: TypeSchema) -> DataFrame:
    """Rows of ``explode_fields`` for typed notes, with the declared field (if any) and the
    declared names of the type."""
    spark = notes.sparkSession
    known = list(schema.parent)
    rows = explode_fields(spread(notes.filter(F.col("type").isin(known))), "fm").filter(
        (F.col("key") != "type") & ~F.endswith("key", F.lit("-type")))
    fields = F.broadcast(schema.fields_table(spark).drop("ordinal", "description").select(
        F.col("type").alias("d_type"), F.col("field").alias("key"), "kind", "required", "multiple",
        "default", "default_json", "options", "source_types", "granularity", "alias", "derived_expr"))
    names = F.broadcast(spark.createDataFrame(
        [(t, list(f), [(n, _wanted_shape(d)) for n, d in f.items()]) for t, f in schema.fields.items()],
        "n_type string, names array<string>, wants array<struct<name string, shape string>>"))
    return rows.join(names, F.col("type") == F.col("n_type")).join(
        fields.withColumnRenamed("key", "d_key"),
        (F.col("type") == F.col("d_type")) & (F.col("key") == F.col("d_key")), "left") \
        .drop("n_type", "d_key").withColumn("declared", F.col("d_type").isNotNull()).drop("d_type")


def _wanted_shape(field: dict) -> str | None:
    """Shape a value of the field has in a header; None where several will do."""
    kind = field.get("kind")
    if kind is None or field.get("multiple"):
        return None
    return kind if kind in ("list", "boolean", "number") else "string"


def blank_value(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return v.isNull() | (s == "VOID") | ((s == "STRING") & (F.trim(v.try_cast("string")) == "")) \
        | (F.startswith(s, F.lit("ARRAY")) & (F.size(v.try_cast("array<variant>")) == 0))


def _filled(key: Column) -> Column:
    """The note holds the key with something in it; asked for only where a rule needs it, as it reads the whole header."""
    entries = F.map_entries(F.col("fm").try_cast("map<string,variant>"))
    return F.exists(entries, lambda e: (e["key"] == key) & ~blank_value(e["value"]))


def _c(name: str) -> Column:
    return F.col(name)


def _is_list_field() -> Column:
    return _c("multiple") | (_c("kind") == "list")


def _expected_scalar() -> Column:
    return F.when(_c("kind").isin("number", "boolean"), _c("kind")).otherwise("string")


def _blank() -> Column:
    return (_c("shape") == "null") | ((_c("shape") == "string") & (F.trim("s") == "")) \
        | ((_c("shape") == "list") & (F.size("items") == 0))


def _fits(text: Column, kind: Column) -> Column:
    return F.when(kind == "number", coerce_number(text).isNotNull()) \
        .when(kind == "boolean", coerce_boolean(text).isNotNull()).otherwise(True)


def empty_string_required() -> Column:
    return one(_c("declared") & _c("required") & _c("derived_expr").isNull() & _blank(),
               issue("empty-string-required", "error", field=_c("key"), value=_c("s"),
                     fix=_c("default").isNotNull()))


def derived_field_persisted() -> Column:
    return one(_c("declared") & _c("derived_expr").isNotNull(),
               issue("derived-field-persisted", "error", field=_c("key"), value=_c("s")))


def wrong_scalar_type() -> Column:
    shape, want = _c("shape"), _expected_scalar()
    text_blank = (shape == "string") & (F.trim("s") == "")
    base = _c("declared") & _c("derived_expr").isNull() & (_c("kind") != "relative-date")
    made = lambda expected, fix: issue(
        "wrong-scalar-type", "error", field=_c("key"), value=F.coalesce(_c("s"), F.to_json("v")),
        expected=expected, fix=fix)
    not_list = one(base & _is_list_field() & ~shape.isin("list", "null"),
                   made("list", shape != "object"))
    is_list = one(base & ~_is_list_field() & (shape == "list") & (_c("kind") != "relation"),
                  made(want, (F.size("items") == 1) & F.coalesce(
                      _fits(F.get("items", 0).try_cast("string"), want), no())))
    scalar = base & ~_is_list_field() & ~text_blank
    from_text = one(scalar & want.isin("number", "boolean") & (shape == "string"),
                    made(want, _fits(_c("s"), want)))
    from_other = one(scalar & want.isin("number", "boolean") & ~shape.isin("string", "list", "null")
                     & (shape != want), made(want, no()))
    to_text = one(scalar & (want == "string") & shape.isin("number", "boolean")
                  & (_c("kind") != "date"), made("string", F.lit(True)))
    year = one(scalar & (_c("kind") == "date") & (shape == "number")
               & D.acceptable_date(_c("s"), _c("granularity")), made("string", F.lit(True)))
    quoted = per_item(lambda v, i: (shape_of(v) == "number")
                      & D.acceptable_date(v.try_cast("string"), _c("granularity")),
                      lambda v, i: issue("wrong-scalar-type", "error", field=_c("key"),
                                         value=v.try_cast("string"), index=i, expected="string",
                                         fix=F.lit(True)),
                      base & (_c("kind") == "date") & (shape == "list"))
    return F.concat(not_list, is_list, from_text, from_other, to_text, year, quoted)


def invalid_date_format() -> Column:
    base = _c("declared") & (_c("kind") == "date") & _c("derived_expr").isNull()
    fixed = D.suggest_date(_c("s"))
    scalar = one(base & _c("shape").isin("string", "number") & (F.trim("s") != "")
                 & ~D.acceptable_date(_c("s"), _c("granularity")),
                 issue("invalid-date-format", "error", field=_c("key"), value=_c("s"),
                       expected=_c("granularity"), suggestion=fixed, fix=fixed.isNotNull()))
    text = lambda v: v.try_cast("string")
    listed = per_item(lambda v, i: shape_of(v).isin("string", "number") & (F.trim(text(v)) != "")
                      & ~D.acceptable_date(text(v), _c("granularity")),
                      lambda v, i: issue("invalid-date-format", "error", field=_c("key"),
                                         value=text(v), index=i, expected=_c("granularity")),
                      base & (_c("shape") == "list"))
    return F.concat(scalar, listed)


def invalid_option() -> Column:
    base = _c("declared") & (F.size("options") > 0) & _c("derived_expr").isNull()
    joined = F.array_join("options", ", ")
    scalar = one(base & _c("shape").isin("string", "number", "boolean") & (F.trim("s") != "")
                 & ~F.array_contains("options", _c("s")),
                 issue("invalid-option", "error", field=_c("key"), value=_c("s"), expected=joined,
                       suggestion=X.suggest_option(_c("s"), _c("options"))))
    text = lambda v: v.try_cast("string")
    listed = per_item(lambda v, i: (shape_of(v) == "string") & (F.trim(text(v)) != "")
                      & ~F.array_contains("options", text(v)),
                      lambda v, i: issue("invalid-option", "error", field=_c("key"), value=text(v),
                                         index=i, expected=joined,
                                         suggestion=X.suggest_option(text(v), _c("options"))),
                      base & (_c("shape") == "list"))
    return F.concat(scalar, listed)


def _fits_field(field: Column) -> Column:
    """The value could stand under the field: it is blank or has the shape the field wants."""
    return _blank() | field["shape"].isNull() | (field["shape"] == _c("shape"))


def key_target() -> Column:
    """The one declared field an unknown key surely stands for: same bare name, else singular or
    plural of one; null if the note already holds something there or the value has another shape."""
    own = X.bare_key(_c("key"))
    same = F.filter("wants", lambda f: X.bare_key(f["name"]) == own)
    near = F.filter("wants", lambda f: X.singular_plural(own, X.bare_key(f["name"])))
    field = F.when(own == "", F.lit(None)).when(F.size(same) == 1, F.get(same, 0)).when(F.size(near) == 1, F.get(near, 0))
    return F.when(~_filled(field["name"]) & _fits_field(field), field["name"])


def unknown_field(allowed: list[str] | None = None, strict: bool = False) -> Column:
    """``expected`` lists the declared fields most like the key; repairable where it surely stands for one."""
    known = NATIVE_FIELDS + BUILTIN_FIELDS + list(allowed or [])
    alike = X.similar_keys(_c("key"), _fits_field, F.col("wants"))
    return one(~_c("declared") & ~_c("key").isin(known),
               issue("unknown-field", "error" if strict else "warning", field=_c("key"),
                     value=F.coalesce(_c("s"), F.to_json("v")), expected=F.when(F.size(alike) > 0, F.array_join(alike, ", ")),
                     suggestion=X.suggest_key(_c("key"), _c("names")), fix=key_target().isNotNull()))


def _conflict(other: Column) -> Column:
    """The note holds both keys with something in each."""
    return ~_blank() & _filled(other)


def frontmatter_key_casing() -> Column:
    same = F.filter("names", lambda n: F.lower(n) == F.lower("key"))
    target = F.get(same, 0)
    single = F.size(same) == 1
    return one(~F.array_contains("names", _c("key")) & (F.size(same) > 0),
               issue("frontmatter-key-casing", "warning", field=_c("key"), value=_c("s"),
                     expected=F.when(single, target), fix=single & ~_conflict(target)))


def singular_plural_mismatch() -> Column:
    plural = F.concat("key", F.lit("s"))
    single = F.expr("substring(key, 1, length(key) - 1)")
    target = F.when(F.array_contains("names", plural), plural).when(
        F.endswith("key", F.lit("s")) & (F.length("key") > 1) & F.array_contains("names", single), single)
    return one(~F.array_contains("names", _c("key")) & target.isNotNull(),
               issue("singular-plural-mismatch", "warning", field=_c("key"), value=_c("s"),
                     expected=target, fix=~_conflict(target)))


def unknown_enum_casing() -> Column:
    same = F.filter("options", lambda o: F.lower(o) == F.lower("s"))
    return one(_c("declared") & (_c("shape") == "string") & ~F.array_contains("options", _c("s"))
               & (F.size(same) > 0),
               issue("unknown-enum-casing", "warning", field=_c("key"), value=_c("s"),
                     expected=F.when(F.size(same) == 1, F.get(same, 0)), fix=F.size(same) == 1))


def _all_text() -> Column:
    return F.forall("items", lambda v: shape_of(v) == "string")


def duplicate_list_values() -> Column:
    texts = F.transform("items", lambda v: v.try_cast("string"))
    return one((_c("shape") == "list") & ~F.coalesce(_c("alias"), no()) & _all_text()
               & (F.size(F.array_distinct(texts)) < F.size(texts)),
               issue("duplicate-list-values", "warning", field=_c("key"), value=F.to_json("v"),
                     fix=F.lit(True)))


def illegal_aliases() -> Column:
    texts = F.transform("items", lambda v: F.when(shape_of(v) == "string", v.try_cast("string")))
    wrong = F.exists(texts, lambda x: x.isNull())
    blank = F.exists(texts, lambda x: F.coalesce(F.trim(x) == "", no()))
    named = F.filter(texts, lambda x: F.coalesce(F.trim(x) != "", no()))
    twice = F.size(F.array_distinct(named)) < F.size(named)
    return one((_c("shape") == "list") & _c("declared") & _c("alias") & (wrong | blank | twice),
               issue("illegal-aliases", "error", field=_c("key"), value=F.to_json("v"), fix=~wrong))


def invalid_list_element() -> Column:
    shape = lambda v: F.when(v.isNull(), "null").otherwise(shape_of(v))
    blank = lambda v: (shape(v) == "string") & (F.trim(v.try_cast("string")) == "")
    filled = F.exists("items", lambda v: ~F.coalesce((shape(v) == "null") | blank(v), no()))
    bad = lambda v, i: (shape(v) != "string") | blank(v)
    owned_by_date = lambda v: (_c("kind") == "date") & (shape(v) == "number")
    flat = lambda v: (F.size("items") == 1) & F.forall(
        v.try_cast("array<variant>"), lambda x: shape(x) == "string")
    fix = lambda v: F.when((shape(v) == "null") | blank(v), ~_c("required") | filled) \
        .when(shape(v) == "list", flat(v)).otherwise(shape(v).isin("number", "boolean"))
    reason = lambda v: F.when(shape(v) == "null", "null").when(blank(v), "empty-string") \
        .when(shape(v) == "list", "nested-list").otherwise("wrong-type")
    return per_item(lambda v, i: bad(v, i) & ~owned_by_date(v),
                    lambda v, i: issue("invalid-list-element", "warning", field=_c("key"),
                                       value=v.try_cast("string"), index=i, expected=reason(v),
                                       fix=F.coalesce(fix(v), no())),
                    _c("declared") & _is_list_field() & ~_c("alias") & (_c("shape") == "list"))


def invalid_boolean_coercion() -> Column:
    return one(_c("declared") & (_c("kind") == "boolean") & (_c("shape") == "string")
               & coerce_boolean(_c("s")).isNotNull(),
               issue("invalid-boolean-coercion", "warning", field=_c("key"), value=_c("s"),
                     expected=coerce_boolean(_c("s")), fix=F.lit(True)))


def broken_link(s: Column) -> Column:
    """A wikilink that lacks one bracket at its start or its end."""
    return s.rlike(r"^\s*(\[\[.*[^\]]|\[\[)\]\s*$") | s.rlike(r"^\s*\[[^\[].*\]\]\s*$")


def mended_link(s: Column) -> Column:
    """The link with that bracket; blanks around it stay."""
    return F.when(s.rlike(r"^\s*\[\["), F.regexp_replace(s, r"(\]\s*)$", "]$1")) \
        .otherwise(F.regexp_replace(s, r"^(\s*\[)", "$1["))


def malformed_wikilink() -> Column:
    broken, mended = broken_link, mended_link

    scalar = one((_c("shape") == "string") & broken(_c("s")),
                 issue("malformed-wikilink", "error", field=_c("key"), value=_c("s"),
                       expected=mended(_c("s")), fix=F.lit(True)))
    text = lambda v: v.try_cast("string")
    listed = per_item(lambda v, i: (shape_of(v) == "string") & broken(text(v)),
                      lambda v, i: issue("malformed-wikilink", "error", field=_c("key"),
                                         value=text(v), index=i, expected=mended(text(v)),
                                         fix=F.lit(True)),
                      _c("shape") == "list")
    return F.concat(scalar, listed)


def format_violation(style: str = "wikilink") -> Column:
    good = L.is_wikilink(_c("s")) if style == "wikilink" else L.is_markdown_link(_c("s"))
    return one(_c("declared") & (_c("kind") == "relation")
               & _c("shape").isin("string", "number", "boolean") & (_c("s") != "") & ~good,
               issue("format-violation", "error", field=_c("key"), value=_c("s"), expected=style,
                     fix=F.lit(True)))


FIELD_RULES = {
    "empty-string-required": empty_string_required,
    "derived-field-persisted": derived_field_persisted,
    "wrong-scalar-type": wrong_scalar_type,
    "invalid-date-format": invalid_date_format,
    "invalid-option": invalid_option,
    "unknown-field": unknown_field,
    "frontmatter-key-casing": frontmatter_key_casing,
    "singular-plural-mismatch": singular_plural_mismatch,
    "unknown-enum-casing": unknown_enum_casing,
    "duplicate-list-values": duplicate_list_values,
    "illegal-aliases": illegal_aliases,
    "invalid-list-element": invalid_list_element,
    "invalid-boolean-coercion": invalid_boolean_coercion,
    "malformed-wikilink": malformed_wikilink,
    "format-violation": format_violation,
}

# ---------------------------------------------------------------- note context


def note_context(notes: DataFrame, schema: TypeSchema) -> DataFrame:
    """Notes with their type's folder, required fields and held keys."""
    rows = []
    for t, fields in schema.fields.items():
        required = [f for f, d in fields.items()
                    if d.get("required") and not d.get("derived") and d.get("default") is None]
        rows.append((t, schema.output_dir[t], required))
    dim = F.broadcast(notes.sparkSession.createDataFrame(
        rows, "d_type string, output_dir string, required array<string>"))
    out = spread(notes).join(dim, F.col("type") == F.col("d_type"), "left")
    if any(d.get("owned") for fields in schema.fields.values() for d in fields.values()):
        out = out.join(well_owned(notes, schema), "path", "left")
    else:
        out = out.withColumn("owner_path", F.lit(None).cast("string"))
    return out.withColumn("typed", F.col("d_type").isNotNull()).drop("d_type").withColumn(
        "keys", F.map_keys(F.col("fm").try_cast("map<string,variant>")))


def well_owned(notes: DataFrame, schema: TypeSchema) -> DataFrame:
    """(path, owner_path): notes that sit where their owner's field keeps notes of their type."""
    kept = [(t, f, k) for t, fields in schema.fields.items() for f, d in fields.items() if d.get("owned")
            for k in schema.source_family(d)]
    allowed = F.broadcast(notes.sparkSession.createDataFrame(kept, "owner_type string, field string, type string"))
    placed = read_owned(notes, schema).join(notes.select("path", "type"), "path")
    return (placed.join(allowed, ["owner_type", "field", "type"]).groupBy("path")
            .agg(F.min("owner_path").alias("owner_path")))


def missing_frontmatter() -> Column:
    return one(_c("fm").isNull(), issue("missing-frontmatter", "error",
                                        fix=_c("directory_type").isNotNull()))


def orphan_file() -> Column:
    return one(_c("fm").isNotNull() & (F.coalesce("type", F.lit("")) == ""),
               issue("orphan-file", "error", fix=_c("directory_type").isNotNull()))


def invalid_type(schema: TypeSchema) -> Column:
    known = F.array(*map(F.lit, schema.parent))
    return one((F.coalesce("type", F.lit("")) != "") & ~_c("typed"),
               issue("invalid-type", "error", field="type", value=_c("type"),
                     suggestion=X.suggest_key(_c("type"), known)))


def unsafe_filename() -> Column:
    return one(_c("typed") & (safe_name(_c("name")) != _c("name")),
               issue("unsafe-filename", "error", value=_c("name"),
                     expected=safe_name(_c("name")), fix=safe_name(_c("name")) != ""))


def wrong_directory() -> Column:
    return one(_c("typed") & _c("owner_path").isNull() & (_c("folder") != _c("output_dir"))
               & ~F.startswith("folder", F.concat("output_dir", F.lit("/"))),
               issue("wrong-directory", "error", value=_c("folder"), expected=_c("output_dir"),
                     fix=F.lit(True)))


def missing_required() -> Column:
    lower_keys = F.transform("keys", lambda k: F.lower(k))
    gone = F.filter("required", lambda f: ~F.array_contains("keys", f)
                    & ~F.array_contains(lower_keys, F.lower(f)))
    return F.when(_c("typed"), F.transform(gone, lambda f: issue(
        "missing-required", "error", field=f))).otherwise(F.array().cast(f"array<{ISSUE}>"))


def note_ids() -> Column:
    v = F.try_variant_get("fm", "$.id", "string")
    return F.concat(
        one(_c("fm").isNotNull() & ~F.array_contains("keys", F.lit("id")),
            issue("missing-note-id", "error", field="id")),
        one(F.array_contains("keys", F.lit("id")) & ~valid_id(v),
            issue("invalid-note-id", "error", field="id", value=v)))


def retention_due(schema: TypeSchema, asof: str) -> Column:
    """Per type with a retention rule: conditions hold, not resolved, clock plus days reached."""
    out = F.array().cast(f"array<{ISSUE}>")
    text = lambda f: F.when(
        F.schema_of_variant(F.try_variant_get("fm", f"$['{f}']", "variant")) == "STRING",
        F.try_variant_get("fm", f"$['{f}']", "string"))

    def holds(condition: dict) -> Column:
        return reduce(lambda a, kv: a & F.coalesce(text(kv[0]).isin(kv[1]), no()),
                      condition.items(), F.lit(True))

    for t in schema.parent:
        rule = schema.spec(t).get("retention")
        if not rule:
            continue
        clock = text(rule["clock"])
        day = D.iso_day(clock)
        due = F.date_add(day, rule["after_days"])
        applies = _c("type").isin(t) & holds(rule["when"])
        if rule.get("resolved_when"):
            applies = applies & ~holds(rule["resolved_when"])
        out = F.concat(out, one(
            applies & (day.isNull() | (due <= F.lit(asof).cast("date"))),
            issue("retention-due", "warning", field=rule["clock"], value=clock,
                  expected=F.coalesce(F.date_format(due, "yyyy-MM-dd"), F.lit("invalid-clock")))))
    return out


# ---------------------------------------------------------------- link context

def stale_reference() -> Column:
    return one((_c("resolution") == "none") & L.is_wikilink(_c("raw")),
               issue("stale-reference", "warning", field=_c("field"), value=_c("raw")))


def invalid_source_type() -> Column:
    return one(_c("resolution") == "no-source-match",
               issue("invalid-source-type", "error", field=_c("field"), value=_c("raw")))


def self_reference() -> Column:
    return one(_c("resolved_path") == _c("src_path"),
               issue("self-reference", "error", field=_c("field"), value=_c("raw")))


def ambiguous_link_target() -> Column:
    return one(_c("resolution") == "ambiguous",
               issue("ambiguous-link-target", "warning", field=_c("field"), value=_c("raw")))


LINK_RULES = {
    "stale-reference": stale_reference,
    "invalid-source-type": invalid_source_type,
    "self-reference": self_reference,
    "ambiguous-link-target": ambiguous_link_target,
}

# ---------------------------------------------------------------- runner


def emit(context: DataFrame, rules: list[Column], path: str = "path") -> DataFrame:
    """All issues of the given rules in one pass over the context; the lists are made before the generator, which would
    interpret them."""
    return context.select(F.col(path).alias("path"), F.concat(*rules).alias("issues")) \
        .select("path", F.explode("issues").alias("i")).select("path", "i.*")


def field_issues(notes: DataFrame, schema: TypeSchema, codes: list[str] | None = None) -> DataFrame:
    chosen = [FIELD_RULES[c]() for c in (codes or FIELD_RULES)]
    return emit(field_context(notes, schema), chosen)


def note_rules(schema: TypeSchema, asof: str) -> dict:
    return {
        "missing-frontmatter": missing_frontmatter,
        "orphan-file": orphan_file,
        "invalid-type": lambda: invalid_type(schema),
        "unsafe-filename": unsafe_filename,
        "wrong-directory": wrong_directory,
        "missing-required": missing_required,
        "note-id": note_ids,
        "retention-due": lambda: retention_due(schema, asof),
    }


def note_issues(notes: DataFrame, schema: TypeSchema, asof: str,
                codes: list[str] | None = None) -> DataFrame:
    rules = note_rules(schema, asof)
    chosen = [rules[c]() for c in (codes or [c for c in rules if c != "note-id"])]
    return emit(note_context(notes, schema), chosen)


def link_issues(resolved: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Relation rules over resolved links."""
    return emit(resolved, [LINK_RULES[c]() for c in (codes or LINK_RULES)], "src_path")


def audit_summary(issues: DataFrame, checked: DataFrame) -> DataFrame:
    """Files checked, with errors, with warnings only counted apart, and totals."""
    per_file = issues.groupBy("path").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))
    totals = per_file.agg(
        F.count_if(F.col("errors") > 0).alias("files_with_errors"),
        F.count_if(F.col("warnings") > 0).alias("files_with_warnings"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("total_warnings"))
    return side_by_side(checked.agg(F.count(F.lit(1)).alias("files_checked")), totals)


WRITTEN = "struct<severity string, code string, field string, value string>"
LEADING_NUMBER = r"^\s*[+-]?(Infinity|[0-9]+\.?[0-9]*|\.[0-9]+)"


def _written(condition: Column, code: str, value: Column, field: Column | None = None, severity: str = "error") -> Column:
    made = F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"),
                    (_c("key") if field is None else field).alias("field"), value.cast("string").alias("value"))
    return F.when(F.coalesce(condition, no()), F.array(made)).otherwise(F.array().cast(f"array<{WRITTEN}>"))


def _written_field() -> Column:
    """What the write-time check says of one field: required first, then options and kind."""
    shape, text = _c("shape"), lambda v: v.try_cast("string")
    listed = _is_list_field()
    nothing = (shape == "null") | ((shape == "list") & listed & (F.size("items") == 0))
    blank = (shape == "string") & (F.trim("s") == "")
    missing = _c("declared") & _c("required") & _c("derived_expr").isNull() & _c("default").isNull() & (nothing | blank)
    held = _c("declared") & ~missing & ~nothing & (listed | ~blank)
    value = F.coalesce(_c("s"), F.to_json("v"))
    chosen = held & (F.size("options") > 0)
    option = _written(chosen & (shape != "list") & ~F.array_contains("options", value), "invalid_option_value", value)
    items = F.filter(F.transform("items", lambda v: F.coalesce(text(v), F.lit("null"))), lambda x: ~F.array_contains("options", x))
    options = F.when(F.coalesce(chosen & listed & (shape == "list"), no()), F.transform(items, lambda x: F.struct(
        F.lit("error").alias("severity"), F.lit("invalid_option_value").alias("code"), _c("key").alias("field"), x.alias("value")))) \
        .otherwise(F.array().cast(f"array<{WRITTEN}>"))

    kind, alias = _c("kind"), F.coalesce(_c("alias"), no())
    texts = F.transform("items", lambda v: F.when(shape_of(v) == "string", text(v)))
    bad_alias = (shape != "list") | F.exists(texts, lambda x: x.isNull() | (F.trim(x) == "")) | (F.size(F.array_distinct(texts)) < F.size(texts))
    good_date = lambda x: D.normalize_date(x, _c("granularity"))["value"].isNotNull()
    dated = held & ~alias & (kind == "date")
    bad_items = F.exists("items", lambda v: F.coalesce(shape_of(v).isin("string", "number") & (F.trim(text(v)) != "") & ~good_date(text(v)), no()))
    odd_items = F.exists("items", lambda v: F.coalesce(shape_of(v).isin("boolean", "list", "object"), no()))
    many = listed & (shape == "list")
    wrong = F.when(kind == "list", shape != "list") \
        .when(kind == "date", (many & odd_items & ~bad_items) | (~many & ~shape.isin("string", "number"))) \
        .when(kind == "boolean", (shape != "boolean") & ~((shape == "string") & _c("s").isin("true", "false"))) \
        .when(kind == "number", (shape != "number") & ~((shape == "string") & _c("s").rlike(LEADING_NUMBER))) \
        .when(kind == "relative-date", no()).otherwise(shape == "object")
    return F.concat(
        _written(missing, "required_field_missing", value), option, options,
        _written(held & alias & bad_alias, "invalid_alias", value), _written(held & ~alias & wrong, "invalid_type", value),
        _written(dated & ((many & bad_items) | (~many & shape.isin("string", "number") & ~good_date(_c("s")))), "invalid_date", value),
        _written(~_c("declared") & ~_c("key").isin(BUILTIN_FIELDS), "unknown_field", value, severity="warning"))


def _written_links(fields: DataFrame, targets: DataFrame) -> DataFrame:
    """Links of relation fields whose target is not the one note of a type that the field takes; other text is left to other checks."""
    values = F.when(F.col("shape") == "list", F.transform("items", lambda v: F.when(shape_of(v) == "string", v.try_cast("string")))) \
        .when(F.col("shape") == "string", F.array("s"))
    links = fields.filter("declared AND kind = 'relation' AND size(source_types) > 0").select("path", "key", "source_types", F.explode(values).alias("raw"))
    target = L.target_path(F.col("raw"))
    links = links.filter(L.is_wikilink(F.col("raw")) & L.link_target(F.col("raw")).isNotNull()).withColumn("target", target)
    index = asked_index(targets, links).select(F.col("key").alias("t_key"), "n", "types")
    hits = F.filter(F.transform("source_types", lambda s: F.try_element_at("types", s)), lambda h: h.isNotNull())
    fitting = F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, h: a + h["n"])
    sole = (fitting == 1) & ((F.col("n") == 1) | ~F.contains("target", F.lit("/")))
    return links.join(index, F.lower("target") == F.col("t_key"), "left").filter(~F.coalesce(sole, no())).select(
        "path", F.lit("error").alias("severity"), F.lit("invalid_context_source").alias("code"), F.col("key").alias("field"), F.col("raw").alias("value"))


def validate_rows(notes: DataFrame, schema: TypeSchema, targets: DataFrame | None = None) -> DataFrame:
    """Write-time verdict per note: valid, numbers of errors and warnings, and the problems themselves.

    Required fields, options, kinds, unknown fields and the sources of relations, looked up among ``targets``
    (``name_rows``; by default the notes). Looser than the rules: text "true" and "false" passes as boolean, text with a leading number
    as number, and fields with a default are never missing.
    """
    fields = field_context(notes, schema)
    rows = fields.select("path", F.inline(_written_field()))
    links = _written_links(fields, name_rows(notes) if targets is None else targets)
    exact = F.filter("required", lambda f: ~F.array_contains("keys", f))
    gone = F.when(_c("typed"), F.transform(exact, lambda f: F.struct(
        F.lit("error").alias("severity"), F.lit("required_field_missing").alias("code"), f.alias("field"),
        F.lit(None).cast("string").alias("value")))).otherwise(F.array().cast(f"array<{WRITTEN}>"))
    strange = _written((F.coalesce("type", F.lit("")) != "") & ~_c("typed"), "invalid_type", _c("type"), F.lit("type"))
    whole = note_context(notes, schema).select("path", F.inline(F.concat(gone, strange)))
    problem = F.struct("severity", "code", "field", "value")
    found = rows.unionByName(links).unionByName(whole).groupBy("path").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.sort_array(F.collect_list(problem)).alias("problems"))
    return notes.select("path").join(found, "path", "left").select(
        "path", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"),
        (F.coalesce("errors", F.lit(0)) == 0).alias("valid"), F.coalesce("problems", F.array().cast(f"array<{WRITTEN}>")).alias("problems"))
