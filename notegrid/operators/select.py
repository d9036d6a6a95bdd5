"""Row selection. Selectors return boolean Columns or filtered DataFrames and compose by AND."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.types import TypeSchema


def type_is(schema: TypeSchema, name: str, column: str = "type") -> Column:
    return F.col(column).isin(schema.family(name))


def select_type(df: DataFrame, schema: TypeSchema, name: str) -> DataFrame:
    return df.filter(type_is(schema, name))


def glob_regex(glob: str) -> str:
    """``*`` stays inside a folder, ``**`` crosses folders, ``?`` is one character."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "".join(out)


def path_like(glob: str, path: str = "path") -> Column:
    """Case-insensitive; a bare pattern matches base names too; a folder means all below it."""
    c = F.col(path)
    bare = re.sub(r"/(\*\*)?$", "", glob)
    if not re.search(r"[*?]", bare):
        below = F.startswith(F.lower(c), F.lit(bare.lower() + "/"))
        exact = F.lower(c) == bare.lower()
        if glob != bare:
            return below
        if "/" not in bare:
            exact = exact | F.endswith(F.lower(c), F.lit("/" + bare.lower()))
        return below | exact
    body = glob_regex(glob)
    lead = "" if "/" in glob else "(?:.*/)?"
    return c.rlike(f"(?i)^{lead}{body}$")


def select_path(df: DataFrame, glob: str) -> DataFrame:
    return df.filter(path_like(glob))


def path_like_audit(text: str, path: str = "path") -> Column:
    """Plain text means substring; only glob characters make it a pattern."""
    if re.search(r"[*?]", text):
        return path_like(text, path)
    return F.contains(F.col(path), F.lit(text))


def select_id(df: DataFrame, wanted: str) -> DataFrame:
    """Rows with the id plus how many there are: 1 is a hit, 0 missing, more is an error."""
    hits = df.filter(F.lower("id") == wanted.lower())
    return hits.agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).select(
        F.lit(wanted).alias("id"), "n", F.when(F.col("n") == 1, F.col("path")).alias("path"),
        F.when(F.col("n") == 0, "not-found").when(F.col("n") > 1, "duplicate")
        .otherwise("ok").alias("status"))


def body_contains(query: str, body: str = "body") -> Column:
    """Literal, case-insensitive; a match never spans a line break because the query has none."""
    if "\n" in query:
        return F.lit(False)
    return F.contains(F.lower(F.col(body)), F.lit(query.lower()))


def select_all_of(df: DataFrame, schema: TypeSchema, *, type_name: str | None = None,
                  path: str | None = None, body: str | None = None, note_id: str | None = None,
                  where: Column | str | None = None) -> DataFrame:
    """All given selectors together, cheap ones first."""
    if type_name is not None:
        df = select_type(df, schema, type_name)
    if path is not None:
        df = select_path(df, path)
    if body is not None:
        df = df.filter(body_contains(body))
    if note_id is not None:
        df = df.filter(F.lower("id") == note_id.lower())
    if where is not None:
        df = df.filter(where)
    return df


def source_filter(condition: dict[str, dict], columns: dict[str, Column] | None = None) -> Column:
    """``{field: {equals|not_equals|in|not_in: value}}`` on the text form; missing is ''.

    Written as plain comparisons with explicit null tests, so the scan can use them.
    """
    test = F.lit(True)
    for field, rule in condition.items():
        value = (columns or {}).get(field, F.col(field)).cast("string")
        for op, operand in rule.items():
            if op not in ("equals", "in", "not_equals", "not_in"):
                raise ValueError(f"unknown filter operator: {op}")
            wanted = [operand] if op in ("equals", "not_equals") else list(operand)
            hit = value.isin(wanted)
            if op in ("equals", "in"):
                test = test & (hit | value.isNull() if "" in wanted else hit)
            else:
                test = test & (~hit & value.isNotNull() if "" in wanted else ~hit | value.isNull())
    return test


def retention_condition(condition: dict[str, list[str]]) -> Column:
    """All fields hold one of their values; as a filter, a missing field does not match."""
    test = F.lit(True)
    for field, values in condition.items():
        test = test & F.col(field).isin(values)
    return test


def only_issue(issues: DataFrame, code: str) -> DataFrame:
    return issues.filter(F.col("code") == code)


def ignore_issue(issues: DataFrame, code: str) -> DataFrame:
    return issues.filter(F.col("code") != code)
