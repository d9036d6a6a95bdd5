"""One audit plan: only the contexts some asked-for rule needs are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegrid.operators import hierarchy as H
from notegrid.operators import lineage as N
from notegrid.operators import mentions as M
from notegrid.operators import relative as RD
from notegrid.operators import resolve as R
from notegrid.operators import rules as Q
from notegrid.operators import search as T
from notegrid.operators import workflow as W
from notegrid.sources.notes import structural_issues
from notegrid.types import TypeSchema

BODY = ["missing-body-section", "malformed-body-wikilink", "broken-body-wikilink", "broken-body-file-link"]
OPTIONAL = ["unlinked-mention", "frequent-unlinked-term"]
FIELDS = ["path", "code", "severity", "field", "value", "list_index", "expected", "suggestion", "auto_fixable"]


def as_issues(rows: DataFrame, code: str, *, value="value", line=None, expected=None, suggestion=None,
              fix=False, path="path", severity="warning") -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
    auto = F.lit(fix) if isinstance(fix, bool) else fix
    where = F.lit(None) if path is None else F.col(path)
    return rows.select(where.cast("string").alias("path"), F.lit(code).alias("code"),
                       F.lit(severity).alias("severity"), F.lit(None).cast("string").alias("field"),
                       text(value).alias("value"),
                       (F.lit(None) if line is None else F.col(line)).cast("int").alias("list_index"),
                       text(expected).alias("expected"), text(suggestion).alias("suggestion"),
                       auto.alias("auto_fixable"))


def body_issues(notes: DataFrame, codes: list[str], targets: DataFrame, files: DataFrame,
                sections: dict | None = None) -> list[DataFrame]:
    """Body rules; ``list_index`` carries the line number."""
    out = []
    if "missing-body-section" in codes and sections:
        out.append(as_issues(T.section_check(notes, sections), "missing-body-section", value="title",
                             expected="level", fix=True))
    if "malformed-body-wikilink" in codes:
        out.append(as_issues(T.malformed_body_wikilinks(notes), "malformed-body-wikilink", line="line",
                             expected="reason"))
    if "broken-body-wikilink" in codes:
        out.append(as_issues(T.broken_body_wikilinks(notes, targets), "broken-body-wikilink", line="line",
                             expected="target"))
    if "broken-body-file-link" in codes:
        out.append(as_issues(T.broken_body_file_links(notes, files), "broken-body-file-link", line="line"))
    return out


def mention_issues(notes: DataFrame, known: DataFrame, codes: list[str], fuzzy: bool = True,
                   terms: int | None = None) -> list[DataFrame]:
    out = []
    if "unlinked-mention" in codes:
        found = M.mentions(notes, known)
        out.append(as_issues(found, "unlinked-mention", value="text", line="line", expected="tier",
                             suggestion="canonical", fix=F.col("tier") == "exact"))
        if fuzzy:
            near = M.mentions_fuzzy(notes, known)
            top = near.groupBy("path", "line", "phrase").agg(F.min_by("name", "rank").alias("name")) \
                .withColumn("tier", F.lit("fuzzy"))
            out.append(as_issues(top, "unlinked-mention", value="phrase", line="line", expected="tier",
                                 suggestion="name"))
    if "frequent-unlinked-term" in codes:
        out.append(as_issues(M.frequent_terms(notes, known, top=terms), "frequent-unlinked-term", value="term",
                             line="mentions", path=None))
    return out


def _plain(rows: DataFrame, code: str, severity: str, **how) -> DataFrame:
    """Issues of one code from (path, ...) rows; further names as in ``as_issues``."""
    return as_issues(rows, code, severity=severity, **{"value": None, **how})


def _named(rows: DataFrame, codes: list[str], severity: str, value: str | None = None) -> DataFrame:
    """Issues from rows that carry their own code; only the wanted ones."""
    none = F.lit(None).cast("string")
    return rows.filter(F.col("code").isin(codes)).select(
        F.col("path").cast("string").alias("path"), "code", F.lit(severity).alias("severity"), none.alias("field"),
        (none if value is None else F.col(value).cast("string")).alias("value"), F.lit(None).cast("int").alias("list_index"),
        none.alias("expected"), none.alias("suggestion"), F.lit(False).alias("auto_fixable"))


def is_root(notes: DataFrame, links: DataFrame, schema: TypeSchema) -> DataFrame:
    """(path) of notes that no parent-like field of theirs puts below another note."""
    parent_like = [(n, f) for n in schema.fields for f in schema.parent_like_fields(n)]
    dim = F.broadcast(notes.sparkSession.createDataFrame(parent_like, "src_type string, field string"))
    held = links.join(dim, ["src_type", "field"], "left_semi").filter(F.col("raw").isNotNull())
    return notes.join(held.select(F.col("src_path").alias("path")), "path", "left_anti").select("path")


def ownership_issues(notes: DataFrame, resolved: DataFrame, schema: TypeSchema, codes: list[str]) -> list[DataFrame]:
    """owned-ambiguous-owner, owned-wrong-location and owned-note-referenced over resolved links."""
    owned = [f for fields in schema.fields.values() for f, d in fields.items() if d.get("owned")]
    if not owned:
        return []
    claims = R.owner_index(notes, resolved.filter(F.col("field").isin(owned)), schema)
    counts = R.owner_counts(claims)
    out = []
    if "owned-ambiguous-owner" in codes:
        out.append(_plain(counts.filter("n_owners > 1"), "owned-ambiguous-owner", "error", value="n_owners"))
    if "owned-wrong-location" in codes:
        single = counts.filter("n_owners = 1").join(claims.groupBy("path").agg(F.min("field").alias("owned_by")), "path")
        expected = F.concat(F.regexp_replace("owner_path", r"/[^/]*$", ""), F.lit("/"), "owned_by")
        away = (single.join(notes.select("path", "folder"), "path").withColumn("place", expected)
                .filter("folder <> place"))
        out.append(_plain(away, "owned-wrong-location", "error", value="folder", expected="place"))
    if "owned-note-referenced" in codes:
        links = R.may_reference(resolved.filter(F.col("resolved_path").isNotNull()), claims)
        out.append(_plain(links, "owned-note-referenced", "warning", value="resolved_path", path="src_path"))
    return out


LINKED = [*Q.LINK_RULES, "owned-ambiguous-owner", "owned-wrong-location", "owned-note-referenced", "parent-cycle"]
STRUCTURE = ["frontmatter-not-at-top", "duplicate-frontmatter-keys", "trailing-whitespace"]
LINEAGE = ["duplicate-note-id", "invalid-forked-from", "missing-lineage-id", "dangling-forked-from", "fork-cycle"]
RECURRENCE = ["missing-successor", "invalid-recurrence"]
RELATIVE = ["relative-date-cycle", "relative-date-unanchored", "relative-date-invalid-ref", "relative-date-invalid-offset",
            "relative-date-contradiction", "relative-date-bound-violation"]
IDS = ["missing-note-id", "invalid-note-id"]


def audit(notes: DataFrame, schema: TypeSchema, asof: str, *, only: list[str] | None = None,
          ignore: list[str] | None = None, links: DataFrame | None = None, names: DataFrame | None = None,
          aliases: DataFrame | None = None, files: DataFrame | None = None,
          sections: dict | None = None, fuzzy: bool = False, recurrence: dict | None = None,
          relative: tuple[DataFrame, DataFrame] | None = None, terms: int | None = None) -> DataFrame:
    """Issues of a corpus, of every rule or of those named in ``only``.

    What a rule reads must be there: ``links`` (raw relation links: src_path, src_type, field, raw) for
    link, ownership and cycle rules, with ``names`` (path, name, type) to resolve against; a ``body``
    column for body rules and ``sections`` for missing sections; a ``raw`` column for the structure
    of headers; ``recurrence`` (trigger_field, trigger_value, base) for successors; ``relative``
    (constraints, anchors) for relative dates. A rule named in ``only`` without its input is an error;
    without ``only`` the rules whose inputs are given run. Mentions, frequent terms (the first ``terms``,
    all if None) and ids run only when named.
    """
    skip = set(ignore or [])
    own = [c for c in Q.note_rules(schema, asof) if c != "note-id"]
    needs = {"links": (LINKED, links is not None), "a body column": ([c for c in BODY if c != "missing-body-section"] + OPTIONAL, "body" in notes.columns),
             "a body column and sections": (["missing-body-section"], "body" in notes.columns and bool(sections)),
             "a raw column": (STRUCTURE, "raw" in notes.columns), "recurrence": (RECURRENCE, recurrence is not None),
             "relative": (RELATIVE, relative is not None)}
    every = [*Q.FIELD_RULES, *own, *IDS, "note-id", *LINEAGE, *(c for codes, _ in needs.values() for c in codes)]
    lacking = {c: what for what, (codes, there) in needs.items() if not there for c in codes}
    asked = only if only is not None else [c for c in every if c not in OPTIONAL + IDS + ["note-id"] and c not in lacking]
    wanted = [c for c in asked if c not in skip]
    for c in wanted:
        if c not in every:
            raise ValueError(f"unknown issue code: {c}")
        if c in lacking:
            raise ValueError(f"{c} needs {lacking[c]}")
    parts = []
    by_field = [c for c in wanted if c in Q.FIELD_RULES]
    if by_field:
        parts.append(Q.field_issues(notes, schema, by_field))
    by_note = [c for c in wanted if c in own]
    ids = [*IDS] if "note-id" in wanted else [c for c in wanted if c in IDS]
    if by_note or ids:
        found = Q.note_issues(notes, schema, asof, by_note + (["note-id"] if ids else []))
        parts.append(found.filter(F.col("code").isin(*ids, *[c for c in own if c in by_note]) | ~F.col("code").isin(*IDS)))
    by_link = [c for c in wanted if c in LINKED]
    if by_link:
        index = R.target_index(R.name_rows(names if names is not None else notes, aliases))
        resolved = R.resolve_links(links, index, schema)
        if rules := [c for c in by_link if c in Q.LINK_RULES]:
            parts.append(Q.link_issues(resolved, rules))
        parts += ownership_issues(notes, resolved, schema, by_link)
        if "parent-cycle" in by_link:
            parts.append(_plain(H.parent_cycles(H.parent_edges(resolved)), "parent-cycle", "error", value="cycle"))
    if structure := [c for c in wanted if c in STRUCTURE]:
        parts.append(structural_issues(notes).filter(F.col("code").isin(structure)))
    if lineage := [c for c in wanted if c in LINEAGE]:
        keyed = notes.select("path", F.try_variant_get("fm", "$.id", "string").alias("id"),
                             F.try_variant_get("fm", "$['forked-from']", "string").alias("forked_from"))
        parts.append(_named(N.lineage_issues(keyed), lineage, "error", "value"))
    if again := [c for c in wanted if c in RECURRENCE]:
        text = lambda f: F.try_variant_get("fm", f"$['{f}']", "string").alias(f)
        held = notes.select("path", *{f: text(f) for f in (recurrence["trigger_field"], recurrence["base"], "next")}.values())
        parts.append(_named(W.recurrence_issues(held, **recurrence), again, "warning"))
    if dated := [c for c in wanted if c in RELATIVE]:
        constraints, anchors = relative
        rows = RD.relative_date_issues(constraints, anchors, RD.relative_dates(constraints, anchors))
        parts.append(_named(rows.withColumnRenamed("node", "path"), dated, "warning"))
    if any(c in BODY + OPTIONAL for c in wanted):
        targets = R.build_targets(names if names is not None else notes, aliases)
        listing = files if files is not None else notes.select(F.concat("path", F.lit(".md")).alias("file"))
        parts += body_issues(notes, wanted, targets, listing, sections)
        if any(c in OPTIONAL for c in wanted):
            known = M.surfaces(names if names is not None else notes, aliases)
            parts += mention_issues(notes, known, wanted, fuzzy, terms)
    if not parts:
        return notes.sparkSession.createDataFrame([], ", ".join(
            f"{c} {'int' if c == 'list_index' else 'boolean' if c == 'auto_fixable' else 'string'}" for c in FIELDS))
    return reduce(DataFrame.unionByName, [p.select(*FIELDS) for p in parts])
