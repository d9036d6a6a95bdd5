"""Text search, masks, sections and links in bodies. Row-local work stays inside the row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.functions.text import FUZZY_LIMIT, FUZZY_THRESHOLD, similarity
from notegrid.session import broadcast_if_small, settle, spread

# What counts as code, and what else is not prose.
CODE = [r"(?m:^[ \t]*(```|~~~)[^\n]*\n[\s\S]*?^[ \t]*\1[^\n]*$)",
        r"(?m:^[ \t]*(?:```|~~~)[\s\S]*\z)",
        r"`[^`\n]+`"]
NO_CODE = r"\A[^`~]*\n"
NOT_PROSE = [r"\[\[[^\]]*\]\]", r"!?\[[^\]]*\]\([^)]*\)", r"(?i:\bhttps?://\S+)", r"(?i:\bwww\.\S+)"]
FILE_LINK = r"!?\[[^\]\n]*\]\(\s*([^)\s]+)[^)]*\)"
BODY_LINK = r"\[\[([^\[\]\n]*)\]\]"


def _masked(body: Column, patterns: list[str], rest: str) -> Column:
    """Blank out matches, keeping every offset and line break.

    One alternation cuts the text into consecutive pieces: matches first, then ``rest``, which
    covers everything else; matched pieces turn into blanks of the same length.
    """
    cut = "|".join([*patterns, rest])
    pieces = F.regexp_extract_all(body, F.lit(cut), F.lit(0))
    whole = "^(?:" + "|".join(patterns) + r")\z"
    return F.array_join(F.transform(pieces, lambda p: F.when(
        p.rlike(whole), F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)), "")


def code_mask(body: Column) -> Column:
    """Code blanked out. Lines before the first one with a code mark hold no code and are not cut."""
    rest = _masked(F.regexp_replace(body, NO_CODE, ""), CODE, r"\n|[^\n`]+|`")
    marked = F.contains(body, F.lit("`")) | F.contains(body, F.lit("~~~"))
    return F.when(marked, F.concat(F.regexp_extract(body, NO_CODE, 0), rest)).otherwise(body)


def prose_mask(body: Column) -> Column:
    code = code_mask(body)
    return F.when(body.rlike(r"(?i)\[|https?://|www\."),
                  _masked(code, NOT_PROSE, r"\w+|[^\w\[!]+|[\s\S]")).otherwise(code)


def lines_of(body: Column) -> Column:
    return F.split(body, r"\r?\n")


def search_lines(notes: DataFrame, query: str, regex: bool = False, context: int = 2,
                 case_sensitive: bool = False) -> DataFrame:
    """(path, line, text, before, after) per matching body line."""
    def hit(line: Column) -> Column:
        if regex:
            return line.rlike(query if case_sensitive else f"(?i){query}")
        if case_sensitive:
            return F.contains(line, F.lit(query))
        return F.contains(F.lower(line), F.lit(query.lower()))

    lines = lines_of(F.col("body"))
    found = F.filter(F.transform(lines, lambda t, i: F.struct(
        (i + 1).alias("line"), t.alias("text"))), lambda s: hit(s["text"]))
    candidates = spread(notes)
    if not regex and "\n" not in query:  # whole-body test first: most bodies drop out unsplit
        body = F.col("body") if case_sensitive else F.lower("body")
        candidates = candidates.filter(F.contains(body, F.lit(query if case_sensitive else query.lower())))
    rows = candidates.select("path", lines.alias("lines"), F.explode(found).alias("m"))
    at = F.col("m.line")
    return rows.select(
        "path", at.alias("line"), F.col("m.text").alias("text"),
        F.slice("lines", F.greatest(at - context, F.lit(1)),
                F.least(at - 1, F.lit(context))).alias("before"),
        F.slice("lines", at + 1, F.lit(context)).alias("after"))


def search_rank(matches: DataFrame, limit: int = 100) -> DataFrame:
    """Files by number of matching lines, then path, cut at ``limit``."""
    return matches.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines")) \
        .orderBy(F.desc("n_lines"), "path").limit(limit)


def search_total(matches: DataFrame, limit: int = 100) -> DataFrame:
    files = matches.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return files.agg(F.count(F.lit(1)).alias("n_files"),
                     F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines")).withColumn(
        "truncated", F.col("n_files") > limit)


def fuzzy_rank(names: DataFrame, aliases: DataFrame, query: str,
               threshold: float = FUZZY_THRESHOLD, limit: int = FUZZY_LIMIT) -> DataFrame:
    """Best of name and aliases per note, best notes first; a name beats an equal alias."""
    q = F.lit(re.sub(r"\.md$", "", query).strip())
    scored = names.select("path", "name", F.lit(0).alias("rank"), F.col("name").alias("value")) \
        .unionByName(aliases.select("path", "name", F.lit(1).alias("rank"),
                                    F.col("alias").alias("value"))) \
        .withColumn("score", similarity(q, F.col("value"))).filter(F.col("score") >= threshold)
    best = scored.groupBy("path", "name").agg(F.max_by(
        F.struct("score", "rank", "value"), F.struct(F.col("score"), -F.col("rank"))).alias("b"))
    return best.select("path", "name", F.col("b.score").alias("score"),
                       F.when(F.col("b.rank") == 0, "name").otherwise("alias").alias("matched"),
                       F.col("b.value").alias("value"), F.col("b.rank").alias("rank")) \
        .orderBy(F.desc("score"), "rank", "name", "path").limit(limit).drop("rank")


# ---------------------------------------------------------------- sections

def heading_pattern(level: int | None, title: str) -> str:
    marks = "#{1,6}" if level is None else "#" * level
    return rf"(?m)^[ \t]*{marks} {re.escape(title)}[ \t]*#*[ \t]*$"


def section_check(notes: DataFrame, sections: dict[str, list[tuple[int, str]]]) -> DataFrame:
    """(path, level, title, wrong_level): declared headings a typed note lacks."""
    checks = [F.when((F.col("type") == t) & ~F.col("masked").rlike(heading_pattern(level, title)),
                     F.struct(F.lit(level).alias("level"), F.lit(title).alias("title"),
                              F.col("masked").rlike(heading_pattern(None, title))
                              .alias("wrong_level")))
              for t, declared in sections.items() for level, title in declared]
    rows = spread(notes.filter(F.col("type").isin(list(sections)))).select(
        "path", "type", prose_mask(F.col("body")).alias("masked"))
    return rows.select("path", F.explode(F.array_compact(F.array(*checks))).alias("s")) \
        .select("path", "s.level", "s.title", "s.wrong_level")


def _section_span(lines: Column, title: str) -> tuple[Column, Column]:
    """1-based line of the first heading with the title (0: none) and of the next other heading
    after it (one past the end: none)."""
    own = rf"(?i)^#{{1,6}}\s+{re.escape(title)}\s*$"
    numbered = F.transform(lines, lambda t, i: F.struct((i + 1).alias("i"), t.alias("t")))
    start = F.coalesce(F.get(F.filter(numbered, lambda s: s["t"].rlike(own)), 0)["i"], F.lit(0))
    stop = F.get(F.filter(numbered, lambda s: (s["i"] > start) & s["t"].rlike(r"^#{1,6}\s+")
                          & ~s["t"].rlike(own)), 0)["i"]
    return start, F.coalesce(stop, F.size(lines) + 1)


# How items of each kind are written.
ITEM = {"checkboxes": (r"(?i)^-\s*\[[ x]\]\s*(.+)$", "- [ ] "), "bullets": (r"^-\s+(.+)$", "- "),
        "lines": (r"^(.+)$", "")}


def section_items(body: Column, title: str, kind: str = "checkboxes") -> Column:
    """Items under the first heading with the title: check boxes, bullets or non-empty lines."""
    lines = F.split(body, "\n")
    start, stop = _section_span(lines, title)
    own = rf"(?i)^#{{1,6}}\s+{re.escape(title)}\s*$"
    inside = F.slice(lines, start + 1, F.greatest(stop - start - 1, F.lit(0)))
    texts = F.transform(F.filter(inside, lambda t: ~t.rlike(own)), lambda t: F.regexp_extract(
        F.trim(t), ITEM[kind][0], 1))
    return F.when(start > 0, F.filter(texts, lambda t: t != "")).otherwise(
        F.array().cast("array<string>"))


def section_append(body: Column, title: str, items: Column, kind: str = "checkboxes",
                   level: int = 2, create: bool = True) -> Column:
    """Add item lines at the end of a section; a missing section is added with its heading."""
    lines = F.split(body, "\n")
    start, stop = _section_span(lines, title)
    written = F.transform(items, lambda x: F.concat(F.lit(ITEM[kind][1]), x))
    inserted = F.concat(F.slice(lines, F.lit(1), stop - 1), written,
                        F.slice(lines, stop, F.size(lines)))
    fresh = F.concat(F.rtrim(body), F.lit("\n\n" + "#" * level + f" {title}\n"),
                     F.array_join(written, "\n"))
    return F.when(start > 0, F.array_join(inserted, "\n")).otherwise(fresh if create else body)


# ---------------------------------------------------------------- links in bodies

def _masked_lines(notes: DataFrame, mark: str) -> DataFrame:
    """(path, folder, line, text) of the lines outside code that hold the mark; others never become rows."""
    lines = F.transform(F.split(code_mask(F.col("body")), "\n"), lambda t, i: F.when(
        F.contains(t, F.lit(mark)), F.struct((i + 1).alias("line"), t.alias("text"))))
    marked = notes.filter(F.contains("body", F.lit(mark)))
    return spread(marked).select("path", "folder", F.explode(F.array_compact(lines)).alias("l")).select(
        "path", "folder", "l.line", "l.text")


def malformed_body_wikilinks(notes: DataFrame) -> DataFrame:
    """(path, line, value, reason): empty targets and unclosed brackets outside code."""
    lines = _masked_lines(notes, "[[")
    inner = F.regexp_extract_all("text", F.lit(BODY_LINK), F.lit(1))
    empty = lines.select("path", "line", F.explode(inner).alias("inner")).filter(
        F.trim(F.regexp_extract("inner", r"^([^|#]*)", 1)) == "").select(
        "path", "line", F.concat(F.lit("[["), "inner", F.lit("]]")).alias("value"),
        F.lit("empty-target").alias("reason"))
    rest = F.regexp_replace("text", BODY_LINK, "")
    unclosed = lines.select("path", "line", F.explode(F.regexp_extract_all(
        rest, F.lit(r"(\[\[)(?![^\n]*\]\])"), F.lit(1))).alias("value")).select(
        "path", "line", "value", F.lit("unclosed").alias("reason"))
    return empty.unionByName(unclosed)


def body_wikilinks(notes: DataFrame) -> DataFrame:
    """(path, line, value, target) of well-formed wikilinks outside code."""
    lines = _masked_lines(notes, "[[")
    rows = lines.select("path", "line", F.explode(F.regexp_extract_all(
        "text", F.lit(BODY_LINK), F.lit(1))).alias("inner"))
    return rows.select("path", "line", F.concat(F.lit("[["), "inner", F.lit("]]")).alias("value"),
                       F.trim(F.regexp_extract("inner", r"^([^|#]*)", 1)).alias("target")) \
        .filter("target <> ''")


def broken_body_wikilinks(notes: DataFrame, targets: DataFrame) -> DataFrame:
    """Body links that resolve to no note.

    Bodies are cut once. Only the distinct link texts meet the names, and only the dead ones the links again, so a text
    that every body links to is one row; each side is broadcast where it is small by measure.
    """
    links = settle(body_wikilinks(notes))
    asked = broadcast_if_small(links.select(F.lower("target").alias("key")).distinct())
    known = targets.select("key").join(asked, "key", "left_semi").distinct()
    dead = broadcast_if_small(asked.join(known, "key", "left_anti"))
    return links.join(dead, F.lower("target") == F.col("key"), "left_semi")


def _decoded(c: Column) -> Column:
    """Percent escapes decoded; a malformed escape leaves the text as written."""
    plain = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plain), c)


def resolve_relative(folder: Column, target: Column) -> Column:
    """Corpus path of a relative or root-relative target with ``.`` and ``..`` worked out."""
    full = F.when(F.startswith(target, F.lit("/")), F.substr(target, F.lit(2), F.length(target))) \
        .otherwise(F.concat_ws("/", folder, target))
    steps = F.filter(F.split(full, "/"), lambda s: ~s.isin("", "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
        F.concat(acc, F.array(s))))
    return F.array_join(walked, "/")


def broken_body_file_links(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, value, is_image): relative file links whose target is not in ``files(file)``."""
    lines = _masked_lines(notes, "](")
    rows = lines.select("path", "folder", "line", F.explode(F.regexp_extract_all(
        "text", F.lit(f"({FILE_LINK})"), F.lit(1))).alias("link"))
    dest = F.regexp_extract("link", FILE_LINK, 1)
    rows = rows.withColumn("value", dest).withColumn("decoded", _decoded(dest))
    own = F.regexp_extract("decoded", r"^([^#]*)", 1)
    local = ~F.col("decoded").rlike(r"(?i)^(#|//|[a-z][a-z0-9+.-]*:)") & (own != "")
    asked = rows.filter(local).withColumn("file", resolve_relative(F.col("folder"), own))
    return asked.join(files.select("file").distinct(), "file", "left_anti").select(
        "path", "line", "value", F.startswith("link", F.lit("!")).alias("is_image"))
