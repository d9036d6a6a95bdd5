"""Links in bodies with their places: backlinks per link, and bodies rewritten after moves.

One scan cuts a body at code and links, whichever begins first, so a link inside code is told from a
link in prose without masking the text. What lies between the cuts travels as two numbers (length
and line breaks); a running sum over them gives every offset and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrid.operators.search import CODE, _decoded, resolve_relative
from notegrid.session import spread

# A wikilink with optional heading and text, a Markdown link to a note.
WIKI = r"\[\[[^\[\]|#\n]+(?:#[^\[\]|\n]*)?(?:\|[^\[\]\n]+)?\]\]"
MARKDOWN = r"!?\[[^\[\]\n]*\]\([^()\s]+\.md(?:#[^()\s]*)?\)"
LINKS = f"{WIKI}|{MARKDOWN}"
CUT = "|".join([*CODE, LINKS])


def _has_links(body: Column) -> Column:
    return F.contains(body, F.lit("[[")) | F.contains(body, F.lit("]("))


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _cut(texts: DataFrame, pattern: str) -> DataFrame:
    """One row per match of ``pattern``: what ``texts`` holds but the text, i, start (from 0), line, piece.

    ``texts`` has src_path, text, base_start and base_line; (src_path, base_start) tells texts apart.
    """
    keep = [c for c in texts.columns if c != "text"]
    gaps = F.transform(F.split("text", pattern, -1), lambda g: F.struct(
        F.length(g).alias("chars"), _breaks(g).alias("breaks")))
    pieces = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)) if pattern is LINKS \
        else F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    rows = texts.select(*keep, gaps.alias("gaps"), pieces.alias("pieces")).select(
        *keep, "gaps", F.posexplode("pieces").alias("i", "piece"))
    rows = rows.select(*keep, "i", "piece", F.get("gaps", F.col("i")).alias("gap"))
    before = Window.partitionBy("src_path", "base_start").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    chars = F.sum(F.col("gap.chars") + F.length("piece")).over(before) - F.length("piece")
    lines = F.sum(F.col("gap.breaks") + _breaks(F.col("piece"))).over(before) - _breaks(F.col("piece"))
    return rows.select(*keep, "i", "piece", (F.col("base_start") + chars).alias("start"),
                       (F.col("base_line") + lines).cast("int").alias("line"))


def body_links(notes: DataFrame) -> DataFrame:
    """(src_path, line, start, length, in_code, form, raw, target) of every link in a body.

    ``start`` counts characters from 0, ``line`` from 1. ``target`` is a note's name, path or end of a
    path; that of a Markdown link is worked out from the folder of its note. Needs path, folder, body;
    a null body has no links.
    """
    texts = spread(notes.filter(_has_links(F.col("body")))).select(
        F.col("path").alias("src_path"), "folder", F.col("body").alias("text"),
        F.lit(0).cast("bigint").alias("base_start"), F.lit(1).alias("base_line"))
    found = _cut(texts, CUT)
    link = F.startswith("piece", F.lit("[")) | F.startswith("piece", F.lit("!["))
    prose = found.filter(link).withColumn("in_code", F.lit(False))
    code = found.filter(~link & _has_links(F.col("piece"))).select(
        "src_path", "folder", F.col("piece").alias("text"), F.col("start").alias("base_start"), F.col("line").alias("base_line"))
    rows = prose.unionByName(_cut(code, LINKS).withColumn("in_code", F.lit(True)))
    wiki = F.startswith("piece", F.lit("[["))
    aim = F.regexp_replace(F.trim(F.regexp_extract("piece", r"^\[\[([^|#\]]*)", 1)), r"\.md$", "")
    inner = _decoded(F.regexp_extract("piece", r"\]\(([^()\s]+)\.md(?:#[^()\s]*)?\)$", 1))
    return rows.select("src_path", "line", "start", F.length("piece").alias("length"), "in_code",
                       F.when(wiki, "wikilink").otherwise("markdown").alias("form"), F.col("piece").alias("raw"),
                       F.when(wiki, aim).otherwise(resolve_relative(F.col("folder"), inner)).alias("target"))


def path_ends(notes: DataFrame) -> DataFrame:
    """(key, n, first, last): every ending of a path at a folder border, with how many notes have it.

    ``first`` and ``last`` are the ends of (longer, path) order, so a key that is a whole path names
    that note first. A key is one row however many notes share it.
    """
    steps = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(
        F.array_join(F.slice(steps, k, F.size(steps)), "/").alias("key"), (k > 1).alias("longer")))
    rows = notes.select("path", F.explode(ends).alias("e"))
    note = F.struct(F.col("e.longer").alias("longer"), F.col("path").alias("path"))
    return rows.groupBy("e.key").agg(F.count(F.lit(1)).alias("n"), F.min(note).alias("first"), F.max(note).alias("last"))


def backlink_rows(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, n_notes, src_path, line, start, length, in_code, form, raw): links that refer to one of ``notes``.

    A wikilink refers to a note by its name, its path or the end of its path, a Markdown link by its
    path; case counts. A link of a note to itself is none. One that fits several notes is one row
    with their number, and the note in ``path`` whose path it spells, else the first in path order.
    """
    own = (F.col("src_path") == F.col("target")) | F.endswith("src_path", F.concat(F.lit("/"), "target"))
    # Whether the source is among ``notes`` itself decides if it counts among those that fit.
    sources = notes.select(F.col("path").alias("src_path")).distinct().withColumn("listed", F.lit(True))
    hit = links.join(path_ends(notes), F.col("target") == F.col("key"))
    hit = hit.filter((F.col("form") == "wikilink") | ~F.col("first.longer")).join(sources, "src_path", "left")
    itself = own & F.coalesce("listed", F.lit(False))
    whole = F.col("form") == "markdown"
    others = F.when(whole, F.lit(1)).otherwise(F.col("n")) - itself.cast("int")
    path = F.when(itself & (F.col("first.path") == F.col("src_path")), F.col("last.path")).otherwise(F.col("first.path"))
    return hit.select(path.alias("path"), others.cast("bigint").alias("n_notes"), "src_path", "line", "start", "length",
                      "in_code", "form", "raw").filter("n_notes > 0")


def body_rewrites(links: DataFrame, moves: DataFrame, notes: DataFrame) -> DataFrame:
    """(src_path, start, raw, new_raw): wikilinks outside code that refer to a moved note, by its new name.

    ``moves`` come from ``bulk_move``. The new target is the bare name where one note alone will have
    it, else the path; heading and text stay.
    """
    done = moves.filter("error IS NULL").select("path", "new_path", F.element_at(F.split("new_path", "/"), -1).alias("new_name"))
    after = notes.select("path", "name").join(done, "path", "left").groupBy(F.coalesce("new_name", "name").alias("new_name")) \
        .agg(F.count(F.lit(1)).alias("same"))
    aims = done.join(after, "new_name").select("path", F.when(F.col("same") == 1, F.col("new_name"))
                                               .otherwise(F.col("new_path")).alias("aim"))
    hit = backlink_rows(links.filter("form = 'wikilink' AND NOT in_code"), done.select("path")).join(aims, "path")
    rest = F.regexp_extract("raw", r"^\[\[[^|#\]]*([^\]]*)\]\]$", 1)
    return hit.withColumn("new_raw", F.concat(F.lit("[["), "aim", rest, F.lit("]]"))).filter("raw <> new_raw") \
        .select("src_path", "start", "raw", "new_raw")


def rewrite_bodies(notes: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(path, body) of the notes with rewrites (src_path, start, raw, new_raw), each put in at its place.

    A body is cut once more at code and links, and its pieces are replaced by number, so the cost is
    linear in the body and in its links, and what is written is no input of another rewrite.
    """
    edits = rewrites.groupBy("src_path", "start").agg(F.min("new_raw").alias("new_raw"))
    asked = edits.select(F.col("src_path").alias("path")).distinct()
    touched = notes.select("path", "body").join(asked, "path", "left_semi")
    places = _cut(touched.select(F.col("path").alias("src_path"), F.col("body").alias("text"),
                                 F.lit(0).cast("bigint").alias("base_start"), F.lit(1).alias("base_line")), CUT)
    places = places.select("src_path", "i", "start").join(edits, ["src_path", "start"], "left")
    fresh = places.groupBy(F.col("src_path").alias("path")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "new_raw"))), lambda e: e["new_raw"]).alias("fresh"))
    gaps = F.split("body", CUT, -1)
    pieces = F.zip_with(F.regexp_extract_all("body", F.lit(CUT), F.lit(0)), "fresh", lambda old, new: F.coalesce(new, old))
    text = F.zip_with(gaps, pieces, lambda g, p: F.concat(g, F.coalesce(p, F.lit(""))))
    return touched.join(fresh, "path").select("path", F.array_join(text, "").alias("body"))
