"""Unlinked mentions of known names, near misses and frequent unknown terms.

Text meets names by equality: every body becomes word runs of just the lengths that names have,
starting at words that names start with, and the runs hash-join an index with one row per name. Work is linear in the text and
does not grow with the number of names. Names without an ASCII word character are looked for in what
stands between words, at the character pairs and in the lengths such names have. Names shared by many notes are counted in the index,
so a popular alias costs one row; the candidates of ambiguous mentions are listed once per mentioned text, when they are asked for.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegrid.operators.search import prose_mask
from notegrid.session import BROADCAST_BYTES, broadcast_if_small, settle, spread

# Shortest name looked for; damping thresholds; near-miss limits; term limits.
MIN_SURFACE = 3
DAMP_NOTES, DAMP_SHARE = 3, 0.5
FUZZY_CAP, FUZZY_MIN, FUZZY_TOP = 2, 4, 3
TERM_MENTIONS, TERM_NOTES, TERM_LETTERS, TERM_TOP = 4, 2, 4, 25
# Headings that are structure, not names.
STRUCTURAL_HEADINGS = ["backlinks", "context", "ideas", "links", "notes", "references", "related",
                       "resources", "summary", "tasks", "todo", "todos"]
# Capitalised words that are no terms.
STOP_WORDS = """
monday tuesday wednesday thursday friday saturday sunday
january february march april may june july august september october november december
the a an and but or so then this that these those there here it its we i you he she they
my our your his her their me us them
today tomorrow yesterday now later soon
when where what who why how which
if as at by for from in into of on to up with about after before over under
yes no not maybe okay ok
one two three first second next last
do did done got get let also just still really
""".split()
# Places where a capital says nothing (list, quote, heading and sentence starts).
LINE_MARKER = r"^[ \t]{0,3}(?:>[ \t]*)*(?:(?:[-*+]|[0-9]{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?|#{1,6}[ \t]+)?$"
SENTENCE_END = r"""[.!?][\])}"'’”»]*[ \t\r\n]*$"""
WORD = r"[\p{L}\p{N}][\p{L}\p{N}_'-]*"

GRAMS = "path string, start int, end int, line int, cold boolean, text string, before string, after string"
GRAM_ROWS = 20_000  # word runs that leave a worker at once
# Most first words, and their total length, that still travel to every task as a set.
FIRST_WORDS, FIRST_BYTES = 200_000, 8 << 20


def gram_finder(lengths: list[int], firsts=None, wordless: list[int] = (), starts=None):
    """Arrow-batched helper over (path, body, masked): the word runs of the masked text that could be a name.

    A worker holds the runs of one body, and of ``GRAM_ROWS``, never those of a batch. Per run: offsets, line, the text up to its neighbours, and whether a capital there carries no
    signal. ``firsts`` is a broadcast set of the words names begin with; without it every word
    may begin one. ``wordless`` are the lengths of names without a word character, ``starts`` a
    broadcast set of the lower-cased character pairs they begin with.
    """
    import re
    word, marker = re.compile(r"[A-Za-z0-9_']+"), re.compile(LINE_MARKER)
    ended = re.compile(SENTENCE_END)

    def cold(body: str, line_start: int, at: int) -> bool:
        before = body[line_start:at]
        if not before.strip(" \t") or marker.match(before):
            return True
        tail = at
        while tail > 0 and body[tail - 1] in " \t\r\n":
            tail -= 1
        while tail > 0 and body[tail - 1] in "])}\"'’”»":
            tail -= 1
        return bool(ended.search(body[max(tail - 1, 0):at]))

    def one(body: str, masked: str, wanted) -> list:
        spans = [m.span() for m in word.finditer(masked)]
        out, line, seen = [], 1, 0
        for i, (s, e) in enumerate(spans):
            if wanted is not None and masked[s:e].lower() not in wanted:
                continue
            line += masked.count("\n", seen, s)
            seen = s
            quiet = masked[s].isupper() and cold(body, masked.rfind("\n", 0, s) + 1, s)
            before = masked[spans[i - 1][1]:s] if i else None
            for n in lengths:
                if i + n > len(spans):
                    break
                end = spans[i + n - 1][1]
                after = spans[i + n][0] if i + n < len(spans) else len(masked)
                out.append((s, end, line, quiet, masked[s:end], before, masked[end:after]))
        if wordless:
            out.extend(between(body, masked, spans))
        return out

    def between(body: str, masked: str, spans: list):
        pairs, line, seen, last = None if starts is None else starts.value, 1, 0, len(masked)
        edges = [0, *(x for span in spans for x in span), last]
        for left, right in zip(edges[::2], edges[1::2]):
            end = right - (right < last)  # no word character may stand next to the name
            for s in range(left + (left > 0), end - wordless[0] + 1):
                if masked[s] == " " or (pairs is not None and masked[s].lower() + masked[s + 1].lower() not in pairs):
                    continue
                line += masked.count("\n", seen, s)
                seen = s
                quiet = masked[s].isupper() and cold(body, masked.rfind("\n", 0, s) + 1, s)
                for n in wordless:
                    if s + n > end:
                        break
                    yield s, s + n, line, quiet, masked[s:s + n], "", ""

    def grams(batches):
        wanted, names = None if firsts is None else firsts.value, [f.split()[0] for f in GRAMS.split(", ")]
        out = []
        for batch in batches:
            for path, body, masked in zip(batch["path"], batch["body"], batch["masked"]):
                for g in one(body or "", masked or "", wanted):
                    out.append((path, *g))
                    if len(out) == GRAM_ROWS:
                        yield pd.DataFrame(out, columns=names)
                        out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return grams


def _first_words(known: DataFrame):
    """The words names begin with, as a broadcast set when they are few by measure."""
    words = settle(known.select(F.lower(F.regexp_extract("surface", r"([A-Za-z0-9_']+)", 1)).alias("w")).distinct())
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("w")).alias("b")).first()
    if size["n"] > FIRST_WORDS or (size["b"] or 0) > FIRST_BYTES:
        return None
    return known.sparkSession.sparkContext.broadcast({r["w"] for r in words.collect()})


def _core(c: Column) -> Column:
    """Name without non-word edges, which are checked apart; all of a name without word characters."""
    def in_word(x: Column) -> Column:
        return x.between("0", "9") | x.between("A", "Z") | x.between("a", "z") | x.isin("_", "'")

    core = F.regexp_extract(c, r"([A-Za-z0-9_'](?:[\s\S]*[A-Za-z0-9_'])?)", 1)
    whole = in_word(F.substring(c, 1, 1)) & in_word(F.substring(c, -1, 1))  # most names: no pattern is run
    return F.when(whole, c).when(core == "", c).otherwise(core)


def surfaces(names: DataFrame, aliases: DataFrame | None = None,
             skipped: DataFrame | None = None) -> DataFrame:
    """(surface, key, canonical, path, kind, skipped) of names and aliases of 3+ characters.

    ``skipped(path)`` are notes whose single-word name is too common to look for.
    """
    rows = names.select(F.trim("name").alias("surface"), F.col("name").alias("canonical"), "path",
                        F.lit("name").alias("kind"))
    if skipped is not None:
        common = skipped.select("path").distinct().withColumn("s", F.lit(True))
        rows = rows.join(common, "path", "left").select(
            "surface", "canonical", "path", "kind", F.coalesce("s", F.lit(False)).alias("skipped"))
    else:
        rows = rows.withColumn("skipped", F.lit(False))
    if aliases is not None:
        rows = rows.unionByName(aliases.select(
            F.trim("alias").alias("surface"), F.col("name").alias("canonical"), "path",
            F.lit("alias").alias("kind"), F.lit(False).alias("skipped")))
    return rows.filter(F.length("surface") >= MIN_SURFACE).distinct().withColumn(
        "key", F.lower("surface"))


def mention_excludes(notes: DataFrame, types: list[str], path_test: Column | None = None) -> DataFrame:
    """Flag notes that are known but must not be mention targets."""
    test = F.col("type").isin(types)
    if path_test is not None:
        test = test | path_test
    return notes.withColumn("excluded", F.coalesce(test, F.lit(False)))


def surface_forms(known: DataFrame) -> DataFrame:
    """(key, form, canonical, kind_low, kind), each canonical name of a form once.

    Single-word names only match their exact writing, so each writing is a form of its own that
    also takes in the key's aliases; form '' is everything that matches in any case.
    """
    single = ~F.col("surface").rlike(r"\s")
    exact = (F.col("kind") == "name") & single
    rows = known.filter(~F.col("skipped"))
    loose = rows.filter(~exact).withColumn("form", F.lit(""))
    strict = rows.filter(exact).withColumn("form", F.col("surface"))
    forms = strict.select("key", "form").distinct()
    joined_aliases = loose.drop("form").join(forms, "key")
    every = loose.unionByName(strict).unionByName(joined_aliases)
    return every.groupBy("key", "form", "canonical").agg(
        F.min("kind").alias("kind_low"), F.max("kind").alias("kind"))


def surface_index(known: DataFrame) -> DataFrame:
    """One row per (key, form): n canonical names, the smallest and the largest of them."""
    return surface_forms(known).groupBy("key", "form").agg(
        F.count(F.lit(1)).alias("n"), F.min("canonical").alias("low"), F.max("canonical").alias("high"),
        F.min_by("kind", "canonical").alias("low_kind"), F.max_by("kind", "canonical").alias("high_kind"))


def surface_lists(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per (key, form) of ``wanted``: all its canonical names, sorted by locale."""
    rows = surface_forms(known.join(wanted.select("key").distinct(), "key", "left_semi")).join(wanted, ["key", "form"], "left_semi")
    name = F.struct(F.collate("canonical", "UNICODE").alias("c"), F.col("canonical").alias("name"))
    return rows.groupBy("key", "form").agg(F.sort_array(F.collect_list(name)).alias("ns")).select(
        "key", "form", F.transform("ns", lambda x: x["name"]).alias("names"))


def _with_candidates(found: DataFrame, known: DataFrame) -> DataFrame:
    """Ambiguous mentions with their candidates. A list is made once per text that is mentioned and meets the mentions where they lie;
    lists too large to be broadcast are dealt out several times, so that the mentions of one text are not one task's."""
    found = settle(found)
    lists = settle(surface_lists(known, found.filter("tier = 'ambiguous'").select("key", "form").distinct()))
    size = lists.agg(F.sum(F.aggregate("names", F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    on = ["key", "form"]
    if size <= BROADCAST_BYTES:
        lists = F.broadcast(lists)
    else:
        times, on = found.sparkSession.sparkContext.defaultParallelism, [*on, "salt"]
        lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        found = found.withColumn("salt", F.pmod(F.xxhash64("path", "start"), F.lit(times)).cast("int"))
    others = F.when(F.col("self_out"), F.filter("names", lambda x: x != F.col("own"))).otherwise(F.col("names"))
    return found.join(lists, on, "left").withColumn("candidates", F.when(F.col("tier") == "ambiguous", others)).drop(*on, "names")


def _ngrams(notes: DataFrame, known: DataFrame) -> DataFrame:
    """(path, start, end, line, cold, text, before, after, core_key) of possible names."""
    find = gram_finder(_lengths(known), _first_words(known), *_wordless(known))
    rows = spread(notes.select("path", "body")).select(
        "path", "body", prose_mask(F.col("body")).alias("masked"))
    return rows.mapInPandas(find, GRAMS).withColumn("core_key", F.lower("text"))


def _lengths(known: DataFrame) -> list[int]:
    """Word counts that occur among the names: a handful of small numbers."""
    n = F.size(F.regexp_extract_all("surface", F.lit(r"([A-Za-z0-9_']+)"), F.lit(1)))
    return sorted(r[0] for r in known.select(n.alias("n")).distinct().collect() if r[0] > 0)


def _wordless(known: DataFrame):
    """Lengths of the names without word characters, and the character pairs they begin with, when few by measure."""
    rows = known.filter(~F.col("surface").rlike(r"[A-Za-z0-9_']"))
    lengths = sorted(r[0] for r in rows.select(F.explode(F.array(F.length("surface"), F.length("key"))).alias("n")).distinct().collect())
    if not lengths:
        return [], None
    pair = F.concat(F.lower(F.substring("surface", 1, 1)), F.lower(F.substring("surface", 2, 1)))
    pairs = [r[0] for r in rows.select(pair).distinct().limit(FIRST_WORDS + 1).collect()]
    return lengths, known.sparkSession.sparkContext.broadcast(set(pairs)) if len(pairs) <= FIRST_WORDS else None


def mentions(notes: DataFrame, known: DataFrame, candidates: bool = False) -> DataFrame:
    """Exact and ambiguous mentions.

    (path, line, start, end, text, tier, canonical, kind, n_targets). Longest name first, left to
    right, word-bounded, never the note itself. With ``candidates`` a column of that name holds, for ambiguous
    mentions, all names the text could stand for, sorted and without the note's own.
    """
    known = settle(known)
    keys = known.filter(~F.col("skipped")).select("key").distinct().withColumn("core_key", F.lower(_core(F.col("key")))) \
        .withColumn("lead", F.expr("substring(key, 1, instr(key, core_key) - 1)")) \
        .withColumn("tail", F.expr("substring(key, instr(key, core_key) + length(core_key))"))
    if not known.offset(FIRST_WORDS).isEmpty():  # no use measuring so many
        keys = keys.hint("merge")
    else:
        keys = broadcast_if_small(keys)
    grams = _ngrams(notes, known)
    lead_n, tail_n = F.length("lead"), F.length("tail")
    before, after = F.coalesce("before", F.lit("")), F.col("after")
    fits = F.endswith(F.lower(before), F.col("lead")) & F.startswith(F.lower(after), F.col("tail")) \
        & ((lead_n == 0) | F.col("before").isNull() | (F.length(before) > lead_n))
    hits = settle(grams.join(keys, "core_key").filter(fits).select(
        "path", (F.col("start") - lead_n).alias("start"), (F.col("end") + tail_n).alias("end"),
        "line", "cold", "text", "key",  # the edges as the text has them, not as the index folds them
        F.right(before, lead_n).alias("lead"), F.left(F.coalesce(after, F.lit("")), tail_n).alias("tail")))
    # Names are grouped only where a text has their key: what follows grows with the texts, not with the names.
    known = settle(known.join(hits.select("key").distinct(), "key", "left_semi"))
    index = settle(surface_index(known))
    chosen = _leftmost_longest(hits)
    form_hit = chosen.withColumn("whole", F.concat("lead", "text", "tail"))
    by_form = index.select("key", "form", "n", "low", "high", "low_kind", "high_kind")
    upper = F.col("whole").rlike(r"^\p{Lu}")
    single = ~F.col("whole").rlike(r"\s")
    wanted = F.when(single & ~(upper & F.col("cold")), F.col("whole")).otherwise("")
    asked = form_hit.withColumn("want", wanted)
    exact = by_form.select("key", F.col("form").alias("want"), F.struct("n", "low", "high", "low_kind", "high_kind").alias("e"))
    loose = by_form.filter("form = ''").select("key", F.struct("n", "low", "high", "low_kind", "high_kind").alias("l"))
    found = asked.join(exact, ["key", "want"], "left").join(loose, "key", "left").withColumn(
        "t", F.coalesce("e", "l")).filter(F.col("t").isNotNull()) \
        .withColumn("form", F.when(F.col("e").isNotNull(), F.col("want")).otherwise(""))
    # A note's own names: does it stand among the targets, and is it alone under its name?
    own = known.filter(~F.col("skipped")).groupBy("key", "path").agg(F.min("canonical").alias("own"))
    sharers = known.filter(~F.col("skipped")).groupBy("key", F.col("canonical").alias("own")).agg(
        F.count_distinct("path").alias("sharers"))
    own = own.join(sharers, ["key", "own"])
    judged = found.join(own, ["key", "path"], "left").withColumn(
        "self_out", F.col("own").isNotNull() & (F.coalesce("sharers", F.lit(0)) == 1)
        & ((F.col("t.n") > 1) | (F.col("own") == F.col("t.low"))))
    n = F.col("t.n") - F.col("self_out").cast("int")
    other_low = F.col("self_out") & (F.col("own") == F.col("t.low"))
    canonical = F.when(n == 1, F.when(other_low, F.col("t.high")).otherwise(F.col("t.low")))
    kind = F.when(n == 1, F.when(other_low, F.col("t.high_kind")).otherwise(F.col("t.low_kind")))
    out = judged.filter(n > 0).select(
        "path", "line", "start", "end", F.col("whole").alias("text"),
        F.when(n == 1, "exact").otherwise("ambiguous").alias("tier"), canonical.alias("canonical"),
        kind.alias("kind"), n.alias("n_targets"), "key", "form", "own", "self_out")
    return (_with_candidates(out, known) if candidates else out.drop("key", "form")).drop("own", "self_out")


def _leftmost_longest(hits: DataFrame) -> DataFrame:
    """Overlaps resolved left to right, the longest first. Only clusters of overlapping hits are
    folded; a cluster is a stretch of one text, so it stays small."""
    from pyspark.sql import Window as W
    order = W.partitionBy("path").orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = hits.withColumn("fresh", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int")) \
        .withColumn("cluster", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    row = F.struct("start", (-F.col("end")).alias("neg"), "end", "line", "cold", "text", "key",
                   "lead", "tail")
    groups = marked.groupBy("path", "cluster").agg(F.sort_array(F.collect_list(row)).alias("hs"))
    kept = F.aggregate(
        "hs", F.slice("hs", F.lit(1), F.lit(0)),
        lambda acc, h: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["end"] <= h["start"]),
                              F.concat(acc, F.array(h))).otherwise(acc))
    single = F.when(F.size("hs") == 1, F.col("hs")).otherwise(kept)
    return groups.select("path", F.explode(single).alias("h")).select("path", "h.*").drop("neg")


def mention_candidates(found: DataFrame, known: DataFrame) -> DataFrame:
    """Long form of what each ambiguous text could mean: (key, canonical)."""
    keys = found.filter("tier = 'ambiguous'").select(F.lower("text").alias("key")).distinct()
    return known.filter(~F.col("skipped")).join(keys, "key", "left_semi").select(
        "key", "canonical").distinct()


# ---------------------------------------------------------------- corpus words

def word_forms(notes: DataFrame, first: bool = False) -> DataFrame:
    """(word, form, path, n): prose words plus the words of link targets and display texts.

    Words are counted inside their row, so nothing is shuffled but paths; only notes of several rows are gathered.
    With ``first`` a column of that name is true for one form per word and note, so that notes are counted by adding.
    """
    prose = F.regexp_extract_all(prose_mask(F.col("body")), F.lit(f"({WORD})"), F.lit(1))
    inner = F.regexp_extract_all("body", F.lit(r"\[\[([^\]]*)\]\]"), F.lit(1))

    def link_text(x: Column) -> Column:
        target = F.trim(F.regexp_extract(x, r"^([^|#]*)", 1))
        base = F.regexp_replace(F.element_at(F.split(target, "/"), -1), r"\.md$", "")
        shown = F.regexp_extract(x, r"^[^|]*\|([\s\S]*)$", 1)
        return F.concat(base, F.lit(" "), shown)

    linked = F.flatten(F.transform(inner, lambda x: F.regexp_extract_all(
        link_text(F.trim(x)), F.lit(f"({WORD})"), F.lit(1))))
    rows = spread(notes).select("path", F.concat(prose, linked).alias("words"))
    several = settle(notes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("path").alias("p")))
    if not several.isEmpty():
        same = F.col("path").eqNullSafe(F.col("p"))
        several = broadcast_if_small(several)
        whole = rows.join(several, same, "left_semi").groupBy("path").agg(F.flatten(F.collect_list("words")).alias("words"))
        rows = rows.join(several, same, "left_anti").unionByName(whole)

    def at(i: Column, field: str) -> Column:
        return F.get(F.col("s"), i)[field]

    # Sorted by word and form, equal forms stand side by side: ``starts`` are the places where a form begins.
    rows = rows.select("path", F.sort_array(F.transform("words", lambda w: F.struct(F.lower(w).alias("word"), w.alias("form")))).alias("s"))
    rows = rows.select("path", "s", F.array_compact(F.transform(
        "s", lambda x, i: F.when((i == 0) | (at(i - 1, "form") != x["form"]), i))).alias("starts"))
    counted = F.transform("starts", lambda i, j: F.struct(
        at(i, "word").alias("word"), at(i, "form").alias("form"),
        (F.coalesce(F.get("starts", j + 1), F.size("s")) - i).cast("bigint").alias("n"),
        ((i == 0) | (at(i - 1, "word") != at(i, "word"))).alias("first")))
    forms = rows.select("path", F.inline(counted))
    return forms.select("word", "form", "path", "n", *(["first"] if first else []))


def common_names(names: DataFrame, forms: DataFrame, common_words: DataFrame | None = None,
                 min_notes: int = DAMP_NOTES, share: float = DAMP_SHARE) -> DataFrame:
    """Notes whose single-word name is no good target: a common word, or used in at least
    ``min_notes`` other notes mostly in another case.

    Per word and form the totals are aggregated before anything is joined, so what is shuffled is the
    vocabulary, not the text (``forms`` with the column ``first`` spare counting notes by path); a note's own use is then taken off by an
    equality join on (word, path) with the few names whose own note is there.
    """
    if "first" not in forms.columns:
        from pyspark.sql import Window as W
        forms = forms.withColumn("first", F.col("form") == F.min("form").over(W.partitionBy("word", "path")))
    single = settle(names.filter(F.col("name").rlike(rf"^{WORD}$")).select(
        "path", "name", F.lower("name").alias("word")))
    used = forms.groupBy("word", "form").agg(F.sum("n").alias("n"), F.count_if("first").alias("notes"))
    per_form = settle(used.join(single.select("word").distinct(), "word", "left_semi"))
    totals = per_form.groupBy("word").agg(F.sum("notes").alias("notes"), F.sum("n").alias("total"))
    # Names of notes that are not among the texts have no own use; only the others meet the long table.
    paths = settle(forms.select("path").distinct().join(single.select("path").distinct(), "path", "left_semi"))
    mine = broadcast_if_small(single.join(paths, "path", "left_semi").select("word", "path").distinct())
    own = forms.join(mine, ["word", "path"], "left_semi")
    own_total = own.groupBy("word", "path").agg(F.sum("n").alias("own_total"))
    own_form = own.select("word", "path", F.col("form").alias("name"), F.col("n").alias("own_form"))
    joined = single.join(totals, "word").join(
        per_form.select("word", F.col("form").alias("name"), F.col("n").alias("canon")), ["word", "name"], "left") \
        .join(own_total, ["word", "path"], "left").join(own_form, ["word", "path", "name"], "left")
    zero = F.lit(0)
    notes = F.col("notes") - F.col("own_total").isNotNull().cast("int")
    total = F.col("total") - F.coalesce("own_total", zero)
    proper = F.col("name").rlike(r"^\p{Lu}")
    canon = F.when(proper, F.coalesce("canon", zero) - F.coalesce("own_form", zero)).otherwise(0)
    damped = joined.filter((notes >= min_notes) & (total > 0) & ((total - canon) / total > share)) \
        .select("path", "name")
    if common_words is not None:
        listed = single.join(common_words.select(F.lower("word").alias("word")), "word", "left_semi")
        damped = damped.union(listed.select("path", "name")).distinct()
    return damped


def frequent_terms(notes: DataFrame, known: DataFrame, mentions_min: int = TERM_MENTIONS,
                   notes_min: int = TERM_NOTES, letters: int = TERM_LETTERS,
                   top: int | None = TERM_TOP) -> DataFrame:
    """Runs of one to three capitalised words that no note is named after.

    Counting is partial per task, then per (term, note), then per term; known names leave by an
    anti join on the counted terms, not on the text.
    """
    capital = r"[\p{Lu}\p{Lt}][\p{L}\p{M}'-]*"
    flat = F.regexp_replace(prose_mask(F.col("body")), r"[ \t]+", " ")
    marked = F.regexp_replace(flat, r"(?:\A|(?<=[\n.!?])) ?(?=[\p{Lu}\p{Lt}])", "\u0001")
    runs = F.regexp_extract_all(marked, F.lit(f"(\u0001?{capital}(?: {capital}){{0,2}})"), F.lit(1))
    rows = spread(notes).select("path", F.explode(runs).alias("run"))
    clean = F.regexp_replace(F.regexp_replace("run", "\u0001", ""), r"['-]+$", "")
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.split(clean, " ")
    keep_from = F.coalesce(F.get(F.filter(F.transform(words, lambda w, i: F.struct(
        i.alias("i"), F.array_contains(stop, F.lower(w)).alias("s"))), lambda x: ~x["s"]), 0)["i"],
        F.size(words))
    kept = F.slice(words, keep_from + 1, F.size(words))
    rows = rows.select("path", kept.alias("kept"), (keep_from > 0).alias("stripped"),
                       F.startswith("run", F.lit("\u0001")).alias("opened"))
    rows = rows.filter((F.size("kept") > 1) | (
        (F.size("kept") == 1) & (F.length(F.col("kept")[0]) >= letters)
        & ~(F.col("opened") & ~F.col("stripped")))).filter(
        F.exists("kept", lambda w: ~F.array_contains(stop, F.lower(w))))
    term = F.array_join("kept", " ")
    per_note = rows.groupBy(F.lower(term).alias("key"), "path").agg(
        F.count(F.lit(1)).alias("n"), F.min(term).alias("shown"))
    per_term = per_note.groupBy("key").agg(F.sum("n").alias("mentions"),
                                           F.count(F.lit(1)).alias("notes"),
                                           F.min("shown").alias("term"))
    open_terms = per_term.filter((F.col("mentions") >= mentions_min) & (F.col("notes") >= notes_min)) \
        .join(known.select("key").distinct(), "key", "left_anti")
    ranked = open_terms.orderBy(F.desc("mentions"), F.desc("notes"), "term")
    out = ranked if top is None else ranked.limit(top)
    return out.select("term", "mentions", "notes")


# ---------------------------------------------------------------- near misses

DELETIONS_TO = 24  # characters; beyond, deletions are many and pieces are telling


def _shared_pieces(q: DataFrame, n: DataFrame, k: int) -> DataFrame:
    """(query, name, ql, nl) that share a piece: of k + 1 equal pieces of a name, k edits leave one whole,
    and move it by k places at most. k + 1 keys for a name, some dozens for a query of any length."""
    def piece(length: Column) -> tuple[Column, Column]:
        first = F.floor(F.col("i") * length / (k + 1)).cast("int")
        return first, F.floor((F.col("i") + 1) * length / (k + 1)).cast("int") - first

    first, size = piece(F.col("len"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(k)))
    right = n.withColumn("len", F.length("nl")).withColumn("i", parts).select(
        "name", "nl", "len", "i", F.xxhash64(F.substring(F.col("nl"), first + 1, size)).alias("v"))
    left = q.withColumn("len", F.explode(F.sequence(F.length("ql") - k, F.length("ql") + k))).filter("len > 0") \
        .withColumn("i", parts).withColumn("at", F.explode(F.sequence(first - k, first + k)))
    left = left.filter((F.col("at") >= 0) & (F.col("at") + size <= F.length("ql"))).select(
        "query", "ql", "len", "i", F.xxhash64(F.substring(F.col("ql"), F.col("at") + 1, size)).alias("v")).distinct()
    return left.join(right.hint("merge"), ["len", "i", "v"]).select("query", "name", "ql", "nl")


def _reachable(texts: DataFrame, c: str, others: DataFrame, o: str, k: int) -> DataFrame:
    """Rows of ``texts`` that k edits could turn into some of ``others``: there is one whose length differs by k at most, and
    at most k characters are in none of such length. One row per length is looked up."""
    rows = others.select(F.length(o).alias("l"), F.explode_outer(F.array_distinct(F.regexp_extract_all(
        o, F.lit("(?s)(.)"), F.lit(1)))).alias("x")).distinct()
    letters = rows.withColumn("len_", F.explode(F.sequence(F.col("l") - k, F.col("l") + k))).groupBy("len_").agg(
        F.array_join(F.collect_set("x"), "").alias("letters_"))
    return texts.withColumn("len_", F.length(c)).join(broadcast_if_small(letters), "len_").filter(
        F.length(F.call_function("translate", F.col(c), F.col("letters_"), F.lit(""))) <= k).drop("len_", "letters_")


def _edit_keys(x: Column, lengths: Column, ways: list[tuple[int, int, int]], named: bool) -> Column:
    """Rows (kind, v, gone) for each way (i, d, s) to edit: i characters stand in the name only, d in the query only and s are replaced.

    A key is what is left without them, with the places of the replaced ones; ``gone`` are these. Kinds that no length on the other
    side fits are left out.
    """
    one, n = F.lit(1), F.length(x)

    def left_out(text: Column) -> Column:
        return F.transform(F.when(F.length(text) > 0, F.sequence(one, F.length(text))).otherwise(F.array().cast("array<int>")),
                           lambda i: F.concat(F.substr(text, one, i - 1), F.substr(text, i + 1)))

    def replaced(e: Column) -> Column:
        text = e["text"]
        places = F.when(F.length(text) >= e["next"], F.sequence(e["next"], F.length(text))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda j: F.struct(
            F.concat(F.substr(text, one, j - 1), F.substr(text, j + 1)).alias("text"), F.concat(e["at"], F.lit(","), j.cast("string")).alias("at"),
            F.concat(e["gone"], F.substr(text, j, one)).alias("gone"), j.alias("next")))

    def kind(i: int, d: int, s: int) -> Column:
        texts = F.array(x)
        for _ in range(i if named else d):
            texts = F.array_distinct(F.flatten(F.transform(texts, left_out)))
        rows = F.transform(texts, lambda t: F.struct(t.alias("text"), F.lit("").alias("at"), F.lit("").alias("gone"), one.alias("next")))
        for _ in range(s):
            rows = F.flatten(F.transform(rows, replaced))
        number = F.lit(i * 100 + d * 10 + s)
        keys = F.transform(rows, lambda e: F.struct(number.alias("kind"), F.xxhash64(number, e["at"], e["text"]).alias("v"), e["gone"].alias("gone")))
        fits = F.array_contains(lengths, n + (d - i if named else i - d))
        return F.when(fits, keys).otherwise(F.array().cast("array<struct<kind int, v bigint, gone string>>"))

    return F.inline(F.concat(*[kind(*way) for way in ways]))


def _short_pairs(q: DataFrame, n: DataFrame, k: int) -> DataFrame:
    """(query, name, distance) of texts with 1 to k edits. Texts meet where the very edits fit, so that little is proposed in vain.

    Pairs of equal length that differ in k places at most meet once, under the key without just these places, and need no distinct.
    """
    tasks = 4 * q.sparkSession.sparkContext.defaultParallelism  # few bytes, but some hundred keys are made of each text

    def keyed(df: DataFrame, x: str, other: DataFrame, o: str, ways: list) -> DataFrame:
        lengths = F.broadcast(other.agg(F.collect_set(F.length(o)).alias("lengths")))  # some dozens
        rows = df.repartition(tasks).crossJoin(lengths)
        return rows.select(*df.columns, _edit_keys(F.col(x), F.col("lengths"), ways, x == "nl")).repartition(2 * tasks, "v")

    def met(ways: list) -> DataFrame:  # keys are some hundred times the texts, which size estimates do not see: never broadcast them
        left = keyed(q, "ql", n, "nl", ways).withColumnRenamed("gone", "gone_q")
        return left.join(keyed(n, "nl", q, "ql", ways).drop("kind").hint("merge"), "v")

    differ = reduce(lambda a, s: a & ((F.col("kind") < s) | (F.substring("gone_q", s, 1) != F.substring("gone", s, 1))), range(1, k + 1), F.lit(True))
    d = F.levenshtein("ql", "nl", k)
    exact = F.when(F.col("kind") <= 2, F.col("kind")).otherwise(d)  # one or two replaced characters are one or two edits
    placed = met([(0, 0, s) for s in range(1, k + 1)]).filter(differ).select("query", "name", exact.alias("distance"))
    apart = F.size(F.filter(F.sequence(F.lit(1), F.length("ql")), lambda i: F.substr(F.col("ql"), i, F.lit(1)) != F.substr(F.col("nl"), i, F.lit(1))))
    moved = met([(i, d, s) for i in range(k + 1) for d in range(k + 1 - i) for s in range(k + 1 - i - d) if i + d]).filter(
        (d > 0) & ((F.length("ql") != F.length("nl")) | (apart > k)))
    return placed.unionByName(moved.select("query", "name", d.alias("distance")).distinct())


def close_pairs(queries: DataFrame, names: DataFrame, k: int = FUZZY_CAP, deletions_to: int = DELETIONS_TO) -> DataFrame:
    """(query, name, distance) with 1..k edits, ignoring case; both sides are distinct texts.

    Two texts within k edits are the same without the edited characters: very telling, but some length ** k keys. So only texts up to
    ``deletions_to`` characters use them; if either is longer, equal pieces at nearly the same place are the keys. Either is an equality
    join that finds every pair. Keys are made only for texts that are near some other side's text by length and letters.
    """
    q = settle(queries.select("query").distinct().select("query", F.lower("query").alias("ql")))
    # Names out of reach leave where they lie; only the others are made distinct.
    n = names.select("name", F.lower("name").alias("nl"))
    n = settle(_reachable(n, "nl", q, "ql", k).distinct())
    q = settle(_reachable(q, "ql", n, "nl", k))
    d = F.levenshtein("ql", "nl", k)
    short = _short_pairs(q.filter(F.length("ql") <= deletions_to), n.filter(F.length("nl") <= deletions_to), k)
    edge = deletions_to - k
    long = _shared_pieces(q.filter(F.length("ql") > edge), n.filter(F.length("nl") > edge), k).filter(
        (F.greatest(F.length("ql"), F.length("nl")) > deletions_to) & (d > 0)).select("query", "name", d.alias("distance"))
    return short.unionByName(long.distinct())


def close_matches(queries: DataFrame, names: DataFrame, k: int = FUZZY_CAP,
                  limit: int | None = None) -> DataFrame:
    """Nearest first per query; ``limit`` keeps the best few, ties by name."""
    from pyspark.sql import Window as W
    pairs = close_pairs(queries, names, k)
    if limit is None:
        return pairs
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "name"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= limit)


def fuzzy_phrases(notes: DataFrame, known: DataFrame, cap: int = FUZZY_CAP) -> DataFrame:
    """(path, line, run, pos, phrase): capitalised runs and each of their suffixes that could be
    a misspelt name: long enough, not structural, not itself a known name.

    A suffix longer than the longest name plus the edits matches nothing, so of a very long run
    only the tail is cut into suffixes.
    """
    longest = known.agg(F.max(F.length("surface"))).first()[0] or 0
    reach = longest + cap
    masked = prose_mask(F.col("body"))
    lines = spread(notes).select("path", F.posexplode(F.split(masked, "\n")).alias("i", "text"))
    word = r"[A-Z][\w'-]*"
    runs = F.regexp_extract_all("text", F.lit(rf"((?<!\w){word}(?:\s+{word})*)"), F.lit(1))
    found = lines.select("path", (F.col("i") + 1).alias("line"), "text", F.posexplode(runs).alias("run", "full"))
    words = F.split("full", r"\s+")
    first_word = F.greatest(F.lit(1), F.size(words) - reach // 2)
    found = found.select("path", "line", "text", "run", "full", F.posexplode(F.transform(
        F.sequence(first_word, F.size(words)), lambda i: F.call_function(
            "regexp_extract", F.col("full"), F.concat(
                F.lit(r"^(?:\S+\s+){"), (i - 1).cast("string"), F.lit(r"}([\s\S]*)$")), F.lit(1)))).alias("pos", "phrase")) \
        .withColumn("pos", F.col("pos") + first_word - 1)
    heading = F.col("text").rlike(r"^[ \t]{0,3}#{1,6}[ \t]+\S") & (F.col("run") == 0) & (F.col("pos") == 0) \
        & F.startswith(F.ltrim(F.regexp_replace("text", r"^[ \t]{0,3}#{1,6}[ \t]+", "")), F.col("phrase"))
    usable = found.filter(F.length("phrase").between(FUZZY_MIN, reach) & (F.length("full") >= FUZZY_MIN)
                          & ~(heading & F.lower("phrase").isin(STRUCTURAL_HEADINGS))
                          & (F.least(F.lit(cap), F.floor(F.length("phrase") / 4)) > 0))
    return usable.select("path", "line", "run", "pos", "phrase").hint("merge").join(
        broadcast_if_small(known.select(F.col("key").alias("kk")).distinct()), F.lower("phrase") == F.col("kk"), "left_anti")


def mentions_fuzzy(notes: DataFrame, known: DataFrame, cap: int = FUZZY_CAP) -> DataFrame:
    """(path, line, phrase, name, distance, rank): up to three names a phrase may have meant.

    Distinct phrases meet names once; the best suffix of a run is its nearest, earliest one.
    """
    from pyspark.sql import Window as W
    known = settle(known)
    phrases = settle(fuzzy_phrases(notes, known, cap))
    names = known.filter("kind = 'name' AND NOT skipped").filter(F.length("surface") >= FUZZY_MIN) \
        .select(F.col("canonical").alias("name")).distinct()
    pairs = settle(close_pairs(phrases.select(F.col("phrase").alias("query")), names, cap).filter(
        F.col("distance") <= F.least(F.lit(cap), F.floor(F.length("query") / 4))))
    # Phrases are cut from bodies, some to each line, which size estimates do not see: only their counterparts are broadcast, if small.
    nearest = broadcast_if_small(pairs.groupBy("query").agg(F.min("distance").alias("nearest")))
    best = phrases.hint("merge").join(nearest, F.col("phrase") == F.col("query")).groupBy("path", "line", "run").agg(
        F.min(F.struct("nearest", "pos", "phrase")).alias("b"))
    best = best.select("path", "line", "run", F.col("b.phrase").alias("phrase"))
    # Four names per phrase are enough for three after a note's own name drops out.
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "name"))
    short = broadcast_if_small(pairs.withColumn("r", rank).filter(F.col("r") <= FUZZY_TOP + 1).drop("r"))
    own = F.element_at(F.split("path", "/"), -1)
    joined = best.hint("merge").join(short, F.col("phrase") == F.col("query")).filter(F.col("name") != own)
    again = F.row_number().over(W.partitionBy("path", "line", "run").orderBy("distance", "name"))
    return joined.withColumn("rank", again).filter(F.col("rank") <= FUZZY_TOP).select(
        "path", "line", "phrase", "name", "distance", "rank")


# ---------------------------------------------------------------- repair

def apply_mention_links(notes: DataFrame, found: DataFrame, once: bool = False) -> DataFrame:
    """(path, body): exact mentions replaced by links, right to left so offsets stay true.

    With ``once`` only the first mention of a target in a note is linked.
    """
    hits = found.filter("tier = 'exact'")
    if once:
        hits = hits.groupBy("path", "canonical").agg(F.min(F.struct(
            "start", "end", "text")).alias("h")).select("path", "canonical", "h.*")
    link = F.when(F.col("text") == F.col("canonical"), F.concat(F.lit("[["), "canonical", F.lit("]]"))) \
        .otherwise(F.concat(F.lit("[["), "canonical", F.lit("|"), "text", F.lit("]]")))
    per_note = hits.groupBy("path").agg(F.reverse(F.sort_array(F.collect_list(
        F.struct("start", "end", link.alias("link"))))).alias("edits"))
    spliced = F.aggregate("edits", F.col("body"), lambda text, e: F.concat(
        F.substring(text, F.lit(1), e["start"]), e["link"],
        F.substring(text, e["end"] + 1, F.length(text))))
    return notes.join(per_note, "path").select("path", spliced.alias("body"))
