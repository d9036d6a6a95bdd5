"""The few most similar names of a text, without pairing it with every name that shares something.

Fixed values of the score: 50 if one text begins with the other and 30 if one holds the other (both of
four characters or more), 10 for every word of the asked text that is a word of the name, or holds or is held
by one (both of four characters or more), and 15 for each edit below the allowance, which is a fifth of
the shorter text and at least one, if both are under twenty characters. Names of ten points or more
count; ties go by name.

Every point has a cause that an equality join can find:

* Holding: the held text's rarest run of nearly its own length is looked up in the index of such runs.
* Words: an inverted index. Words matched by few names give candidates. A word that many names match gives
  only its first names, as all names reached by it alone score the same, and pairs of such words are
  keys of their own.
* Edits: one edit by texts with one character left out. Of more edits, three at most, one half of a name has one at most, and
  the halves are keys; halves that too many share are keys together with the edits left for the other half.
  This search runs only for texts whose places are not yet all taken by names that such an edit distance could not beat.

What the joins propose is scored in full, and the best are kept by a ranked window, which limits each
task's rows before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notegrid.operators.resolve import exact_lookup
from notegrid.session import broadcast_if_small, settle

PREFIX, HOLDS, WORD, EDIT, LEAST = 50, 30, 10, 15, 10
SUBSTANTIAL, WORD_LENGTH, SHORT = 4, 2, 20
RARE = 200  # names that a word may match and still give candidates of its own
HOT = 10_000  # pairs that share half a text and are still compared one by one
MOVED = [0, 0, -1, 1]  # characters that the text's half is longer than the name's, by kind of edit
MASK = "\u0001"  # stands for a replaced character in keys; what such keys propose is compared in full


def _words(c: str) -> Column:
    return F.filter(F.split(c, r"(?U)[\s\-_]+"), lambda w: F.length(w) >= WORD_LENGTH)


# Lengths of runs: a text is looked up by runs of the greatest of these lengths that it has.
RUNS = [4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64]


def _run_length(c: str) -> Column:
    return F.array_max(F.filter(F.array(*map(F.lit, RUNS)), lambda r: r <= F.length(c)))


def _runs(c: str, r: str) -> Column:
    """Runs of ``r`` characters, repeats included; empty for shorter texts."""
    return F.when(F.length(c) >= F.col(r), F.transform(
        F.sequence(F.lit(1), F.length(c) - F.col(r) + 1), lambda i: F.substr(F.col(c), i, F.col(r)))).otherwise(F.array().cast("array<string>"))


def held_in(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long): distinct texts, both of four characters or more, the second holding the first.

    The runs are nearly as long as the held text, so that few other texts share them however many there are; of the
    holding texts only runs that are asked for are kept, and before that the greater side loses what the smaller one cannot meet.
    """
    wanted = short.filter(F.length("short") >= SUBSTANTIAL).withColumn("r", _run_length("short"))
    used = F.broadcast(wanted.select("r").distinct())  # at most as many rows as RUNS
    runs = long.filter(F.length("long") >= SUBSTANTIAL).join(used, F.length("long") >= F.col("r")).select("long", F.explode(_runs("long", "r")).alias("g"))
    if long.count() < short.count():  # of many short texts only those stay whose first run some long text has
        runs = settle(runs)
        first = F.xxhash64(F.expr("substring(short, 1, r)")) == F.col("h")
        wanted = settle(wanted.join(broadcast_if_small(runs.select(F.xxhash64("g").alias("h")).distinct()), first, "left_semi"))
    wanted = settle(wanted.select("short", "r", F.explode(F.array_distinct(_runs("short", "r"))).alias("g")))
    runs = settle(runs.join(broadcast_if_small(wanted.select("g").distinct()), "g", "left_semi").distinct())
    known = runs.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    anchor = wanted.join(known, "g", "left").groupBy("short").agg(F.min_by("g", F.struct("n", "g")).alias("g"), F.count_if(F.col("n").isNull()).alias("missing")) \
        .filter("missing = 0").select("short", "g")
    return anchor.join(runs, "g").filter(F.contains("long", F.col("short"))).select("short", "long")


def _word_matches(asked: DataFrame, named: DataFrame) -> DataFrame:
    """(w, fw): words of the asked texts and the words of names they match."""
    same = asked.join(named, F.col("w") == F.col("fw"))
    inner = held_in(asked.select(F.col("w").alias("short")), named.select(F.col("fw").alias("long"))).select(F.col("short").alias("w"), F.col("long").alias("fw"))
    outer = held_in(named.select(F.col("fw").alias("short")), asked.select(F.col("w").alias("long"))).select(F.col("long").alias("w"), F.col("short").alias("fw"))
    return settle(same.unionByName(inner).unionByName(outer).distinct())


def _allowed(a: str, b: str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.least(F.length(a), F.length(b)) / 5).cast("int"))


def _score() -> Column:
    """Points of a pair (t, tw) and (f, fws)."""
    both = (F.length("t") >= SUBSTANTIAL) & (F.length("f") >= SUBSTANTIAL)
    begins = both & (F.startswith("f", F.col("t")) | F.startswith("t", F.col("f")))
    holds = both & (F.contains("f", F.col("t")) | F.contains("t", F.col("f")))
    meets = F.size(F.filter("tw", lambda w: F.exists("fws", lambda x: (x == w) | (
        (F.length(w) >= SUBSTANTIAL) & (F.length(x) >= SUBSTANTIAL) & (F.contains(x, w) | F.contains(w, x))))))
    allowed = _allowed("t", "f")
    edits = F.levenshtein("t", "f")
    short = (F.length("t") < SHORT) & (F.length("f") < SHORT)
    return (F.when(begins, PREFIX).otherwise(0) + F.when(holds, HOLDS).otherwise(0) + meets * WORD
            + F.when(short & (edits <= allowed), (allowed + 1 - edits) * EDIT).otherwise(0))


def _left_out(c: str) -> Column:
    """The text itself and all texts with one character left out."""
    return F.array_distinct(F.concat(F.array(F.col(c)), _once(F.col(c), "")))


def _once(x: Column, put: str) -> Column:
    """All texts with one character replaced by ``put``, each once: of equal characters in a row the last is left out; a masked one is
    not masked again."""
    places = F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
    one = F.lit(1)
    places = F.filter(places, lambda i: F.substr(x, i, one) != (F.lit(put) if put else F.substr(x, i + 1, one)))
    return F.transform(places, lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.lit(put), F.substr(x, i + 1)))


def _changed(x: Column, out: int, masked: int) -> Column:
    """All texts with ``out`` characters left out and ``masked`` others masked; ``x`` is worked out once, not for every place."""
    def step(texts: Column, put: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(texts, lambda y: _once(y, put))))

    return reduce(step, [""] * out + [MASK] * masked, F.array(x))


def _near_edits(asked: DataFrame, named: DataFrame) -> DataFrame:
    """(t, f) that may be one edit apart. One half of the name then stands at the beginning or end of the text: only names that share
    such a half with some text are written with a character left out."""
    half = F.expr("CAST(len DIV 2 AS INT)")

    def ends(c: str) -> Column:
        sides = [F.expr(f"substring({c}, 1, CAST(len DIV 2 AS INT))"), F.right(F.col(c), F.col("len") - half)]
        return F.explode(F.array(*[F.xxhash64("len", F.lit(i), x) for i, x in enumerate(sides)])).alias("v")

    n = F.length("t")
    short = asked.filter(n < SHORT).select("t")
    have = short.withColumn("len", F.explode(F.sequence(F.greatest(n - 1, F.lit(1)), n + 1))).select(ends("t")).distinct()
    near = named.filter(F.length("f") < SHORT).select("f", F.length("f").alias("len")).select("f", ends("f")).join(
        broadcast_if_small(have), "v", "left_semi").select("f").distinct()
    return short.select("t", F.explode(_left_out("t")).alias("v")).join(near.select("f", F.explode(_left_out("f")).alias("v")), "v").select("t", "f")


def _piece_bounds() -> tuple[Column, Column]:
    first = F.floor(F.col("i") * F.col("len") / F.col("p")).cast("int")
    last = F.floor((F.col("i") + 1) * F.col("len") / F.col("p")).cast("int")
    return first, last - first


def _with_pieces(asked: DataFrame, named: DataFrame) -> DataFrame:
    """Names of 10 to 19 characters with a piece that some asked text has at nearly the same place; texts two or three edits apart
    share one."""
    first, size = _piece_bounds()
    pieces = F.expr("CAST(len DIV 5 + 1 AS INT)")
    key = lambda piece: F.xxhash64("len", "i", piece).alias("v")
    mine = named.filter(F.length("f").between(10, SHORT - 1)).select("f", F.length("f").alias("len")).withColumn("p", pieces)
    mine = mine.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).select("f", key(F.substr(F.col("f"), first + 1, size)))
    n = F.length("t")
    theirs = asked.select("t", F.explode(F.sequence(F.greatest(F.lit(10), n - 3), F.least(F.lit(SHORT - 1), n + 3))).alias("len"))
    theirs = theirs.withColumn("p", pieces).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    theirs = theirs.withColumn("first", first).withColumn("size", size).withColumn("at", F.explode(F.sequence(F.col("first") - 3, F.col("first") + 3)))
    theirs = theirs.filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= n)).select(
        "len", "i", key(F.substr(F.col("t"), F.col("at") + 1, F.col("size")))).select("v").distinct()
    return mine.join(broadcast_if_small(theirs), "v", "left_semi").select("f").distinct()


def _far_edits(asked: DataFrame, named: DataFrame, hot: int = HOT) -> DataFrame:
    """(t, f) that may be two or three edits apart: both of 10 to 19 characters.

    A name is cut in halves; three edits leave one half with one edit at most: a character replaced (masked on both sides),
    or left out on one side. Such halves are keys. A key that many texts and many names share ("Customer " before a number) is
    made finer by the edits that are left for the other half, so that pairs meet there only if the edits suffice.
    """
    n, h, k = F.length("t"), F.expr("CAST(len DIV 2 AS INT)"), F.expr("CAST(least(len, length(t)) DIV 5 AS INT)")
    tasks = 4 * asked.sparkSession.sparkContext.defaultParallelism  # few bytes, but many keys are made of each text
    asked = settle(asked.filter(n.between(10, SHORT - 1)).select("t").repartition(tasks))
    mine = settle(_with_pieces(asked, named).repartition(tasks))
    lengths = F.broadcast(mine.select(F.length("f").alias("len")).distinct())  # ten at most
    text, name = (F.translate(F.col(c), MASK, "\u0002") for c in ("t", "f"))  # no text has the mask itself

    def kinds(how) -> Column:
        """Rows (kind, v): 0 the first half as it is, 1 masked, 2 the name's half, 3 the text's half less one character; 4 to 7 the second half."""
        def part(kind: int) -> Column:
            return F.transform(how(kind), lambda v: F.struct(F.lit(kind).alias("kind"), F.xxhash64("len", F.lit(kind), v).alias("v")))

        return F.inline(F.concat(*map(part, range(8))))

    def of_text(kind: int) -> Column:
        x = F.left(text, h + MOVED[kind]) if kind < 4 else F.right(text, F.col("len") - h + MOVED[kind % 4])
        return _changed(x, 0, 1) if kind % 4 == 1 else _changed(x, 1, 0) if kind % 4 == 3 else F.array(x)

    def of_name(kind: int) -> Column:
        x = F.left(name, h) if kind < 4 else F.right(name, F.col("len") - h)
        return _changed(x, 0, 1) if kind % 4 == 1 else _changed(x, 1, 0) if kind % 4 == 2 else F.array(x)

    theirs = settle(asked.join(lengths, F.abs(F.col("len") - n) <= k).select("t", "len", kinds(of_text)))
    keys = theirs.groupBy("v", "len", "kind").agg(F.count(F.lit(1)).alias("nt"))
    ours = settle(mine.withColumn("len", F.length("f")).select("f", "len", kinds(of_name)).join(
        broadcast_if_small(theirs.select("v").distinct()), "v", "left_semi"))
    busy = ours.groupBy("v").agg(F.count(F.lit(1)).alias("nf")).join(keys, "v").filter(F.col("nt") * F.col("nf") > hot)
    busy = broadcast_if_small(busy.select("v", "len", "kind"))
    within = F.levenshtein("t", "f", 3).between(0, 3)
    on = ["v", "len", "kind"]
    calm = theirs.join(busy, on, "left_anti").select("v", "t").join(ours.select("v", "f"), "v").filter(within).select("t", "f")

    # Of the edits left, i characters stand in the name only, d in the text only and s are replaced.
    first = F.col("kind") < 4
    moved = F.element_at(F.array(*map(F.lit, MOVED)), F.col("kind") % 4 + 1)
    text_rest = F.when(first, F.right(text, n - h - moved)).otherwise(F.left(text, n - F.col("len") + h - moved))
    name_rest = F.when(first, F.right(name, F.col("len") - h)).otherwise(F.left(name, h))
    left_, more = k - (F.col("kind") % 4 > 0).cast("int"), F.when(first, F.col("len") - h).otherwise(h) - F.length("rest")
    steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d in range(4) for s in range(4 - d)])
    asked_rest = theirs.join(busy, on, "left_semi").withColumn("rest", text_rest).withColumn("more", more.cast("int")).withColumn("left_", left_) \
        .select("*", F.inline(steps)).withColumn("i", F.col("d") + F.col("more")).filter((F.col("i") >= 0) & (F.col("i") + F.col("d") + F.col("s") <= F.col("left_")))

    def spelt(out: str) -> Column:
        made = F.array().cast("array<string>")
        for a in range(4):
            for b in range(4 - a):
                made = F.when((F.col(out) == a) & (F.col("s") == b), _changed(F.col("rest"), a, b)).otherwise(made)
        return F.explode(made).alias("x")

    finer = F.xxhash64("v", "i", "s", "x").alias("z")
    wanted = F.broadcast(asked_rest.select("len", "kind", "i", "s").distinct())  # some hundreds at most
    left = asked_rest.select("t", "v", "i", "s", spelt("d")).select("t", finer)
    right = ours.join(busy, on, "left_semi").withColumn("rest", name_rest).join(wanted, ["len", "kind"]).select("f", "v", "i", "s", spelt("i")).select("f", finer)
    crowded = left.join(right.hint("merge"), "z").filter(within).select("t", "f")
    return calm.unionByName(crowded).distinct()


def _best(scored: DataFrame, limit: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("t").orderBy(F.desc("score"), "low", "name"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def similar_names(targets: DataFrame, names: DataFrame, limit: int = 5, rare: int = RARE) -> DataFrame:
    """(target, name, score, rank): the best ``limit`` names for each distinct target, its own writings left out.

    Null and blank targets, and null and empty names, take no part. Of a name with folders the last part is compared.
    """
    asked = targets.select("target").filter(F.col("target").isNotNull()).distinct().withColumn(
        "t", F.lower(F.regexp_replace("target", r"(?U)^\s+|\s+$", ""))).filter("t != ''")
    texts = settle(asked.select("t").distinct().withColumn("tw", _words("t")))
    index = names.select("name").filter(F.col("name").isNotNull()).distinct().withColumn("low", F.lower("name"))
    index = settle(index.withColumn("f", F.lower(F.element_at(F.split("name", "/"), -1))).filter("f != ''").withColumn("fws", _words("f")))
    plain = settle(index.select("f").distinct())

    word_rows = index.select("name", "low", F.explode(F.array_distinct("fws")).alias("fw"))
    sizes = word_rows.groupBy("fw").agg(F.count(F.lit(1)).alias("n"))
    asked_rows = texts.select("t", F.explode(F.array_distinct("tw")).alias("w"))
    matches = _word_matches(asked_rows.select("w").distinct(), sizes.select("fw"))
    load = settle(matches.join(sizes, "fw").groupBy("w").agg((F.sum("n") > rare).alias("common")))
    matches = matches.join(load, "w")
    few = asked_rows.join(matches.filter("NOT common"), "w").join(word_rows, "fw").select("t", "name")
    # Common words: the first names of each, and names that two of them match.
    shared = broadcast_if_small(matches.filter("common").select("w", "fw"))
    many = word_rows.join(shared, "fw").select("w", "name", "low")
    leading = many.withColumn("k", F.dense_rank().over(W.partitionBy("w").orderBy("low"))).filter(F.col("k") <= limit + 1)
    leading = asked_rows.join(leading.distinct(), "w").select("t", "name")
    pair = F.expr("flatten(transform(ws, (a, i) -> transform(slice(ws, i + 2, size(ws)), b -> named_struct('a', a, 'b', b))))")
    common_rows = asked_rows.join(load.filter("common"), "w")
    asked_pairs = settle(common_rows.groupBy("t").agg(F.sort_array(F.collect_set("w")).alias("ws")).select("t", F.explode(pair).alias("ab")))
    paired = asked_pairs.select(F.explode(F.array("ab.a", "ab.b")).alias("w")).distinct()
    named_pairs = many.join(broadcast_if_small(paired), "w", "left_semi").groupBy("name").agg(
        F.sort_array(F.collect_set("w")).alias("ws")).select("name", F.explode(pair).alias("ab"))
    twice = asked_pairs.join(named_pairs, "ab").select("t", "name")

    holding = held_in(texts.select(F.col("t").alias("short")), plain.select(F.col("f").alias("long"))).select(F.col("short").alias("t"), F.col("long").alias("f"))
    held = held_in(plain.select(F.col("f").alias("short")), texts.select(F.col("t").alias("long"))).select(F.col("long").alias("t"), F.col("short").alias("f"))
    near = _near_edits(texts, plain)
    by_text = holding.unionByName(held).unionByName(near).distinct()

    def scored(pairs: DataFrame) -> DataFrame:
        full = pairs.join(texts, "t").join(index, "name").filter("low != t")
        return full.withColumn("score", _score().cast("int")).filter(F.col("score") >= LEAST).select("t", "name", "low", "score")
    found = few.unionByName(leading).unionByName(twice).unionByName(by_text.join(index.select("f", "name"), "f").select("t", "name")).distinct()
    first = settle(_best(scored(found), limit).drop("rank"))

    # Two or three edits give at most ``reach`` points to a name that nothing else has found.
    weight = common_rows.join(texts, "t").groupBy("t").agg(F.sum(F.size(F.filter("tw", lambda x: x == F.col("w")))).alias("m"))
    full = first.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low_score"))
    reach = EDIT * (F.floor(F.length("t") / 5) - 1) + WORD * F.coalesce("m", F.lit(0))
    open_ = texts.filter(F.length("t").between(10, SHORT - 1)).select("t").join(weight, "t", "left").join(full, "t", "left").filter(
        (F.coalesce("n", F.lit(0)) < limit) | (F.col("low_score") <= reach)).select("t")
    far = _far_edits(open_, plain).join(index.select("f", "name"), "f").select("t", "name").join(first.select("t", "name"), ["t", "name"], "left_anti")
    best = _best(first.unionByName(scored(far)), limit)
    return asked.join(best, "t").select("target", "name", "score", "rank")


def suggestions(targets: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """(target, similar): the similar names of a target as one short list, best first."""
    ranked = similar_names(targets, names, limit)
    return ranked.groupBy("target").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("similar"))


def lookup_or_suggest(queries: DataFrame, notes: DataFrame, aliases: DataFrame, limit: int = 10) -> DataFrame:
    """Exact lookup, and for what it does not find the similar names with the number of notes that bear them.

    query, tier, n, path, ambiguous as in ``exact_lookup``; suggestions is an array of (name, n, path), empty
    for found queries, path being the sole note's. A query with suggestions is ambiguous.
    """
    exact = settle(exact_lookup(queries, notes, aliases))
    missed = exact.filter("n = 0").select("query", F.regexp_replace("query", r"\.md$", "").alias("target"))
    counts = notes.groupBy("name").agg(F.count(F.lit(1)).alias("notes"), F.min("path").alias("first"))
    ranked = similar_names(missed, notes, limit).join(counts, "name").select(
        "target", F.struct("rank", "name", F.col("notes").alias("n"), F.when(F.col("notes") == 1, F.col("first")).alias("path")).alias("s"))
    listed = missed.join(ranked, "target").groupBy("query").agg(F.sort_array(F.collect_list("s")).alias("s"))
    none = F.expr("cast(array() as array<struct<name:string,n:bigint,path:string>>)")
    return exact.join(listed, "query", "left").select(
        "query", "tier", "n", "path", (F.col("ambiguous") | F.col("s").isNotNull()).alias("ambiguous"),
        F.coalesce(F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"), x["path"].alias("path"))), none).alias("suggestions"))
