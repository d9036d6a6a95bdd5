import pytest
from pyspark.sql import functions as F

from notegrid.operators import mentions as M
from notegrid.operators import resolve as R
from notegrid.operators import search as T


def bodies(spark, *texts):
    return spark.createDataFrame([(f"F/N{i}", f"N{i}", "F", "note", b) for i, b in enumerate(texts)],
                                 "path string, name string, folder string, type string, body string")


def test_masks_keep_every_offset(spark):
    text = "a `x [[Y]]` b\n```py\n[[Z]]\n```\n[[L|m]] [t](u) https://q.r/s é\n~~~\nopen"
    row = bodies(spark, text).select(T.code_mask(F.col("body")).alias("c"), T.prose_mask(F.col("body")).alias("p")).first()
    assert len(row["c"]) == len(row["p"]) == len(text)
    assert "[[L|m]]" in row["c"] and "Z" not in row["c"] and "open" not in row["c"]
    assert row["p"].split() == ["a", "b", "é"]
    assert [i for i, ch in enumerate(row["p"]) if ch == "\n"] == [i for i, ch in enumerate(text) if ch == "\n"]


def names(spark, *rows):
    return spark.createDataFrame([(f"F/{n}", n) for n in rows], "path string, name string")


def test_mentions_longest_first_and_guards(spark):
    known = M.surfaces(names(spark, "Ann", "Ann Lee", "Mercury", "N0", "N0 Plan"),
                       spark.createDataFrame([("F/Mercury", "Mercury", "the winged one")], "path string, name string, alias string"))
    notes = bodies(spark, "Met Ann Lee and ann, then Ann. Mercury rose. See mercury or The Winged One; N0 Plan x.\n- Ann first\nPlan with (Ann) here")
    got = [(r["line"], r["text"], r["canonical"]) for r in M.mentions(notes, known).orderBy("start").collect()]
    assert got == [(1, "Ann Lee", "Ann Lee"), (1, "Ann", "Ann"), (1, "The Winged One", "Mercury"), (1, "N0 Plan", "N0 Plan"),
                   (3, "Ann", "Ann")]


def test_a_note_never_mentions_itself_but_shared_names_count(spark):
    rows = [("F/N0", "N0", "red fox"), ("F/B", "B", "red fox"), ("F/C", "C", "grey fox")]
    aliases = spark.createDataFrame(rows, "path string, name string, alias string")
    known = M.surfaces(names(spark, "Other"), aliases)
    notes = bodies(spark, "a red fox and a grey fox", "a red fox")
    got = {(r["path"], r["text"]): (r["tier"], r["canonical"]) for r in M.mentions(notes, known).collect()}
    assert got == {("F/N0", "red fox"): ("exact", "B"), ("F/N0", "grey fox"): ("exact", "C"),
                   ("F/N1", "red fox"): ("ambiguous", None)}


def test_linking_mentions_twice_changes_nothing(spark):
    known = M.surfaces(names(spark, "Ann Lee", "Oslo"))
    notes = bodies(spark, "With Ann Lee in Oslo and ann lee.")
    once = M.apply_mention_links(notes, M.mentions(notes, known))
    assert once.first()["body"] == "With [[Ann Lee]] in [[Oslo]] and [[Ann Lee|ann lee]]."
    again = notes.drop("body").join(once, "path")
    assert M.mentions(again, known).count() == 0


def test_close_pairs_match_brute_force(spark):
    import itertools
    words = ["plan", "plane", "pan", "lpan", "planet", "stone", "stane", "a", "b", ""]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            prev, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, prev + (x != y))
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words], "name string")
    got = {(r["query"], r["name"]): r["distance"] for r in M.close_pairs(df.withColumnRenamed("name", "query"), df, 2).collect()}
    assert got == {(a, b): distance(a, b) for a, b in itertools.product(words, words) if 0 < distance(a, b) <= 2}


def test_section_append_and_items(spark):
    body = "# T\n## Tasks\n- [ ] one\n- [X] two\n\n### Sub\n- [ ] three"
    df = bodies(spark, body).select(
        T.section_items(F.col("body"), "tasks").alias("items"),
        T.section_append(F.col("body"), "Tasks", F.array(F.lit("new"))).alias("more"))
    row = df.first()
    assert row["items"] == ["one", "two"]
    assert row["more"] == "# T\n## Tasks\n- [ ] one\n- [X] two\n\n- [ ] new\n### Sub\n- [ ] three"


def test_frequent_terms(spark):
    text = "We met Blue Whale today. Also Blue Whale sang. Thursday Zorblax came, and Zorblax left."
    notes = bodies(spark, text, text)
    got = {r["term"]: (r["mentions"], r["notes"]) for r in M.frequent_terms(notes, M.surfaces(names(spark, "Other"))).collect()}
    assert got == {"Blue Whale": (4, 2), "Zorblax": (4, 2)}


def test_names_without_ascii_letters_are_found(spark):
    known = M.surfaces(names(spark, "Москва", "Новый Город", "東京都", "Ann", "Zoë"))
    body = "видел Москва и новый город.\nтам Ann 我住在東京都。 x東京都 Москва1 Zoë"
    notes = bodies(spark, body, "- Москва here, xМосква")
    got = [(r["path"], r["line"], r["start"], r["text"], r["canonical"]) for r in M.mentions(notes, known).orderBy("path", "start").collect()]
    want = [(1, "Москва", "Москва"), (1, "новый город", "Новый Город"), (2, "Ann", "Ann"), (2, "東京都", "東京都"), (2, "Zoë", "Zoë")]
    assert got == [("F/N0", line, body.index(text), text, name) for line, text, name in want]
    linked = M.apply_mention_links(notes, M.mentions(notes, known)).first()["body"]
    assert "[[Новый Город|новый город]]" in linked and "我住在[[東京都]]。 x東京都" in linked


def test_close_pairs_of_any_length_equal_brute_force(spark):
    import random
    rng = random.Random(8)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def bent(text):
        out = list(text)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(out) + 1)
            out[at:at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        return "".join(out)
    names = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 16))) for _ in range(60)} | {
        "".join(rng.choice("abcde ") for _ in range(rng.choice([22, 23, 24, 25, 26, 27, 40, 200]))) for _ in range(60)}
    queries = {bent(x) for x in names} | {"", "A"}
    queries_df, names_df = (spark.createDataFrame([(x,) for x in sorted(v)], f"{c} string") for v, c in ((queries, "query"), (names, "name")))
    want = {(a, b): d for a in queries for b in names if abs(len(a) - len(b)) <= 2 and 0 < (d := edits(a.lower(), b.lower())) <= 2}
    for split in (24, 6):
        got = {(r["query"], r["name"]): r["distance"] for r in M.close_pairs(queries_df, names_df, 2, split).collect()}
        assert got == want


def test_words_are_counted_in_their_row_and_names_damped_by_counts(spark):
    rows = [("a", "The the cat [[x/Dog.md|Big dog]] `the`"), ("b", "the The THE"), ("b", "cat the"), ("c", None), ("Words/Cat", "cat Cat cat")]
    notes = spark.createDataFrame(rows, "path string, body string").repartition(3)
    forms = M.word_forms(notes, first=True)
    got = {(r.word, r.form, r.path): r.n for r in forms.collect()}
    assert got == {("the", "The", "a"): 1, ("the", "the", "a"): 1, ("cat", "cat", "a"): 1, ("dog", "Dog", "a"): 1, ("big", "Big", "a"): 1,
                   ("dog", "dog", "a"): 1, ("the", "the", "b"): 2, ("the", "The", "b"): 1, ("the", "THE", "b"): 1, ("cat", "cat", "b"): 1,
                   ("cat", "cat", "Words/Cat"): 2, ("cat", "Cat", "Words/Cat"): 1}
    assert forms.filter("first").count() == len({(w, p) for w, _, p in got})
    names = spark.createDataFrame([("Words/Cat", "Cat"), ("Words/The", "The"), ("Words/None", "None"), ("Words/Two", "Two words")], "path string, name string")
    for given in (forms, M.word_forms(notes)):
        assert sorted(tuple(r) for r in M.common_names(names, given, min_notes=2).collect()) == [("Words/Cat", "Cat"), ("Words/The", "The")]
        assert M.common_names(names, given, min_notes=3).count() == 0
    # One row per note: no exchange of words.
    alone = notes.filter("path <> 'b'")
    assert "Exchange hashpartitioning" not in M.word_forms(alone)._jdf.queryExecution().executedPlan().toString()


def test_close_pairs_make_keys_only_for_near_texts_and_broadcast_none(spark, monkeypatch):
    made, settle = [], M.settle
    monkeypatch.setattr(M, "settle", lambda df: made.append(settle(df)) or made[-1])
    q = spark.createDataFrame([("Supplier 001",), ("Supplier 012",), ("",)], "query string")
    n = spark.createDataFrame([("Supplier 002",), ("Customer 001",), ("Order 1",), ("SUPPLIER 0012",), ("Supplier 001",), ("x",)], "name string")
    pairs = M.close_pairs(q, n, 2)
    assert sorted(tuple(r) for r in pairs.collect()) == [("", "x", 1), ("Supplier 001", "SUPPLIER 0012", 1), ("Supplier 001", "Supplier 002", 1),
                                                         ("Supplier 012", "SUPPLIER 0012", 1), ("Supplier 012", "Supplier 001", 2), ("Supplier 012", "Supplier 002", 1)]
    kept = [df for df in made if df.columns == ["name", "nl"]]
    assert {r.name for r in kept[0].collect()} == {"Supplier 002", "SUPPLIER 0012", "Supplier 001", "x"}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_fuzzy_phrases_are_never_broadcast(spark, monkeypatch, tmp_path):
    bodies(spark, "We met Anna Karenima today.\nSaw Anna Karenina. Then Karenima Ann.", "Anna Karenine").write.parquet(f"{tmp_path}/notes")
    notes = spark.read.parquet(f"{tmp_path}/notes")  # files have sizes to estimate from
    known = M.surfaces(names(spark, "Anna Karenina", "Anna Karenin"))
    want = [("F/N0", 1, "Anna Karenima", "Anna Karenina", 1, 1), ("F/N0", 1, "Anna Karenima", "Anna Karenin", 2, 2),
            ("F/N1", 1, "Anna Karenine", "Anna Karenin", 1, 1), ("F/N1", 1, "Anna Karenine", "Anna Karenina", 1, 2)]
    assert sorted(tuple(r) for r in M.mentions_fuzzy(notes, known).collect()) == sorted(want)
    monkeypatch.setattr(M, "broadcast_if_small", M.settle)  # as if every counterpart were large
    found = M.mentions_fuzzy(notes, known)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_word_runs_leave_in_bounded_frames_and_only_found_names_are_grouped(spark, monkeypatch):
    import pandas as pd
    monkeypatch.setattr(M, "GRAM_ROWS", 3)
    bodies_ = ["a b c d", None, "e"]
    frames = list(M.gram_finder([1, 2])(iter([pd.DataFrame({"path": ["x", "y", "z"], "body": bodies_, "masked": bodies_})])))
    assert [len(f) for f in frames] == [3, 3, 2] and set(frames[0]["path"]) == {"x"}
    grouped, index = [], M.surface_index
    monkeypatch.setattr(M, "surface_index", lambda known: grouped.append(known) or index(known))
    known = M.surfaces(names(spark, "Ann", "(Bob)", "Carl", "x-"), spark.createDataFrame([("F/Carl", "Carl", "Bob")], "path string, name string, alias string"))
    rows = M.mentions(bodies(spark, "I saw Ann, (Bob) and Bob."), known).orderBy("start").collect()
    assert [(r.start, r.end, r.text, r.canonical) for r in rows] == [(6, 9, "Ann", "Ann"), (11, 16, "(Bob)", "(Bob)"), (21, 24, "Bob", "Carl")]
    assert {r.key for r in grouped[0].select("key").collect()} == {"ann", "(bob)", "bob"}


def test_dead_links_are_found_without_shuffling_links(spark):
    bodies = [("a", "see [[Ann]] and [[Zed|z]]\nno code\n`[[Gone]]` ~ [[ann#h]] [[Bob]]\n~~~\n[[Gone]]\n~~~\n[[L/Ann]]"),
              ("b", "[[zed]] [[Nobody]]\n```\n[[Gone]]\n```"), ("c", "plain")]
    notes = spark.createDataFrame([(p, "", b) for p, b in bodies], "path string, folder string, body string")
    index = spark.createDataFrame([("L/Ann", "Ann", "t"), ("L/Cy", "Cy", "t")], "path string, name string, type string")
    aliases = spark.createDataFrame([("L/Cy", "Bob", "t"), ("L/Cy", "ann", "t"), ("L/Cy", " ", "t")], "path string, alias string, type string")
    targets = R.build_targets(index, aliases)
    assert sorted((r["key"], r["kind"]) for r in targets.collect()) == [
        ("ann", "real"), ("bob", "alias"), ("cy", "real"), ("l/ann", "real"), ("l/cy", "real")]
    dead = T.broken_body_wikilinks(notes, targets)
    assert sorted((r["path"], r["line"], r["target"]) for r in dead.collect()) == [
        ("a", 1, "Zed"), ("b", 1, "Nobody"), ("b", 1, "zed")]
    assert "hashpartitioning" not in dead._jdf.queryExecution().executedPlan().toString()


def test_code_is_blanked_as_if_the_whole_body_were_cut(spark):
    bodies = ["", "x", "a\nb `c` d\n", "one\n  ~~~ py\n[[x]]\n ~~~\nend", "~ one ~~ two\n\n```\nopen\n[[x]]", "\r\n`a`\n`b\nc`", "t\t\n\t```\nq\n\t```\nz ~~~ y"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    whole = T._masked(F.col("body"), T.CODE, r"\n|[^\n`]+|`")
    for r in df.select("body", T.code_mask(F.col("body")).alias("m"), whole.alias("w")).collect():
        assert r["m"] == r["w"], r["body"]


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_ambiguous_mentions_list_their_candidates(spark, monkeypatch, limit):
    monkeypatch.setattr(M, "BROADCAST_BYTES", limit)
    names = spark.createDataFrame([("a/Ann", "Ann"), ("b/Zoe", "Zoe"), ("b/éva", "éva"), ("c/bob", "bob"), ("d/MAX", "MAX"), ("e/Max", "Max")],
                                  "path string, name string")
    aliases = spark.createDataFrame([("b/Zoe", "Zoe", "The Boss"), ("b/éva", "éva", "the boss"), ("c/bob", "bob", "The boss"), ("a/Ann", "Ann", "max")],
                                    "path string, name string, alias string")
    notes = spark.createDataFrame([("c/bob", "Ask the boss. We saw Max and Ann and max."), ("x/y", "Ask THE BOSS."), ("a/Ann", "We saw MAX here.")],
                                  "path string, body string")
    found = M.mentions(notes, M.surfaces(names, aliases), candidates=True)
    got = sorted((r.path, r.text, r.tier, r.n_targets, r.candidates) for r in found.collect())
    assert got == [("a/Ann", "MAX", "exact", 1, None), ("c/bob", "Ann", "exact", 1, None), ("c/bob", "Max", "ambiguous", 2, ["Ann", "Max"]),
                   ("c/bob", "max", "exact", 1, None), ("c/bob", "the boss", "ambiguous", 2, ["éva", "Zoe"]),
                   ("x/y", "THE BOSS", "ambiguous", 3, ["bob", "éva", "Zoe"])]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_close_pairs_meet_once_where_the_very_edits_fit(spark, k):
    import random
    rng = random.Random(k)
    texts = sorted({"".join(rng.choice("aab\u0001") for _ in range(rng.randrange(1, 8))) for _ in range(90)} | {f"n {i:05d}" for i in range(0, 300, 7)})
    q, n = spark.createDataFrame([(x, x) for x in texts], "query string, ql string"), spark.createDataFrame([(x, x) for x in texts], "name string, nl string")
    got = [tuple(r) for r in M._short_pairs(q, n, k).collect()]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]
    assert len(got) == len(set(got)) and set(got) == {(a, b, edits(a, b)) for a in texts for b in texts if 1 <= edits(a, b) <= k}
