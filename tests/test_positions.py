import re

from notegrid.operators import bulk as B
from notegrid.operators import order as O
from notegrid.operators import positions as P
from notegrid.operators import workflow as W

NOTES = [
    ("A/One", "One", "A", "see [[Two]] and [[B/Two#top|the two]]\n`[[Two]]` [x](../B/Two.md)\n```\n[[Two]]\n```\n[[One]] é [[b/two]]"),
    ("B/Two", "Two", "B", "[[Two]] [[C/Two]] [[D/C/Two.md|deep]] [[nowhere]]"),
    ("D/C/Two", "Two", "D/C", "[[One|a#b]] [[]] [[open"),
    ("E/Three", "Three", "E", "[[Tw`o]] 日本[[Two]]\r\n~~~\n[[Two]] never closed"),
    ("E/None", "None", "E", None),
    ("E/Empty", "Empty", "E", ""),
]
SCHEMA = "path string, name string, folder string, body string"


def test_links_and_their_places(spark):
    notes = spark.createDataFrame(NOTES, SCHEMA)
    body = {p: b for p, _, _, b in NOTES}
    got = P.body_links(notes).collect()
    for r in got:
        assert body[r.src_path][r.start:r.start + r.length] == r.raw
        assert r.line == body[r.src_path][:r.start].count("\n") + 1
    want = {(p, m.start()) for p, b in body.items() for m in re.finditer(f"{P.WIKI}|{P.MARKDOWN}", b or "")}
    assert {(r.src_path, r.start) for r in got} == want and len(got) == len(want)
    assert sorted((r.src_path, r.line) for r in got if r.in_code) == [("A/One", 2), ("A/One", 4), ("E/Three", 3)]
    assert [(r.form, r.target) for r in got if r.raw.startswith("[x]")] == [("markdown", "B/Two")]


def test_backlinks_count_notes_of_one_name(spark):
    notes = spark.createDataFrame(NOTES, SCHEMA)
    got = {(r.src_path, r.start): (r.path, r.n_notes) for r in P.backlink_rows(P.body_links(notes), notes).collect()}
    body = {p: b or "" for p, _, _, b in NOTES}
    for r in P.body_links(notes).collect():
        fits = [p for p in body if p != r.src_path and (p == r.target or r.form == "wikilink" and p.endswith("/" + r.target))]
        assert got.pop((r.src_path, r.start), None) == ((min(fits, key=lambda p: (p != r.target, p)), len(fits)) if fits else None), r
    assert not got
    assert P.backlink_rows(P.body_links(notes), notes.limit(0)).count() == 0
    assert P.body_links(notes.limit(0)).count() == 0


def test_bodies_after_moves(spark):
    notes = spark.createDataFrame(NOTES, SCHEMA)
    moves = B.bulk_move(notes, notes.filter("path = 'B/Two'"), "Old")
    edits = P.body_rewrites(P.body_links(notes), moves, notes)
    got = {r.path: r.body for r in P.rewrite_bodies(notes, edits).collect()}
    assert got == {
        "A/One": "see [[Old/Two]] and [[Old/Two#top|the two]]\n`[[Two]]` [x](../B/Two.md)\n```\n[[Two]]\n```\n[[One]] é [[b/two]]",
        "E/Three": "[[Tw`o]] 日本[[Old/Two]]\r\n~~~\n[[Two]] never closed"}
    moves = B.bulk_move(notes, notes.filter("path = 'D/C/Two'"), "Old")
    edits = P.body_rewrites(P.body_links(notes), moves, notes.filter("path <> 'B/Two'"))
    got = {r.path: r.body for r in P.rewrite_bodies(notes, edits).collect()}
    assert got["B/Two"] == "[[Two]] [[Two]] [[Two|deep]] [[nowhere]]"


def test_rewrites_do_not_feed_one_another(spark):
    notes = spark.createDataFrame([("n", "[[A]] then\0 [[B]] then [[A]] `[[A]]`")], "path string, body string")
    edits = spark.createDataFrame([("n", 0, "[[A]]", "[[B]]"), ("n", 12, "[[B]]", "[[C]]"), ("n", 23, "[[A]]", "[[B]]")],
                                  "src_path string, start long, raw string, new_raw string")
    assert [r["body"] for r in P.rewrite_bodies(notes, edits).collect()] == ["[[B]] then\0 [[C]] then [[B]] `[[A]]`"]


def test_sources_of_deleted_notes_are_counted_once(spark):
    notes = [("A/x", "x"), ("B/x", "X"), ("y", "y"), ("C/z", "z"), ("c/Z", "q")]
    links = [("m", "[[x]]"), ("m", "[[A/X|t]]"), ("m", "[[x#h]]"), ("A/x", "[[x]]"), ("n", "[[a/x]]"), ("y", "[[y]]"), ("k", "[[Y]]"),
             ("k", "[[c/z]]"), ("c/Z", "[[C/z]]"), ("k", "plain"), ("k", None)]
    selected = spark.createDataFrame(notes, "path string, name string")
    guard = spark.createDataFrame([("y", "fork")], "path string, block string")
    got = {r.path: (r.n_sources, r.block) for r in W.delete_plan(
        selected, spark.createDataFrame(links, "src_path string, raw string"), guard).collect()}
    want = {}
    for path, name in notes:
        aims = {name.lower(), path.lower()}
        hits = {s for s, raw in links if raw and raw.startswith("[[") and raw[2:-2].split("|")[0].split("#")[0].lower() in aims and s != path}
        want[path] = len(hits), "fork" if path == "y" else None
    assert got == want


def test_texts_sort_by_locale(spark):
    rows = [(n,) for n in ["zeta", "Äpfel", "apfel 10", "Apfel 2", "éclair", "Eclair", "Zebra", "apfel"]]
    df = spark.createDataFrame(rows, "name string")
    assert [r.name for r in O.sort_rows(df).collect()] == ["apfel", "Äpfel", "apfel 10", "Apfel 2", "Eclair", "éclair", "Zebra", "zeta"]
    two = spark.createDataFrame([(n, k) for n, k in [("b", "É2"), ("a", "e10"), ("c", "E2"), ("d", None), ("e", "")]], "name string, k string")
    assert [r.name for r in O.sort_rows(two, "k").collect()] == ["b", "c", "a", "d", "e"]
    assert [r.name for r in O.sort_rows(two, "k", desc=True).collect()] == ["a", "b", "c", "d", "e"]
