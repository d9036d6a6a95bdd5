"""Search, masks, sections, body links and mentions."""

from pyspark.sql import functions as F

from notegrid.operators import bulk as B
from notegrid.operators import mentions as M
from notegrid.operators import positions as L
from notegrid.operators import resolve as R
from notegrid.operators import search as T
from notegrid.probes.registry import probe, twin


@probe("search_lines", twin("document_n", body="""
    SELECT path, i::INT AS line, ls[i] AS text, array_to_string(ls[greatest(i-2,1):i-1], '|') AS before, array_to_string(ls[i+1:i+2], '|') AS after
    FROM (SELECT path, string_split(body, chr(10)) AS ls FROM document_n), LATERAL (SELECT unnest(range(1, len(ls)+1)) AS i)
    WHERE contains(lower(ls[i]), 'tion of')"""))
def _(t):
    return T.search_lines(t.document, "tion OF").select(
        "path", "line", "text", F.array_join("before", "|").alias("before"),
        F.array_join("after", "|").alias("after"))


RANKED = {"hit": """SELECT path, count(*) AS n_lines FROM (SELECT path, unnest(string_split(body, chr(10))) AS l FROM document_n)
    WHERE regexp_matches(l, '(?i)^the .*\\.$') GROUP BY 1"""}


@probe("search_rank", twin("document_n", body="SELECT * FROM hit ORDER BY n_lines DESC, path LIMIT 20", **RANKED))
def _(t):
    return T.search_rank(T.search_lines(t.document, r"^the .*\.$", regex=True, context=0), 20)


@probe("search_total", twin("document_n", body="""
    SELECT count(*) AS n_files, sum(n_lines)::BIGINT AS n_lines, count(*) > 20 AS truncated FROM hit""", **RANKED))
def _(t):
    return T.search_total(T.search_lines(t.document, r"^the .*\.$", regex=True, context=0), 20)


@probe("fuzzy_rank", twin("part_n", "supplier_n", body="""
    SELECT path, name, score, matched, value FROM (
      SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, rank) AS r FROM (
        SELECT path, name, value, rank, CASE WHEN rank=0 THEN 'name' ELSE 'alias' END AS matched,
          CASE WHEN q=v THEN 1.0 WHEN contains(q,v) OR contains(v,q) THEN greatest(1-levenshtein(q,v)/greatest(length(q),length(v)),0.6)
            ELSE 1-levenshtein(q,v)/greatest(length(q),length(v)) END::DOUBLE AS score FROM
          (SELECT path, name, 0 AS rank, name AS value, lower(name) AS v, 'rd wigdet' AS q FROM part_n UNION ALL
           SELECT path, name, 1, alias, lower(alias), 'rd wigdet' FROM part_n))
      WHERE score >= 0.5) WHERE r=1 ORDER BY score DESC, rank, name, path LIMIT 10"""))
def _(t):
    return T.fuzzy_rank(t.part, t.part, "Rd Wigdet.md")


N0 = "len(string_split(text, chr(10)))"
W = {"w": "SELECT 'Docs/'||source||'/Doc '||doc_id AS path, 'Docs/'||source AS folder, doc_id AS k, text, " + N0
     + "::INT AS n0, source FROM documents",
     "top": "SELECT max(doc_id) AS last_doc FROM documents", "parts": "SELECT max(p_partkey) AS last_part FROM part"}
PROSE_TAIL = """'\nAsk Part '||k%2500||' near NATION_'||k%30||' with '||CASE WHEN k%2=0 THEN 'red widget' ELSE 'Blue Bolt' END||' for Doc '||(k+1)||' by Doc '||k||' hand.\nNATION_'||k%25"""


@probe("code_mask", twin(body="""
    SELECT path, length(text)+length(tail1)+length(tail2)::BIGINT AS chars, md5(text||tail1) AS head FROM (SELECT *,
      """ + PROSE_TAIL + """||' again;         ' AS tail1,
      ' [[Part 2]] [x](Part 3.md) https://a.b/Part 4 and Part '||k%2000||'7x.\n   \n                  \n   \n## Notes\n- [ ] call NATION_3\n- [x] done '||k
        ||'\n### Links\n[[]] [[Part '||k%2500||'|it]] [[NATOIN_'||k%25||']] [f](../src1/Doc%20'||k||'.md) ![p](pic.png) [u](http://x.y) [[open' AS tail2 FROM w)""", **W))
def _(t):
    masked = t.written.select("path", "k", T.code_mask(F.col("body")).alias("m"))
    head = F.expr("substring(m, 1, instr(m, ' again;') + length(' again;         ') - 1)")
    return masked.select("path", F.length("m").cast("bigint").alias("chars"), F.md5(head).alias("head"))


@probe("prose_mask", twin(body="""
    SELECT path, '4andPart'||k%2000||'7x.##Notes-[]callNATION_3-[x]done'||k||'###Links[[open' AS rest FROM w""", **W))
def _(t):
    masked = t.written.select("path", T.prose_mask(F.col("body")).alias("m"))
    tail = F.expr("substring(m, instr(m, ' again;') + length(' again;'))")
    return masked.select("path", F.regexp_replace(tail, r"\s+", "").alias("rest"))


@probe("section_check", twin(body="""
    SELECT path, 2 AS level, 'Links' AS title, true AS wrong_level FROM w UNION ALL SELECT path, 3, 'Tasks', false FROM w""", **W))
def _(t):
    return T.section_check(t.written, {"document": [(2, "Notes"), (2, "Links"), (3, "Tasks")]})


@probe("section_items", twin(body="SELECT path, 'call NATION_3|done '||k AS items FROM w", **W))
def _(t):
    return t.written.select("path", F.array_join(T.section_items(F.col("body"), "notes"), "|").alias("items"))


@probe("section_append", twin(body="SELECT path, true AS placed, '## Later\n- again' AS fresh FROM w", **W))
def _(t):
    inside = T.section_append(F.col("body"), "Notes", F.array(F.lit("new")))
    fresh = T.section_append(F.col("body"), "Later", F.array(F.lit("again")), "bullets")
    placed = F.contains(inside, F.concat(F.lit("- [x] done "), "k", F.lit("\n- [ ] new\n### Links\n")))
    return t.written.select("path", placed.alias("placed"),
                            F.regexp_extract(fresh, r"\n\n(## Later[\s\S]*)$", 1).alias("fresh"))


@probe("malformed_body_wikilinks", twin(body="""
    SELECT path, n0+10 AS line, '[[]]' AS value, 'empty-target' AS reason FROM w UNION ALL SELECT path, n0+10, '[[', 'unclosed' FROM w""", **W))
def _(t):
    return T.malformed_body_wikilinks(t.written)


@probe("body_wikilinks", twin(body="""
    SELECT path, n0+2 AS line, '[[Part 2]]' AS value, 'Part 2' AS target FROM w UNION ALL
    SELECT path, n0+10, '[[Part '||k%2500||'|it]]', 'Part '||k%2500 FROM w UNION ALL
    SELECT path, n0+10, '[[NATOIN_'||k%25||']]', 'NATOIN_'||k%25 FROM w""", **W))
def _(t):
    return T.body_wikilinks(t.written)


@probe("broken_body_wikilinks", twin(body="""
    SELECT path, n0+10 AS line, 'Part '||k%2500 AS target FROM w, parts WHERE k%2500 > last_part UNION ALL
    SELECT path, n0+10, 'NATOIN_'||k%25 FROM w""", **W))
def _(t):
    targets = R.build_targets(t.index_rows, t.aliases)
    return T.broken_body_wikilinks(t.written, targets).select("path", "line", "target")


@probe("broken_body_file_links", twin(body="""
    SELECT path, n0+2 AS line, 'Part' AS value, false AS is_image FROM w UNION ALL
    SELECT path, n0+10, '../src1/Doc%20'||k||'.md', false FROM w WHERE source<>'src1' UNION ALL
    SELECT path, n0+10, 'pic.png', true FROM w WHERE source<>'src1'""", **W))
def _(t):
    files = t.written.select(F.concat("path", F.lit(".md")).alias("file")).union(
        t.written.filter("folder = 'Docs/src1'").select(F.concat("folder", F.lit("/pic.png"))))
    return T.broken_body_file_links(t.written, files)


# A last line with whole paths, an end of a path, a link in code and a Markdown link, by key arithmetic.
LAST = {"l": """SELECT *, n0+11 AS last, '[[Docs/src1/Doc '||(k+1)||'#h]]' AS whole, '[[src2/Doc '||(k+2)||'|d]]' AS ending, '[m](Doc%20'||(k+3)||'.md)' AS mark FROM w""",
        "d": "SELECT 'Docs/'||source||'/Doc '||doc_id AS path, doc_id, source FROM documents"}


def _linked(t):
    k = lambda n: (F.col("k") + n).cast("string")
    return t.written.withColumn("body", F.concat(
        "body", F.lit("\n[[Docs/src1/Doc "), k(1), F.lit("#h]] [[src2/Doc "), k(2), F.lit("|d]] `[[Part 3]]` [m](Doc%20"), k(3), F.lit(".md)")))


@probe("backlink_rows", twin("part_n", body="""
    SELECT path, 1 AS n_notes, src_path, line, in_code, form, raw, true AS placed FROM (
      SELECT p.path, b.* EXCLUDE (part) FROM part_n p JOIN (
        SELECT path AS src_path, n0+2 AS line, false AS in_code, 'wikilink' AS form, '[[Part 2]]' AS raw, 2 AS part FROM l UNION ALL
        SELECT path, n0+10, false, 'wikilink', '[[Part '||k%2500||'|it]]', k%2500 FROM l UNION ALL
        SELECT path, last, true, 'wikilink', '[[Part 3]]', 3 FROM l) b ON p.k=b.part UNION ALL
      SELECT d.path, l.path, last, false, 'wikilink', whole FROM l JOIN d ON doc_id=k+1 AND d.source='src1' UNION ALL
      SELECT d.path, l.path, last, false, 'wikilink', ending FROM l JOIN d ON doc_id=k+2 AND d.source='src2' UNION ALL
      SELECT d.path, l.path, last, false, 'markdown', mark FROM l JOIN d ON doc_id=k+3 AND d.source=l.source)""", **W, **LAST))
def _(t):
    notes = _linked(t)
    found = L.backlink_rows(L.body_links(notes), t.index_rows)
    placed = F.expr("substring(body, int(start) + 1, int(length)) = raw").alias("placed")
    return found.join(notes.select(F.col("path").alias("src_path"), "body"), "src_path").select(
        "path", "n_notes", "src_path", "line", "in_code", "form", "raw", placed)


@probe("relink_bodies", twin(body="""
    SELECT l.path, true AS same_before, '[['||CASE WHEN a.doc_id IS NULL THEN 'Docs/src1/Doc '||(k+1) WHEN a.doc_id%5=0 THEN 'Archive/Doc '||a.doc_id ELSE 'Doc '||a.doc_id END||'#h]] '
      ||'[['||CASE WHEN b.doc_id IS NULL THEN 'src2/Doc '||(k+2) WHEN b.doc_id%5=0 THEN 'Archive/Doc '||b.doc_id ELSE 'Doc '||b.doc_id END||'|d]] `[[Part 3]]` '||mark AS last
    FROM l LEFT JOIN d a ON a.doc_id=k+1 AND a.source='src1' LEFT JOIN d b ON b.doc_id=k+2 AND b.source='src2'
    WHERE a.doc_id IS NOT NULL OR b.doc_id IS NOT NULL""", **W, **LAST))
def _(t):
    notes = _linked(t)
    twins = t.document.filter("k % 5 = 0").select(F.concat(F.lit("Other/"), "name").alias("path"), "name")  # names two notes share
    index = t.index_rows.select("path", "name").union(twins)
    moves = B.bulk_move(index, t.document.filter("folder IN ('Docs/src1', 'Docs/src2')"), "Archive")
    done = L.rewrite_bodies(notes, L.body_rewrites(L.body_links(notes), moves, index))
    before = t.written.select("path", F.col("body").alias("old"))
    return done.join(before, "path").select("path", F.startswith("body", "old").alias("same_before"),
                                            F.expr("substring(body, length(old) + 2)").alias("last"))


@probe("body_link_suggestions", twin("index_n", body="""
    SELECT q.query, n.name, levenshtein(lower(q.query), lower(n.name)) AS distance FROM (SELECT DISTINCT 'NATOIN_'||k%25 AS query FROM w
      UNION SELECT 'Part '||k%2500 FROM w, parts WHERE k%2500 > last_part) q
    JOIN (SELECT DISTINCT name FROM index_n) n ON levenshtein(lower(q.query), lower(n.name)) BETWEEN 1 AND 2
    QUALIFY row_number() OVER (PARTITION BY q.query ORDER BY distance, n.name) <= 3""", **W))
def _(t):
    broken = T.broken_body_wikilinks(t.written, R.build_targets(t.index_rows, t.aliases)).select(F.col("target").alias("query"))
    close = M.close_matches(broken, t.index_rows.select("name"), 2, 3)
    return close.select("query", "name", F.col("distance").cast("bigint").alias("distance"))


@probe("close_matches", twin("supplier_n", "index_n", body="""
    SELECT a.name AS query, b.name, levenshtein(lower(a.name), lower(b.name)) AS distance FROM supplier_n a JOIN (SELECT DISTINCT name FROM index_n) b
    ON levenshtein(lower(a.name), lower(b.name)) BETWEEN 1 AND 2"""))
def _(t):
    return M.close_matches(t.supplier.select(F.col("name").alias("query")), t.index_rows.select("name"), 2).select(
        "query", "name", F.col("distance").cast("bigint").alias("distance"))


def _known(t):
    return M.surfaces(t.index_rows, t.aliases)


HITS = {"m": """
    SELECT path, n0+1 AS line, 'Part '||k%2500 AS text, 'exact' AS tier, 'Part '||k%2500 AS canonical, 'name' AS kind, 1::BIGINT AS n_targets FROM w, parts WHERE k%2500 <= last_part UNION ALL
    SELECT path, n0+1, 'NATION_'||k%30, 'exact', 'NATION_'||k%30, 'name', 1 FROM w WHERE k%30 < 25 UNION ALL
    SELECT path, n0+1, CASE WHEN k%2=0 THEN 'red widget' ELSE 'Blue Bolt' END, 'ambiguous', NULL, NULL,
      (SELECT count(*) FROM part WHERE p_name = CASE WHEN k%2=0 THEN 'red widget' ELSE 'blue bolt' END) FROM w UNION ALL
    SELECT path, n0+1, 'Doc '||(k+1), 'exact', 'Doc '||(k+1), 'name', 1 FROM w, top WHERE k < last_doc UNION ALL
    SELECT path, n0+7, 'NATION_3', 'exact', 'NATION_3', 'name', 1 FROM w"""}


@probe("mentions_exact", twin(body="SELECT * FROM m WHERE tier='exact'", **W, **HITS))
def _(t):
    return M.mentions(t.written, _known(t)).filter("tier = 'exact'").drop("start", "end")


@probe("mentions_ambiguous", twin(body="""
    SELECT path, line, text, n_targets, listed AS candidates FROM m JOIN
      (SELECT p_name, string_agg('Part '||p_partkey, ',' ORDER BY 'Part '||p_partkey) AS listed FROM part GROUP BY 1) ON p_name=lower(text)
    WHERE tier='ambiguous'""", **W, **HITS))
def _(t):
    found = M.mentions(t.written, _known(t), candidates=True).filter("tier = 'ambiguous'")
    return found.select("path", "line", "text", "n_targets", F.array_join("candidates", ",").alias("candidates"))


@probe("mention_candidates", twin(body="""
    SELECT p_name AS key, 'Part '||p_partkey AS canonical FROM part WHERE p_name IN (SELECT lower(text) FROM m WHERE tier='ambiguous')""", **W, **HITS))
def _(t):
    return M.mention_candidates(M.mentions(t.written, _known(t)), _known(t))


@probe("mention_excludes", twin(body="SELECT path, line, text FROM m WHERE tier='exact' AND text NOT LIKE 'Part%' AND text NOT LIKE 'Doc%'", **W, **HITS))
def _(t):
    notes = M.mention_excludes(t.frames("region", "nation", "supplier", "part", "document"), ["part"],
                               F.startswith("path", F.lit("Docs/")))
    known = M.surfaces(notes.filter("NOT excluded"))
    return M.mentions(t.written, known).select("path", "line", "text")


@probe("apply_mention_links", twin(body="""
    SELECT path, '\nAsk '||CASE WHEN k%2500 <= last_part THEN '[[Part '||k%2500||']]' ELSE 'Part '||k%2500 END||' near '||
      CASE WHEN k%30<25 THEN '[[NATION_'||k%30||']]' ELSE 'NATION_'||k%30 END||' with '||CASE WHEN k%2=0 THEN 'red widget' ELSE 'Blue Bolt' END||' for '||
      CASE WHEN k < last_doc THEN '[[Doc '||(k+1)||']]' ELSE 'Doc '||(k+1) END||' by Doc '||k||' hand.' AS line FROM w, parts, top""", **W))
def _(t):
    linked = M.apply_mention_links(t.written, M.mentions(t.written, _known(t)))
    return linked.select("path", F.regexp_extract("body", r"(\nAsk [^\n]*hand\.)", 1).alias("line"))


@probe("word_forms", twin("document_n", body="""
    SELECT lower(form) AS word, form, path, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(body, '[\\p{L}\\p{N}][\\p{L}\\p{N}_''-]*')) AS form FROM document_n)
    GROUP BY 1,2,3"""))
def _(t):
    return M.word_forms(t.document)


COMMON = {"f": """SELECT lower(form) AS word, form, path, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(body, '[\\p{L}\\p{N}][\\p{L}\\p{N}_''-]*')) AS form FROM document_n) GROUP BY 1,2,3""",
          "names": "SELECT 'Words/'||word AS path, upper(left(word,1))||substr(word,2) AS name, word FROM (SELECT DISTINCT word FROM f WHERE regexp_matches(word,'^[a-z]+$'))"}


@probe("common_name_damping", twin("document_n", body="""
    SELECT path, name FROM (SELECT n.path, n.name, count(DISTINCT f.path) AS notes, sum(f.n) AS total, coalesce(sum(f.n) FILTER (f.form=n.name),0) AS canon
      FROM names n JOIN f ON f.word=n.word GROUP BY 1,2) WHERE notes>=3 AND (total-canon)/total > 0.5""", **COMMON))
def _(t):
    forms = M.word_forms(t.document, first=True)
    words = forms.select("word").distinct().filter(F.col("word").rlike("^[a-z]+$"))
    names = words.select(F.concat(F.lit("Words/"), "word").alias("path"),
                         F.concat(F.upper(F.substring("word", 1, 1)), F.substr("word", F.lit(2), F.length("word"))).alias("name"))
    return M.common_names(names, forms)


STOP = "[" + ",".join(f"'{w}'" for w in M.STOP_WORDS) + "]"


@probe("frequent_terms", twin("document_n", body=r"""
    SELECT min(shown) AS term, sum(n)::BIGINT AS mentions, count(*) AS notes FROM
      (SELECT lower(term) AS key, path, count(*) AS n, min(term) AS shown FROM terms GROUP BY 1,2) GROUP BY key
      HAVING sum(n) >= 4 AND count(*) >= 2 ORDER BY mentions DESC, notes DESC, term LIMIT 25""",
    stop=f"SELECT {STOP} AS s",
    runs=r"""SELECT path, unnest(regexp_extract_all(regexp_replace(regexp_replace(body,'[ \t]+',' ','g'), '(\A|[\n.!?]) ?([\p{Lu}\p{Lt}])', '\1§\2', 'g'),
        '§?[\p{Lu}\p{Lt}][\p{L}\p{M}''-]*(?: [\p{Lu}\p{Lt}][\p{L}\p{M}''-]*){0,2}')) AS run FROM document_n""",
    words=r"SELECT path, starts_with(run,'§') AS opened, string_split(regexp_replace(replace(run,'§',''), '[''-]+$', ''), ' ') AS ws FROM runs",
    cutw="""SELECT path, opened, ws, list_position(list_transform(ws, lambda w: NOT list_contains(s, lower(w))), true) AS first FROM words, stop""",
    kept="SELECT path, opened AND first=1 AS opened, ws[first:] AS ws FROM cutw WHERE first IS NOT NULL",
    terms="SELECT path, array_to_string(ws,' ') AS term FROM kept WHERE len(ws)>1 OR (length(ws[1])>=4 AND NOT opened)"))
def _(t):
    return M.frequent_terms(t.document, _known(t))


@probe("mentions_fuzzy", twin("nation_n", body="""
    SELECT path, line, phrase, name, distance, row_number() OVER (PARTITION BY path ORDER BY distance, name)::INT AS rank FROM
      (SELECT w.path, n0+1 AS line, 'NATIUN_'||w.k%25 AS phrase, name, levenshtein('natiun_'||w.k%25, lower(name))::INT AS distance FROM w
       JOIN nation_n ON levenshtein('natiun_'||w.k%25, lower(name)) BETWEEN 1 AND 2) QUALIFY rank <= 3""",
    w="SELECT 'Docs/'||source||'/Doc '||doc_id AS path, doc_id AS k, " + N0 + "::INT AS n0 FROM documents"))
def _(t):
    known = M.surfaces(t.frames("nation", "supplier"))
    notes = t.document.select("path", F.concat("body", F.lit("\nWe met NATIUN_"), F.col("k") % 25,
                                               F.lit(" today.")).alias("body"))
    return M.mentions_fuzzy(notes, known)
