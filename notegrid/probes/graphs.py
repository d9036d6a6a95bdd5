"""Links, hierarchy and lineage."""

from pyspark.sql import functions as F

from notegrid.operators import hierarchy as H
from notegrid.operators import lineage as G
from notegrid.operators import resolve as R
from notegrid.operators import select as S
from notegrid.plans.audit import is_root
from notegrid.probes.registry import probe, twin
from notegrid.session import settle
from notegrid.sources.tables import wiki

TARGETS = {"real": "SELECT lower(name) AS key, path, type FROM index_n UNION SELECT lower(path), path, type FROM index_n",
           "named": "SELECT DISTINCT lower(alias) AS key, path, type FROM part_n",
           "targets": "SELECT * FROM real UNION ALL SELECT * FROM named WHERE key NOT IN (SELECT key FROM real)"}


def _index(t):
    return R.target_index(R.name_rows(t.index_rows, t.aliases))


@probe("orders_under_region", twin("customer_n", "nation_n", "order_n", body="""
    SELECT o.path, o.total, o.ordered, n.name AS nation FROM order_n o
    JOIN customer_n c ON c.k=o.o_custkey JOIN nation_n n ON n.path=c.parent_path
    WHERE n.parent='[[EUROPE]]' AND o.total > 100000
    ORDER BY nation, ordered DESC, o.path"""))
def _(t):
    places = t.frames("region", "nation", "customer")
    links = t.parent_links.filter("src_type <> 'order'")
    index = settle(_index(t))
    edges = H.parent_edges(R.resolve_links(links, index, t.schema))
    target = places.filter("type = 'region' AND name = 'EUROPE'").select("path")
    below = H.descendants_of(edges, target).join(
        t.customer.select("path", F.regexp_extract("parent", r"\[\[(.+)\]\]", 1).alias("nation")), "path")
    rich = S.select_all_of(t.order, t.schema, where="total > 100000")
    links = R.resolve_links(R.extract_links(rich, "parent"), index, t.schema)
    return rich.join(links.select(F.col("src_path").alias("path"), "resolved_path"), "path").join(
        below.select(F.col("path").alias("resolved_path"), "nation"), "resolved_path").select(
        "path", "total", "ordered", "nation").orderBy("nation", F.desc("ordered"), "path")


@probe("build_targets", twin("index_n", body="SELECT key, path, type FROM targets", **TARGETS))
def _(t):
    return R.build_targets(t.index_rows, t.aliases).select("key", "path", "type")


@probe("target_index", twin("index_n", body="""
    SELECT key, count(*) AS n, min(path) AS path FROM targets GROUP BY key""", **TARGETS))
def _(t):
    return _index(t).select("key", "n", "path")


@probe("build_path_map", twin("index_n", body="""
    SELECT key, max(path) AS path FROM real GROUP BY key UNION ALL
    SELECT key, min(path) FROM named WHERE key NOT IN (SELECT key FROM real) GROUP BY key""", **TARGETS))
def _(t):
    return R.path_map(R.build_targets(t.index_rows, t.aliases))


@probe("build_type_map", twin("index_n", body="""
    SELECT name AS key, type FROM index_n UNION SELECT path, type FROM index_n"""))
def _(t):
    return R.type_map(t.index_rows)


# Orders name their part by number (one note) or, every third line, by its shared alias.
LINKS_SQL = {
    "lines": """SELECT DISTINCT l_orderkey, l_partkey FROM lineitem""",
    "asked": """SELECT o.path AS src_path, CASE WHEN l_partkey%3=0 THEN p.alias
        WHEN l_partkey%5=0 THEN 'Part '||(l_partkey+1000000)
        WHEN l_partkey%7=0 THEN 'NATION_'||(l_partkey%25) ELSE p.name END AS target,
        l_partkey FROM lines JOIN order_n o ON o.k=l_orderkey JOIN part_n p ON p.k=l_partkey""",
    **TARGETS,
    "idx": "SELECT key, count(*) AS n, min(path) AS path, count(*) FILTER (type='part') AS n_src, min(path) FILTER (type='part') AS p_src FROM targets GROUP BY key"}


def _part_links(t):
    key = F.col("l_partkey")
    lines = t.read("lineitem").select("l_orderkey", "l_partkey").distinct()
    parts = t.part.select(F.col("k").alias("l_partkey"), "name", "alias")
    orders = t.order.select(F.col("k").alias("l_orderkey"), F.col("path").alias("src_path"))
    target = F.when(key % 3 == 0, F.col("alias")) \
        .when(key % 5 == 0, F.concat(F.lit("Part "), key + 1000000)) \
        .when(key % 7 == 0, F.concat(F.lit("NATION_"), key % 25)).otherwise(F.col("name"))
    return lines.join(parts, "l_partkey").join(orders, "l_orderkey").select(
        "src_path", F.lit("order").alias("src_type"), F.lit("parts").alias("field"),
        wiki(target).alias("raw"), "l_partkey")


@probe("resolve_links", twin("index_n", body="""
    SELECT src_path, l_partkey, target, coalesce(n,0) AS n_candidates,
      CASE WHEN n_src=1 THEN p_src WHEN n_src>1 THEN NULL WHEN n=1 THEN path END AS resolved_path,
      CASE WHEN n IS NULL THEN 'none' WHEN n_src=1 THEN 'unique' WHEN n_src>1 THEN 'ambiguous'
        ELSE 'no-source-match' END AS resolution
    FROM asked LEFT JOIN idx ON key=lower(target)""", **LINKS_SQL))
def _(t):
    return R.resolve_links(_part_links(t), _index(t), t.schema).select(
        "src_path", "l_partkey", "target", "n_candidates", "resolved_path", "resolution")


@probe("link_candidates", twin("index_n", body="""
    SELECT key, path, type FROM targets WHERE key IN
      (SELECT lower(target) FROM asked JOIN idx ON key=lower(target) WHERE n_src>1)""", **LINKS_SQL))
def _(t):
    targets = R.build_targets(t.index_rows, t.aliases)
    links = R.resolve_links(_part_links(t), R.target_index(targets), t.schema)
    return R.link_candidates(links.filter("resolution = 'ambiguous'"), targets)


# A customer's orders: the customer is the source, each order a linked note.
ORDER_LINKS = {"linked": "SELECT c.path AS src_path, o.path AS target, status FROM order_n o JOIN customer_n c ON c.k=o.o_custkey"}


def _order_verdicts(t, predicate):
    links = t.order.select(F.col("path").alias("resolved_path"), F.col("parent").alias("raw"),
                           F.lit("order").alias("src_type"), F.lit("parent").alias("field"))
    owner = R.resolve_links(links.withColumnRenamed("resolved_path", "order_path"), _index(t), t.schema)
    pairs = owner.select(F.col("resolved_path").alias("src_path"),
                         F.col("order_path").alias("resolved_path"))
    return R.relation_quantifier(pairs, t.order, predicate)


@probe("relation_quantifier", twin("order_n", "customer_n", body="""
    SELECT src_path, count(*) AS n_links, count(*) FILTER (status='F') AS n_true,
      bool_or(status='F') AS any_holds, bool_and(status='F') AS all_hold FROM linked GROUP BY 1""", **ORDER_LINKS))
def _(t):
    return _order_verdicts(t, F.col("status") == "F").drop("n_unresolved")


@probe("relation_any", twin("order_n", "customer_n", body="""
    SELECT path FROM customer_n WHERE path IN (SELECT src_path FROM linked WHERE status='P')""", **ORDER_LINKS))
def _(t):
    return R.relation_any(t.customer, _order_verdicts(t, F.col("status") == "P")).select("path")


@probe("relation_all", twin("order_n", "customer_n", body="""
    SELECT path FROM customer_n WHERE path NOT IN (SELECT src_path FROM linked WHERE status='P')""", **ORDER_LINKS))
def _(t):
    return R.relation_all(t.customer, _order_verdicts(t, F.col("status") != "P")).select("path")


LOOKUP = {
    "q": """SELECT DISTINCT CASE k%5 WHEN 0 THEN path WHEN 1 THEN name||'.md' WHEN 2 THEN upper(name)
        WHEN 3 THEN upper(alias) ELSE 'none '||name END AS query FROM part_n""",
    "e": """SELECT 0 AS tier, path AS key, path FROM index_n UNION ALL SELECT 1, name, path FROM index_n
        UNION ALL SELECT 2, lower(name), path FROM index_n UNION ALL SELECT DISTINCT 3, lower(alias), path FROM part_n""",
    "asked": """SELECT query, 0 AS tier, regexp_replace(query,'\\.md$','') AS key FROM q UNION ALL
        SELECT query, 1, regexp_replace(query,'\\.md$','') FROM q UNION ALL
        SELECT query, 2, lower(regexp_replace(query,'\\.md$','')) FROM q UNION ALL
        SELECT query, 3, lower(regexp_replace(query,'\\.md$','')) FROM q""",
    "hits": "SELECT query, tier, count(*) AS n, min(path) AS path FROM asked JOIN e USING (tier, key) GROUP BY 1,2",
    "best": "SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier)=1"}


@probe("exact_lookup", twin("index_n", body="""
    SELECT query, CASE tier WHEN 0 THEN 'path' WHEN 1 THEN 'name' WHEN 2 THEN 'name-ignoring-case'
      WHEN 3 THEN 'alias' END AS tier, coalesce(n,0) AS n, CASE WHEN n=1 THEN path END AS path,
      coalesce(n>1,false) AS ambiguous FROM q LEFT JOIN best USING (query)""", **LOOKUP))
def _(t):
    k = F.col("k") % 5
    q = F.when(k == 0, F.col("path")).when(k == 1, F.concat("name", F.lit(".md"))) \
        .when(k == 2, F.upper("name")).when(k == 3, F.upper("alias")) \
        .otherwise(F.concat(F.lit("none "), F.col("name")))
    return R.exact_lookup(t.part.select(q.alias("query")), t.index_rows, t.aliases)


@probe("backlinks", twin("index_n", body="""
    SELECT p_src AS path, 'parts' AS field, count(*) AS n_links, count(DISTINCT src_path) AS n_sources
    FROM asked JOIN idx ON key=lower(target) WHERE n_src=1 GROUP BY 1 UNION ALL
    SELECT path, 'parts', count(*), count(DISTINCT src_path) FROM asked JOIN idx ON key=lower(target)
    WHERE n_src=0 AND n=1 GROUP BY 1""", **LINKS_SQL))
def _(t):
    return R.backlinks(R.resolve_links(_part_links(t), _index(t), t.schema))


@probe("typed_backlinks", twin("nation_n", "customer_n", "supplier_n", "order_n", body="""
    SELECT parent_path AS path, type AS src_type, 'parent' AS field, count(*) AS n FROM
      (SELECT parent_path, type FROM nation_n UNION ALL SELECT parent_path, type FROM customer_n
       UNION ALL SELECT parent_path, type FROM supplier_n
       UNION ALL SELECT c.path, 'order' FROM order_n JOIN customer_n c ON c.k=o_custkey)
    GROUP BY 1,2"""))
def _(t):
    return R.typed_backlinks(R.resolve_links(t.parent_links, _index(t), t.schema))


@probe("project_links", twin("index_n", "turn_n", body="""
    SELECT path, '[['||CASE WHEN count(*) OVER (PARTITION BY name)=1 THEN name ELSE path END||']]' AS link
    FROM (SELECT path, name FROM index_n UNION ALL SELECT 'Copies/'||name, name FROM part_n WHERE size>40)"""))
def _(t):
    copies = t.part.filter("size > 40").select(F.concat(F.lit("Copies/"), "name").alias("path"), "name")
    return R.shortest_link(t.index_rows.select("path", "name").union(copies))


def _place_edges(t):
    links = t.parent_links.filter("src_type IN ('nation', 'customer', 'supplier')")
    return H.parent_edges(R.resolve_links(links, _index(t), t.schema))


PLACES = {"edge": """SELECT path AS child, 'Places/'||trim(parent,'[]') AS parent FROM nation_n UNION ALL
    SELECT path, parent_path FROM customer_n UNION ALL SELECT path, parent_path FROM supplier_n"""}
NS = ("nation_n", "customer_n", "supplier_n", "region_n")


@probe("parent_edges", twin(*NS, body="SELECT child, parent FROM edge", **PLACES))
def _(t):
    return _place_edges(t)


@probe("children_index", twin(*NS, body="SELECT parent AS path, count(*) AS n_children FROM edge GROUP BY 1", **PLACES))
def _(t):
    return H.children_index(_place_edges(t))


@probe("alias_map", twin("index_n", body="""
    SELECT lower(a) AS alias, min(path) AS path FROM
      (SELECT DISTINCT CASE WHEN k%4=0 THEN 'Alt '||k ELSE alias END AS a, path FROM part_n)
    WHERE lower(a) NOT IN (SELECT lower(name) FROM index_n) GROUP BY 1 HAVING count(*)=1"""))
def _(t):
    alias = F.when(F.col("k") % 4 == 0, F.concat(F.lit("Alt "), F.col("k"))).otherwise(F.col("alias"))
    return H.alias_map(t.index_rows, t.part.select("path", alias.alias("alias")))


@probe("is_root", twin("index_n", body="""
    SELECT path FROM index_n WHERE type IN ('region','part','document')"""))
def _(t):
    return is_root(t.index_rows, t.parent_links, t.schema)


@probe("is_child_of", twin(*NS, body="SELECT child AS path FROM edge WHERE parent='Places/NATION_3'", **PLACES))
def _(t):
    return H.is_child_of(_place_edges(t), "Places/NATION_3")


DOWN = dict(PLACES, down="""SELECT child AS path, parent AS target, 1 AS depth FROM edge WHERE parent IN ('Places/ASIA','Places/NATION_4')
    UNION ALL SELECT e.child, d.target, d.depth+1 FROM down d JOIN edge e ON e.parent=d.path WHERE d.path NOT IN ('Places/ASIA','Places/NATION_4')""")


@probe("is_descendant_of", twin(*NS, body="SELECT path, target, depth::BIGINT AS depth FROM down", **DOWN))
def _(t):
    targets = t.frames("region", "nation").filter("name IN ('ASIA', 'NATION_4')")
    return H.descendants_of(_place_edges(t), targets)


@probe("descendants", twin(*NS, body="SELECT path, depth::BIGINT AS depth FROM down WHERE depth<=1 AND target='Places/ASIA'", **DOWN))
def _(t):
    targets = t.frames("region").filter("name = 'ASIA'")
    return H.descendants_of(_place_edges(t), targets, max_depth=1).select("path", "depth")


@probe("under", twin("order_n", *NS, body="""
    SELECT o.path FROM order_n o JOIN customer_n c ON c.k=o.o_custkey JOIN nation_n n ON n.path=c.parent_path
    WHERE n.parent='[[AFRICA]]'"""))
def _(t):
    links = R.resolve_links(R.extract_links(t.order, "parent"), _index(t), t.schema)
    return H.under(links, _place_edges(t), t.region.filter("name = 'AFRICA'"))


@probe("closure", twin(*NS, body="""
    SELECT child AS path, parent AS ancestor, 1 AS depth FROM edge UNION ALL
    SELECT a.child, b.parent, 2 FROM edge a JOIN edge b ON a.parent=b.child""", **PLACES))
def _(t):
    return H.closure(_place_edges(t))


@probe("tree_rows", twin(*NS, body="""
    SELECT path, root, depth, row_number() OVER (ORDER BY names, path) AS ord FROM (
      SELECT 'Places/'||r_name AS path, 'Places/'||r_name AS root, 0 AS depth, [r_name] AS names FROM region UNION ALL
      SELECT path, 'Places/'||trim(parent,'[]'), 1, [trim(parent,'[]'), name] FROM nation_n UNION ALL
      SELECT c.path, 'Places/'||trim(n.parent,'[]'), 2, [trim(n.parent,'[]'), n.name, c.name]
      FROM (SELECT path, name, parent_path FROM customer_n UNION ALL SELECT path, name, parent_path FROM supplier_n) c
        JOIN nation_n n ON n.path=c.parent_path)"""))
def _(t):
    notes = t.frames("region", "nation", "customer", "supplier")
    return H.tree_rows(notes, _place_edges(t)).select("path", "root", "depth", "ord")


@probe("directory_rows", twin("index_n", body="""
    SELECT d AS folder, depth, sum(CASE WHEN d=folder THEN n ELSE 0 END)::BIGINT AS n_direct, sum(n)::BIGINT AS n_below
    FROM (SELECT folder, n, array_to_string(string_split(folder,'/')[1:i],'/') AS d, (i-1)::INT AS depth
      FROM (SELECT folder, count(*) AS n FROM index_n GROUP BY 1), LATERAL
        (SELECT unnest(range(1, len(string_split(folder,'/'))+1)) AS i)) GROUP BY 1,2"""))
def _(t):
    return H.directory_rows(t.index_rows)


# Parent links bent into rings: nations 0..4 in one, 10..11 in another, 12 on itself, 13 hangs off.
RINGS = """SELECT 'Places/NATION_'||n_nationkey AS child, CASE WHEN n_nationkey<5 THEN 'Places/NATION_'||((n_nationkey+1)%5)
    WHEN n_nationkey IN (10,11) THEN 'Places/NATION_'||(21-n_nationkey) WHEN n_nationkey=12 THEN 'Places/NATION_12'
    WHEN n_nationkey=13 THEN 'Places/NATION_2' ELSE 'Places/'||r_name END AS parent
    FROM nation JOIN region ON n_regionkey=r_regionkey"""


def _ring_edges(t):
    k = F.col("k")
    to = F.when(k < 5, F.concat(F.lit("NATION_"), (k + 1) % 5)) \
        .when(k.isin(10, 11), F.concat(F.lit("NATION_"), F.lit(21) - k)) \
        .when(k == 12, "NATION_12").when(k == 13, "NATION_2") \
        .otherwise(F.regexp_extract("parent", r"\[\[(.+)\]\]", 1))
    nations = t.nation.select(F.col("path").alias("child"), F.concat(F.lit("Places/"), to).alias("parent"))
    return nations.union(_place_edges(t).filter("parent LIKE 'Places/NATION%'"))


@probe("parent_cycles", """
    WITH RECURSIVE e AS (""" + RINGS + """), walk AS (
      SELECT child AS start, child AS at, parent AS nxt, [child] AS trail FROM e UNION ALL
      SELECT start, e.child, e.parent, trail||[e.child] FROM walk JOIN e ON e.child=nxt WHERE NOT list_contains(trail, nxt)),
    ring AS (SELECT start AS path, trail FROM walk WHERE nxt=start)
    SELECT path, list_min(trail) AS cycle, len(trail)::BIGINT AS length,
      ((len(trail) - list_position(trail, list_min(trail)) + 1) % len(trail))::BIGINT AS position FROM ring""")
def _(t):
    return H.parent_cycles(_ring_edges(t))


@probe("closure_cyclic", twin("customer_n", "supplier_n", body="SELECT path, ancestor, min(depth) AS depth FROM walk GROUP BY 1,2",
    e=RINGS + " UNION ALL SELECT path, parent_path FROM customer_n UNION ALL SELECT path, parent_path FROM supplier_n", walk="""
      SELECT child AS path, parent AS ancestor, 1 AS depth, [parent] AS trail FROM e UNION ALL
      SELECT path, e.parent, depth+1, trail||[e.parent] FROM walk JOIN e ON e.child=ancestor WHERE NOT list_contains(trail, e.parent)"""))
def _(t):
    return H.closure(_ring_edges(t))


@probe("would_cycle", twin("customer_n", body="""
    SELECT 'Places/NATION_'||((n_nationkey + k%3)%25) AS child, path AS parent FROM customer_n WHERE k%3=0 UNION ALL
    SELECT path, path FROM customer_n WHERE segment='BUILDING'"""))
def _(t):
    # Proposals to hang a place below a customer; it closes a ring where the place is above it.
    rows = t.read("customer").select(
        F.concat(F.lit("Parties/"), "c_mktsegment", F.lit("/"), F.regexp_replace("c_name", "#", " ")).alias("path"),
        F.col("c_custkey").alias("k"), "c_nationkey")
    place = F.concat(F.lit("Places/NATION_"), (F.col("c_nationkey") + F.col("k") % 3) % 25)
    asked = rows.select(place.alias("child"), F.col("path").alias("parent")).union(
        rows.filter("path LIKE 'Parties/BUILDING/%'").select("path", "path"))
    return H.would_cycle(_place_edges(t), asked)


# Fork lineage: document k was forked from document k/3; every 13th repeats another id, every
# 29th has none, every 31st an unknown parent, every 37th a malformed one.
UID = "substr(md5({0}),1,8)||'-'||substr(md5({0}),9,4)||'-'||substr(md5({0}),13,4)||'-'||substr(md5({0}),17,4)||'-'||substr(md5({0}),21,12)"
FORKS = {
    "f": "SELECT path, k, (CASE WHEN k%29=28 THEN NULL WHEN k%13=12 THEN " + UID.format("(k-1)::VARCHAR")
         + " ELSE " + UID.format("k::VARCHAR") + " END) AS id, (CASE WHEN k%31=30 THEN " + UID.format("(-k)::VARCHAR")
         + " WHEN k%37=36 THEN 'fork of '||k WHEN k%41=40 THEN NULL ELSE " + UID.format("(k//3)::VARCHAR") + " END) AS forked_from FROM document_n",
    "sole": "SELECT id, min(path) AS path FROM f WHERE id IS NOT NULL GROUP BY 1 HAVING count(*)=1",
    "edge": "SELECT f.path AS child, p.path AS parent FROM f JOIN sole s ON s.id=f.id JOIN sole p ON p.id=f.forked_from"}


def _forked(t):
    from notegrid.sources.tables import note_id
    k = F.col("k")
    return t.document.select(
        "path", "k",
        F.when(k % 29 == 28, F.lit(None)).when(k % 13 == 12, F.upper(note_id(k - 1)))
        .otherwise(note_id(k)).alias("id"),
        F.when(k % 31 == 30, note_id(-k)).when(k % 37 == 36, F.concat(F.lit("fork of "), k))
        .when(k % 41 == 40, F.lit(None)).otherwise(note_id(F.floor(k / 3).cast("bigint")))
        .alias("forked_from"))


@probe("lineage_edges", twin("document_n", body="SELECT child, parent FROM edge", **FORKS))
def _(t):
    return G.lineage_edges(_forked(t))


COMP = dict(FORKS, sym="SELECT child AS u, parent AS v FROM edge UNION SELECT parent, child FROM edge",
            reach="SELECT u AS node, u AS seen FROM sym UNION SELECT r.node, b.v FROM reach r JOIN sym b ON b.u=r.seen")


@probe("lineage_component", twin("document_n", body="SELECT node AS path, min(seen) AS component FROM reach GROUP BY 1", **COMP))
def _(t):
    return G.lineage_component(_forked(t))


@probe("lineage_rows", twin("document_n", body="""
    SELECT a.path, (a.depth - t.depth)::BIGINT AS generation, CASE WHEN a.path=t.path THEN 'target'
      WHEN list_contains(t.trail, a.path) THEN 'ancestor' WHEN list_contains(a.trail, t.path) THEN 'descendant'
      ELSE 'related' END AS relationship
    FROM tree a, tree t WHERE t.path=(SELECT path FROM f WHERE k=7) AND a.root=t.root""", **dict(
    FORKS, cut="SELECT child, parent FROM edge WHERE child<>parent",
    tree="""SELECT path AS root, path, 0 AS depth, [path] AS trail FROM (SELECT parent AS path FROM cut EXCEPT SELECT child FROM cut)
        UNION ALL SELECT root, child, depth+1, trail||[child] FROM tree JOIN cut ON cut.parent=tree.path""")))
def _(t):
    target = _forked(t).filter("k = 7").select("path").first()["path"]
    return G.lineage_rows(_forked(t), target)


@probe("lineage_warnings", twin("document_n", body="""
    SELECT path, 'invalid-forked-from' AS code, forked_from AS value FROM f WHERE k%37=36 AND k%31<>30 UNION ALL
    SELECT path, 'missing-lineage-id', id FROM f WHERE forked_from IS NOT NULL AND id IS NULL UNION ALL
    SELECT path, 'duplicate-note-id', CASE WHEN k%13=12 THEN upper(id) ELSE id END FROM f WHERE id IN (SELECT id FROM f WHERE id IS NOT NULL GROUP BY 1 HAVING count(*)>1) UNION ALL
    SELECT path, 'dangling-forked-from', forked_from FROM f WHERE forked_from NOT LIKE 'fork%' AND forked_from NOT IN (SELECT id FROM f WHERE id IS NOT NULL) UNION ALL
    SELECT child, 'fork-cycle', child FROM edge WHERE child=parent""", **FORKS))
def _(t):
    return G.lineage_issues(_forked(t))


@probe("id_preflight", twin("document_n", body="""
    SELECT count(*) FILTER (n=1)::BIGINT AS valid, (SELECT count(*) FROM f WHERE id IS NULL) AS missing, 0::BIGINT AS invalid,
      coalesce(sum(n) FILTER (n>1),0)::BIGINT AS duplicate FROM (SELECT id, count(*) AS n FROM f WHERE id IS NOT NULL GROUP BY 1)""", **FORKS))
def _(t):
    return G.id_preflight(_forked(t))


@probe("fork_delete_guard", twin("document_n", body="""
    SELECT c.path, count(x.path) AS n_children, CASE WHEN max(s.n)>1 THEN 'duplicate-id' WHEN count(x.path)>0 THEN 'has-children' END AS block
    FROM (SELECT * FROM f WHERE path IN (SELECT path FROM document_n WHERE lang='en')) c LEFT JOIN (SELECT path, forked_from FROM f WHERE path NOT IN (SELECT path FROM document_n WHERE lang='en')) x ON x.forked_from=c.id
      LEFT JOIN (SELECT id, count(*) AS n FROM f GROUP BY 1) s ON s.id=c.id GROUP BY 1""", **FORKS))
def _(t):
    return G.fork_delete_guard(_forked(t), t.document.filter("lang = 'en'").select("path"))


@probe("adoption_check", twin("document_n", body="""
    SELECT child, parent, CASE WHEN child=parent THEN 'same-note' WHEN NOT (cu AND pu) THEN 'invalid-id'
      WHEN ff IS NOT NULL AND ff NOT LIKE 'fork%' THEN 'has-provenance' WHEN (parent, child) IN (SELECT path, above FROM up) THEN 'closes-cycle' ELSE 'ok' END AS verdict
    FROM (SELECT c.path AS child, p.path AS parent, coalesce(c.id IN (SELECT id FROM sole),false) AS cu,
        coalesce(p.id IN (SELECT id FROM sole),false) AS pu, c.forked_from AS ff
      FROM f c JOIN f p ON p.k = CASE WHEN c.k%3=0 THEN c.k*3+1 WHEN c.k%3=1 THEN c.k ELSE c.k-1 END)""", **dict(
    FORKS, up="SELECT child AS path, parent AS above FROM edge UNION SELECT u.path, e.parent FROM up u JOIN edge e ON e.child=u.above")))
def _(t):
    notes = _forked(t)
    k = F.col("k")
    to = F.when(k % 3 == 0, k * 3 + 1).when(k % 3 == 1, k).otherwise(k - 1)
    asked = notes.select(F.col("path").alias("child"), to.alias("to_k"))
    pairs = asked.join(notes.select(F.col("k").alias("to_k"), F.col("path").alias("parent")), "to_k")
    return G.adoption_check(notes, pairs.select("child", "parent"))
