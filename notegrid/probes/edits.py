"""Bulk edits, migrations and repairs."""

from pyspark.sql import functions as F

from notegrid.operators import bulk as B
from notegrid.operators import evolve as V
from notegrid.operators import headers as E
from notegrid.operators import repair as X
from notegrid.operators import rules as Q
from notegrid.probes.quality import ALL, D
from notegrid.probes.registry import probe, twin
from notegrid.sources.tables import ASOF, header, quoted

COLS = ["path", "seq", "operation", "field", "old", "new", "new_field"]
# Order headers for edits: tags is absent, a scalar or a list by key.
O = {"o": """SELECT 'Order '||o_orderkey AS path, o_orderkey AS k, o_orderstatus AS status,
    CASE o_orderkey%4 WHEN 0 THEN NULL WHEN 1 THEN '"new"' WHEN 2 THEN '["new","hot"]' ELSE '["cold"]' END AS tags, o_orderpriority AS priority FROM orders"""}


def _notes(t):
    k = F.col("o_orderkey") % 4
    tags = F.when(k == 1, '"new"').when(k == 2, '["new","hot"]').when(k == 3, '["cold"]')
    return t.read("orders").select(
        F.concat(F.lit("Order "), "o_orderkey").alias("path"), F.col("o_orderkey").alias("k"),
        F.lit("order").alias("type"),
        F.parse_json(header(type=F.lit('"order"'), status=quoted(F.col("o_orderstatus")), tags=tags,
                            priority=quoted(F.col("o_orderpriority")))).alias("fm"))


def _row(op, field, old, new, where, new_field="NULL", seq=0):
    return (f"SELECT path, {seq} AS seq, '{op}' AS operation, '{field}' AS field, {old} AS old, "
            f"{new} AS new, {new_field} AS new_field FROM o WHERE {where}")


Q_STATUS, Q_PRIO = "'\"'||status||'\"'", "'\"'||priority||'\"'"


@probe("bulk_set", twin(body=_row("set", "status", Q_STATUS, "'\"F\"'", "status<>'F'"), **O))
def _(t):
    return B.bulk(_notes(t), [B.bulk_set("status", B.literal("F"))])


@probe("bulk_clear", twin(body=_row("clear", "tags", "tags", "NULL", "tags IS NOT NULL"), **O))
def _(t):
    return B.bulk(_notes(t), [B.bulk_set("tags", B.literal(""))])


@probe("bulk_delete", twin(body=_row("delete", "tags", "tags", "NULL", "tags IS NOT NULL"), **O))
def _(t):
    return B.bulk(_notes(t), [B.bulk_delete("tags")])


@probe("bulk_rename", twin(body=_row("rename", "tags", "tags", "tags", "tags IS NOT NULL", "'labels'"), **O))
def _(t):
    return B.bulk(_notes(t), [B.bulk_rename("tags", "labels")])


@probe("rename_conflicts", twin(body="SELECT path FROM o WHERE tags IS NOT NULL", **O))
def _(t):
    return B.rename_conflicts(_notes(t), "tags", "status")


APPEND = "CASE k%4 WHEN 0 THEN '[\"hot\"]' WHEN 1 THEN '[\"new\",\"hot\"]' WHEN 3 THEN '[\"cold\",\"hot\"]' END"


@probe("bulk_append", twin(body=_row("append", "tags", "tags", APPEND, "k%4<>2"), **O))
def _(t):
    return B.bulk(_notes(t), [B.bulk_append("tags", "hot")])


REMOVE = "CASE k%4 WHEN 2 THEN '[\"hot\"]' END"


@probe("bulk_remove", twin(body=_row("remove", "tags", "tags", REMOVE, "k%4 IN (1,2)"), **O))
def _(t):
    return B.bulk(_notes(t), [B.bulk_remove("tags", "new")])


CHAIN = " UNION ALL ".join([
    _row("append", "tags", "tags", APPEND, "k%4<>2"),
    _row("rename", "tags", f"coalesce({APPEND}, tags)", f"coalesce({APPEND}, tags)", "true", "'labels'", 1),
    _row("set", "count", "NULL", "'3'", "true", seq=2)])


@probe("bulk_chain", twin(body=CHAIN, **O))
def _(t):
    return B.bulk(_notes(t), _chain())


def _chain():
    return [B.bulk_append("tags", "hot"), B.bulk_rename("tags", "labels"),
            B.bulk_set("count", B.literal("3"))]


@probe("bulk_apply", twin(body=f"SELECT path, coalesce({APPEND}, tags) AS labels, 3 AS n, status FROM o", **O))
def _(t):
    done = B.bulk_apply(_notes(t), _chain())
    return done.select("path", F.to_json(F.try_variant_get("fm", "$.labels", "variant")).alias("labels"),
                       F.try_variant_get("fm", "$.count", "int").alias("n"),
                       F.try_variant_get("fm", "$.status", "string").alias("status"))


@probe("apply_changes", twin(body=f"SELECT path, coalesce({APPEND}, tags) AS labels, 3 AS n, status FROM o", **O))
def _(t):
    done = E.apply_changes(_notes(t), B.bulk(_notes(t), _chain()))
    return done.select("path", F.to_json(F.try_variant_get("fm", "$.labels", "variant")).alias("labels"),
                       F.try_variant_get("fm", "$.count", "int").alias("n"),
                       F.try_variant_get("fm", "$.status", "string").alias("status"))


@probe("bulk_limit", twin(body=_row("set", "status", Q_STATUS, "'\"F\"'", "path IN (SELECT path FROM o WHERE status<>'F' ORDER BY path LIMIT 40)"), **O))
def _(t):
    return B.bulk_limit(B.bulk(_notes(t), [B.bulk_set("status", "F")]), 40)


@probe("bulk_summary", twin(body=f"SELECT count(*) AS matched, (SELECT count(DISTINCT path) FROM ({CHAIN})) AS affected, (SELECT count(*) FROM ({CHAIN})) AS n_changes FROM o", **O))
def _(t):
    return B.bulk_summary(_notes(t), B.bulk(_notes(t), _chain()))


@probe("backup_rows", twin(body="SELECT path, 'set status=F' AS backup_of FROM o WHERE status<>'F'", **O))
def _(t):
    notes = _notes(t)
    return B.backup_rows(notes, B.bulk(notes, [B.bulk_set("status", "F")]), "set status=F").select("path", "backup_of")


@probe("bulk_move", twin("part_n", body="""
    SELECT path, name, 'Archive/'||name AS new_path, CASE WHEN size>40 THEN 'destination exists' END AS error FROM part_n WHERE kind='SMALL'"""))
def _(t):
    taken = t.part.filter("size > 40").select(F.concat(F.lit("Archive/"), "name").alias("path"), "name")
    return B.bulk_move(t.part.select("path", "name").union(taken), t.part.filter("kind = 'SMALL'"), "Archive")


@probe("relink", twin("order_n", "customer_n", body="""
    SELECT o.path AS src_path, 'parent' AS field, '[['||c.path||'#h|'||c.name||']]' AS raw, '[['||c.name||'#h|'||c.name||']]' AS new_raw
    FROM order_n o JOIN customer_n c ON c.k=o.o_custkey WHERE c.segment='BUILDING'"""))
def _(t):
    moves = B.bulk_move(t.index_rows, t.customer.filter("segment = 'BUILDING'"), "Moved")
    owners = t.customer.select(F.col("path").alias("resolved_path"), "name", F.col("k").alias("c"))
    links = t.order.select(F.col("path").alias("src_path"), F.regexp_extract("parent", r"(\d+)", 1).cast("bigint").alias("c")) \
        .join(owners, "c").select("src_path", F.lit("parent").alias("field"), F.concat(
            F.lit("[["), "resolved_path", F.lit("#h|"), "name", F.lit("]]")).alias("raw"), "resolved_path")
    return B.relink(links, moves, t.index_rows)


# ---- migrations

@probe("migrate_add", twin(body=_row("add-field", "tags", "NULL", "'[]'", "tags IS NULL"), **O))
def _(t):
    return V.migrate(_notes(t), [V.of_type("order", V.migrate_add("tags", "[]"))])


@probe("migrate_remove", twin(body=_row("remove-field", "tags", "tags", "NULL", "tags IS NOT NULL"), **O))
def _(t):
    return V.migrate(_notes(t), [V.migrate_remove("tags")])


@probe("migrate_rename", twin(body=_row("rename-field", "priority", Q_PRIO, Q_PRIO, "true", "'urgency'") + " UNION ALL "
                              + _row("rename-field", "status", Q_STATUS, Q_STATUS, "tags IS NULL", "'tags'", seq=1), **O))
def _(t):
    return V.migrate(_notes(t), [V.migrate_rename("priority", "urgency"), V.migrate_rename("status", "tags")])


@probe("migrate_options", twin(body=_row("clear-invalid-options", "status", Q_STATUS, "NULL", "status='P'") + " UNION ALL "
                                + _row("clear-invalid-options", "tags", "tags", "CASE k%4 WHEN 2 THEN '[\"new\"]' WHEN 3 THEN '[]' END", "k%4 IN (2,3)", seq=1), **O))
def _(t):
    return V.migrate(_notes(t), [V.migrate_options("status", ["O", "F"]), V.migrate_options("tags", ["new"])])


@probe("migrate_widen", twin(body=_row("widen-to-multiple", "tags", "tags", "'['||tags||']'", "k%4=1"), **O))
def _(t):
    return V.migrate(_notes(t), [V.migrate_widen("tags")])


@probe("migrate_links", twin("customer_n", body="""
    SELECT path, 0 AS seq, 'normalize-links' AS operation, 'parent' AS field, '"'||parent||'"' AS old,
      '"['||trim(parent,'[]')||']('||trim(parent,'[]')||'.md)"' AS new, NULL AS new_field FROM customer_n"""))
def _(t):
    notes = t.customer.select("path", "type", F.parse_json(header(parent=quoted(F.col("parent")))).alias("fm"))
    return V.migrate(notes, [V.migrate_links("parent", "markdown")])


@probe("migrate_preview", twin(body="SELECT * FROM (" + _row("add-field", "tags", "NULL", "'[]'", "tags IS NULL") + ") ORDER BY path LIMIT 200", **O))
def _(t):
    return V.migrate_preview(V.migrate(_notes(t), [V.migrate_add("tags", "[]")]))


@probe("migrate_blocker", twin(body="SELECT path, 'status' AS field FROM o WHERE status='P'", **O))
def _(t):
    notes = _notes(t)
    changes = V.migrate(notes, [V.migrate_options("status", ["O", "F"]), V.migrate_remove("tags")])
    return V.migrate_blocker(changes, notes, t.schema).select("path", "field")


# ---- repairs

NULLS = "NULL AS new_field"
FIXES = {
    "fix_default": f"SELECT path, 'priority' AS field, '\"\"' AS old, '\"5-LOW\"' AS new, {NULLS} FROM t WHERE priority=''",
    "fix_enum_case": f"SELECT path, 'status' AS field, '\"'||status||'\"' AS old, '\"'||upper(status)||'\"' AS new, {NULLS} FROM t WHERE status IN ('o','f','p')",
    "fix_boolean": f"SELECT path, 'rush' AS field, '\"True\"' AS old, 'true' AS new, {NULLS} FROM t WHERE rush='True'",
    "fix_date": f"SELECT path, 'ordered' AS field, '\"'||ordered||'\"' AS old, '\"'||day||'\"' AS new, {NULLS} FROM t WHERE k%31=7",
    "fix_list": f"""SELECT path, 'tags' AS field, CASE tags WHEN 'twice' THEN '["a","a"]' WHEN 'holes' THEN '["a",null," "]' WHEN 'mixed' THEN '[1,"b"]' ELSE '[["x","y"]]' END AS old,
        CASE tags WHEN 'twice' THEN '["a"]' WHEN 'holes' THEN '["a"]' WHEN 'mixed' THEN '["1","b"]' ELSE '["x","y"]' END AS new, {NULLS} FROM t WHERE tags<>'solo'""",
    "fix_link": f"SELECT path, 'parent' AS field, '\"'||parent||'\"' AS old, CASE WHEN k%103=23 THEN '\"'||parent||']\"' ELSE '\"[['||parent||']]\"' END AS new, {NULLS} FROM t WHERE parent NOT LIKE '[[%]]'",
    "fix_scalar": f"""SELECT path, 'total' AS field, CASE total_is WHEN 'text' THEN '"'||k||'"' ELSE '['||k||']' END AS old, k::VARCHAR AS new, {NULLS} FROM t WHERE total_is IN ('text','list')
        UNION ALL SELECT path, 'rush', '"True"', 'true', NULL FROM t WHERE rush='True'
        UNION ALL SELECT path, 'tags', '"solo"', '["solo"]', NULL FROM t WHERE tags='solo'""",
    "fix_key": """SELECT path, 'Priority' AS field, '"'||cased||'"' AS old, '"'||cased||'"' AS new, 'priority' AS new_field FROM t WHERE cased IS NOT NULL AND coalesce(priority,'')=''
        UNION ALL SELECT path, 'tag', '"q"', '"q"', 'tags' FROM t WHERE k%89=20 AND tags IS NULL""",
}


def _fix_probe(name):
    @probe(name, twin(body=FIXES[name], **D))
    def _(t):
        return X.repair_fields(t.drifted, t.schema, [name]).drop("seq", "operation")


for _name in FIXES:
    _fix_probe(_name)


@probe("repair", twin(body="""
    """ + " UNION ALL BY NAME ".join(
    f"SELECT * FROM ({q})" + (" WHERE field <> 'rush'" if n == "fix_scalar" else "") for n, q in FIXES.items()), **D))
def _(t):
    return X.repair_fields(t.drifted, t.schema).drop("seq", "operation")


@probe("repair_then_audit", twin(body="""
    SELECT code, count(*) + CASE WHEN code='wrong-scalar-type' THEN (SELECT count(*) FROM t WHERE k%89=20 AND tags IS NULL) ELSE 0 END AS n FROM i WHERE code IN ('derived-field-persisted','invalid-option','invalid-date-format','wrong-scalar-type','unknown-field') AND NOT
      (code='invalid-option' AND value IN ('o','f','p')) AND NOT (code IN ('invalid-date-format','wrong-scalar-type') AND auto_fixable)
      AND NOT (code='unknown-field' AND field='Priority' AND path IN (SELECT path FROM t WHERE coalesce(priority,'')=''))
      AND NOT (code='unknown-field' AND field='tag' AND path IN (SELECT path FROM t WHERE tags IS NULL)) GROUP BY 1""", **ALL))
def _(t):
    fixed = E.apply_changes(t.drifted, X.repair_fields(t.drifted, t.schema))
    return Q.field_issues(fixed, t.schema, ["derived-field-persisted", "invalid-option", "invalid-date-format",
                                            "wrong-scalar-type", "unknown-field"]).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"))


@probe("fix_adopt", twin(body="""
    SELECT path, field, '"'||value||'"' AS new FROM (
      SELECT path, 'type' AS field, 'order' AS value FROM d WHERE type IS NULL AND k%131<>28 UNION ALL
      SELECT path, 'priority', '5-LOW' FROM d WHERE type IS NULL AND k%131<>28 AND (NOT headed OR priority IS NULL))""", **D))
def _(t):
    return X.fix_adopt(t.drifted, t.schema).select("path", "field", "new")


@probe("fix_location", twin(body="""
    SELECT path, 'Orders/'||name AS new_path, CASE WHEN k%2=0 THEN 'destination exists' END AS error FROM t WHERE folder='Misc'""", **D))
def _(t):
    taken = t.drifted.filter("k % 2 = 0").select(F.concat(F.lit("Orders/"), "name").alias("path"))
    return X.fix_location(t.drifted, t.schema, t.drifted.select("path").union(taken))


@probe("fix_name", twin(body="""
    SELECT path, folder||'/Order '||k AS new_path, CASE WHEN k%3=0 THEN 'destination exists' END AS error FROM d WHERE k%137=29""", **D))
def _(t):
    taken = t.drifted.filter("k % 3 = 0").select(F.concat("folder", F.lit("/Order "), "k").alias("path"))
    return X.fix_name(t.drifted, t.drifted.select("path").union(taken))


@probe("fix_sections", twin(body="""
    SELECT 'Docs/'||source||'/Doc '||doc_id AS path, chr(10)||chr(10)||'## Links'||chr(10)||chr(10)||chr(10)||'### Tasks'||chr(10) AS added FROM documents"""))
def _(t):
    fixed = X.fix_sections(t.written, {"document": [(2, "Notes"), (2, "Links"), (3, "Tasks")]})
    return fixed.select("path", F.regexp_extract("body", r"(\n\n## Links[\s\S]*)$", 1).alias("added"))


@probe("fix_whitespace", twin("document_n", body="""
    SELECT path, '---'||chr(10)||'type: document'||chr(10)||'lang: '||lang||chr(10)||'---'||chr(10) AS head, body AS rest FROM document_n"""))
def _(t):
    raw = F.concat(F.lit("---\ntype: document  \nlang: "), "lang", F.lit(" \t\n---\n"), "body")
    fixed = t.document.select("path", X.fix_whitespace(raw).alias("raw"))
    head = F.regexp_extract("raw", r"\A(---\n[\s\S]*?\n---\n)", 1)
    return fixed.select("path", head.alias("head"), F.substring("raw", F.length(head) + 1, F.length("raw")).alias("rest"))
