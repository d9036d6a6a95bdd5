"""Relation rules, ownership, workflow, relative dates, derived fields and templates."""

from pyspark.sql import functions as F

from notegrid.operators import derive as V
from notegrid.operators import evolve as Ev
from notegrid.operators import lineage as G
from notegrid.operators import mentions as M
from notegrid.operators import relative as RD
from notegrid.operators import repair as X
from notegrid.operators import resolve as R
from notegrid.operators import rules as Q
from notegrid.operators import workflow as Wf
from notegrid.operators.naming import side_by_side
from notegrid.plans.audit import audit
from notegrid.probes.graphs import FORKS, LINKS_SQL, _forked, _index, _order_verdicts, _part_links
from notegrid.probes.registry import probe, twin
from notegrid.session import settle
from notegrid.sources.tables import ASOF, SCHEMA, wiki
from notegrid.types import compile_types

# ---- relation rules: customers' parents bent by key

BENT = {"c": """SELECT path, name, CASE WHEN k%11=0 THEN 'NATION_9'||(k%10)||'x' WHEN k%13=1 THEN 'ASIA' WHEN k%17=2 THEN name
    WHEN k%19=3 THEN 'Natoin_'||(k%25) ELSE trim(parent,'[]') END AS target, k FROM customer_n"""}


def _bent(t):
    k = F.col("k")
    target = F.when(k % 11 == 0, F.concat(F.lit("NATION_9"), k % 10, F.lit("x"))).when(k % 13 == 1, "ASIA") \
        .when(k % 17 == 2, F.col("name")).when(k % 19 == 3, F.concat(F.lit("Natoin_"), k % 25)) \
        .otherwise(F.regexp_extract("parent", r"\[\[(.+)\]\]", 1))
    links = t.customer.select(F.col("path").alias("src_path"), F.lit("customer").alias("src_type"),
                              F.lit("parent").alias("field"), wiki(target).alias("raw"))
    return R.resolve_links(links, R.asked_index(R.name_rows(t.index_rows, t.aliases), links), t.schema)


@probe("rule_stale_reference", twin("customer_n", body="""
    SELECT path, 'parent' AS field, '[['||target||']]' AS value FROM c WHERE k%11=0 OR (k%13<>1 AND k%17<>2 AND k%19=3)""", **BENT))
def _(t):
    return Q.link_issues(_bent(t), ["stale-reference"]).select("path", "field", "value")


@probe("rule_invalid_source_type", twin("customer_n", body="""
    SELECT path, '[['||target||']]' AS value FROM c WHERE k%11<>0 AND (k%13=1 OR k%17=2)""", **BENT))
def _(t):
    return Q.link_issues(_bent(t), ["invalid-source-type"]).select("path", "value")


@probe("rule_self_reference", twin("nation_n", "customer_n", body="""
    SELECT path, '[['||name||']]' AS value FROM nation_n WHERE k%4=0"""))
def _(t):
    target = F.when(F.col("k") % 4 == 0, F.col("name")).otherwise(F.regexp_extract("parent", r"\[\[(.+)\]\]", 1))
    links = t.nation.select(F.col("path").alias("src_path"), F.lit("nation").alias("src_type"),
                            F.lit("parent").alias("field"), wiki(target).alias("raw"))
    resolved = R.resolve_links(links, _index(t), t.schema)
    return Q.link_issues(resolved, ["self-reference"]).select("path", "value")


@probe("rule_ambiguous_link_target", twin("index_n", body="""
    SELECT src_path AS path, '[['||target||']]' AS value FROM asked JOIN idx ON key=lower(target) WHERE n_src>1""", **LINKS_SQL))
def _(t):
    resolved = R.resolve_links(_part_links(t), _index(t), t.schema)
    return Q.link_issues(resolved, ["ambiguous-link-target"]).select("path", "value")


@probe("fix_stale_link", twin("customer_n", "index_n", body="""
    SELECT c.path AS src_path, 'parent' AS field, '[['||target||']]' AS raw, '[['||min(n.name)||']]' AS new_raw FROM c
    JOIN (SELECT DISTINCT name FROM index_n) n ON levenshtein(lower(target), lower(n.name)) BETWEEN 1 AND 2
    WHERE c.k%11=0 OR (c.k%13<>1 AND c.k%17<>2 AND c.k%19=3) GROUP BY 1,2,3 HAVING count(*)=1""", **BENT))
def _(t):
    stale = settle(_bent(t).filter("resolution = 'none'").select("src_path", "field", "raw", "target"))
    close = M.close_pairs(stale.select(F.col("target").alias("query")), t.index_rows.select("name"), 2)
    return X.fix_stale_link(stale, close)


# ---- ownership: customers own their orders; every ninth order is claimed by a second customer

OWN_SCHEMA = {**SCHEMA, "types": {**SCHEMA["types"], "customer": {
    **SCHEMA["types"]["customer"], "fields": {**SCHEMA["types"]["customer"]["fields"], "orders": {
        "kind": "relation", "source": ["order"], "multiple": True, "owned": True}}}}}
OWN = {"claims": """SELECT c.path AS owner_path, o.path AS path, o.k FROM order_n o JOIN customer_n c ON c.k=o.o_custkey UNION
    SELECT c.path, o.path, o.k FROM order_n o JOIN customer_n c ON c.k=o.o_custkey+1 WHERE o.k%9=0"""}


def _owned(t):
    mine = F.regexp_extract("parent", r"(\d+)", 1).cast("bigint")
    claims = t.order.select(F.col("path").alias("resolved_path"), "name", F.explode(F.when(
        F.col("k") % 9 == 0, F.array(mine, mine + 1)).otherwise(F.array(mine))).alias("c"))
    owners = t.customer.select(F.col("path").alias("src_path"), F.col("k").alias("c"))
    return claims.join(owners, "c").select(
        "src_path", F.lit("customer").alias("src_type"), F.lit("orders").alias("field"),
        wiki(F.col("name")).alias("raw"), "resolved_path")


def _owners(t):
    return R.owner_index(t.frames("order", "customer"), _owned(t), compile_types(OWN_SCHEMA))


@probe("owner_index", twin("order_n", "customer_n", body="SELECT path, owner_path, 'orders' AS field, true AS declared, false AS located FROM claims", **OWN))
def _(t):
    return _owners(t)


@probe("rule_owned_ambiguous_owner", twin("order_n", "customer_n", body="""
    SELECT path, count(*) AS n_owners FROM claims GROUP BY 1 HAVING count(*) > 1""", **OWN))
def _(t):
    return R.owner_counts(_owners(t)).filter("n_owners > 1").select("path", "n_owners")


@probe("rule_owned_wrong_location", twin("order_n", "customer_n", body="""
    SELECT path, min(owner_path) AS owner_path, regexp_replace(min(owner_path),'/[^/]*$','')||'/orders' AS expected FROM claims GROUP BY 1 HAVING count(*) = 1""", **OWN))
def _(t):
    single = R.owner_counts(_owners(t)).filter("n_owners = 1")
    expected = F.concat(F.regexp_replace("owner_path", r"/[^/]*$", ""), F.lit("/orders"))
    return single.join(t.order.select("path", "folder"), "path").withColumn("expected", expected) \
        .filter("folder <> expected").select("path", "owner_path", "expected")


@probe("audit_owned", twin("order_n", "customer_n", body="""
    SELECT path, 'owned-ambiguous-owner' AS code FROM claims GROUP BY 1 HAVING count(*) > 1 UNION ALL
    SELECT path, 'owned-wrong-location' FROM claims GROUP BY 1 HAVING count(*) = 1""", **OWN))
def _(t):
    """The same rules run by the audit plan, which resolves the raw links itself."""
    notes = t.frames("order", "customer")
    return audit(notes, compile_types(OWN_SCHEMA), "2024-01-01", only=["owned-ambiguous-owner", "owned-wrong-location"],
                 links=_owned(t).drop("resolved_path"), names=t.index_rows).select("path", "code")


@probe("rule_owned_note_referenced", twin("order_n", "customer_n", body="""
    SELECT a.path AS src_path, b.path AS path FROM order_n a JOIN order_n b ON b.k=a.k-1 WHERE b.path IN (SELECT path FROM claims)""", **OWN))
def _(t):
    before = F.concat(F.lit("Order "), (F.col("k") - 1).cast("string"))
    links = t.order.select(F.col("path").alias("src_path"), F.lit("order").alias("src_type"),
                           F.lit("prev").alias("field"), wiki(before).alias("raw"))
    resolved = R.resolve_links(links, _index(t), t.schema)
    return R.may_reference(resolved, _owners(t)).select("src_path", F.col("resolved_path").alias("path"))


# ---- workflow

LAG = {"l": "SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events"}


@probe("previous_values", twin(body="SELECT event_id, user_id, event_type, before FROM l", **LAG))
def _(t):
    return Wf.previous_values(t.read("events"), "user_id", "ts", "event_id", "event_type").select(
        "event_id", "user_id", "event_type", "before")


@probe("transitions", twin(body="SELECT event_id, user_id FROM l WHERE event_type='error' AND before IS DISTINCT FROM 'error'", **LAG))
def _(t):
    return Wf.transitions(t.read("events"), "user_id", "ts", "event_id", "event_type", "error").select(
        "event_id", "user_id")


@probe("guard_check", twin("customer_n", "order_n", body="""
    SELECT c.path, count(o.k) AS n_targets, count(o.k) FILTER (o.status='F') AS n_satisfied,
      CASE WHEN count(o.k) < 5 THEN 'missing' WHEN bool_or(o.priority='1-URGENT') THEN 'stale' WHEN NOT bool_and(o.status='F') THEN 'failed' ELSE 'satisfied' END AS status,
      NOT (count(o.k) >= 5 AND NOT bool_or(o.priority='1-URGENT') AND bool_and(o.status='F')) AS blocked
    FROM customer_n c LEFT JOIN order_n o ON o.o_custkey=c.k GROUP BY 1""")
       .replace("count(o.k) FILTER (o.status='F') AS n_satisfied", "count(o.k) FILTER (o.status='F' AND o.priority<>'1-URGENT') AS n_satisfied"))
def _(t):
    owner = R.resolve_links(t.order.select(
        F.col("path").alias("order_path"), F.col("parent").alias("raw"), F.lit("order").alias("src_type"),
        F.lit("parent").alias("field")), _index(t), t.schema)
    links = owner.select(F.col("resolved_path").alias("src_path"), F.col("order_path").alias("resolved_path"),
                         F.lit("unique").alias("resolution"))
    return Wf.guard_check(t.customer, links, t.order, F.col("status") == "F",
                          stale=F.col("priority") == "1-URGENT", minimum=5)


@probe("effect_patches", twin("order_n", "customer_n", body="""
    SELECT o.path, CASE WHEN o.k%7<>0 THEN c.path END AS target, CASE WHEN o.k%7=0 THEN 'unresolved' END AS error,
      CASE WHEN o.k%7<>0 THEN f END AS field, CASE WHEN o.k%7<>0 THEN CASE f WHEN 'touched' THEN '2001-08-01' ELSE 'bot' END END AS value
    FROM order_n o JOIN customer_n c ON c.k=o.o_custkey, (SELECT unnest(['touched','by']) AS f) WHERE o.status='F' AND (o.k%7<>0 OR f='touched')"""))
def _(t):
    done = t.order.filter("status = 'F'")
    raw = F.when(F.col("k") % 7 == 0, "[[Nobody]]").otherwise(F.col("parent"))
    links = R.resolve_links(R.extract_links(done.withColumn("parent", raw), "parent"), _index(t), t.schema)
    return Wf.effect_patches(done, links, {"touched": "$TODAY", "by": "$ACTOR"}, "now", ASOF, "bot")


REC = {"n": """SELECT path, name, k, status, CASE WHEN k%10=3 THEN left(ordered,7) ELSE ordered END AS deadline, CASE WHEN k%6=0 THEN '[[x]]' END AS next, ordered, priority FROM order_n"""}


def _recurring(t):
    k = F.col("k")
    return t.order.select("path", "name", "k", "status", "priority", "ordered",
                          F.when(k % 10 == 3, F.substring("ordered", 1, 7)).otherwise(F.col("ordered")).alias("deadline"),
                          F.when(k % 6 == 0, "[[x]]").alias("next"))


@probe("rule_recurrence", twin("order_n", body="""
    SELECT path, CASE WHEN k%10=3 THEN 'invalid-recurrence' ELSE 'missing-successor' END AS code FROM n WHERE status='F' AND next IS NULL""", **REC))
def _(t):
    return Wf.recurrence_issues(_recurring(t), "status", "F", "deadline")


SPAWN = dict(REC, due="SELECT *, 'Order '||(k-k%2) AS want FROM n WHERE status='F' AND next IS NULL AND k%10<>3",
             ranked="SELECT *, row_number() OVER (PARTITION BY want ORDER BY path) AS nth FROM due",
             named="SELECT *, want||' '||(nth+1) AS new_name FROM ranked")


@probe("spawn_successors", twin("order_n", body="""
    SELECT path, new_name AS name, strftime(date_trunc('month',ordered::DATE) + INTERVAL 1 MONTH + (day(ordered::DATE)-1)*INTERVAL 1 DAY,'%Y-%m-%d') AS deadline,
      'O' AS status, '[['||name||']]' AS prev, '[['||new_name||']]' AS next_link, NULL AS error FROM named UNION ALL
    SELECT path, NULL, NULL, NULL, NULL, NULL, 'base date missing or partial' FROM n WHERE status='F' AND next IS NULL AND k%10=3""", **SPAWN))
def _(t):
    notes = _recurring(t)
    due = notes.filter("status = 'F' AND next IS NULL")
    want = F.concat(F.lit("Order "), F.col("k") - F.col("k") % 2)
    return Wf.spawn_successors(due, t.order, want, "deadline", 1, "mon", "status", "O")


@probe("retention_actions", twin("order_n", "customer_n", body="""
    SELECT path, 'archive' AS action, 'Archive/'||name AS detail FROM order_n WHERE ordered < '1995-07-01' UNION ALL
    SELECT path, 'tombstone', 'status=X' FROM order_n WHERE ordered >= '2001-07-01' UNION ALL
    SELECT path, 'delete', NULL FROM customer_n WHERE k NOT IN (SELECT o_custkey FROM orders)"""))
def _(t):
    old, new = t.order.filter("ordered < '1995-07-01'"), t.order.filter("ordered >= '2001-07-01'")
    referred = R.resolve_links(R.extract_links(t.order, "parent"), _index(t), t.schema).select(
        F.col("resolved_path").alias("path"))
    return Wf.retention_actions(old, "archive").unionByName(
        Wf.retention_actions(new, "tombstone", tombstone={"status": "X"})).unionByName(
        Wf.retention_actions(t.customer, "delete", referred))


@probe("delete_plan", twin("customer_n", "order_n", "document_n", body="""
    SELECT c.path, count(o.k) AS n_sources, NULL AS block FROM customer_n c LEFT JOIN order_n o ON o.o_custkey=c.k WHERE segment='FURNITURE' GROUP BY 1"""))
def _(t):
    chosen = t.customer.filter("segment = 'FURNITURE'")
    guard = G.fork_delete_guard(_forked(t), chosen).withColumn(
        "block", F.when(F.col("block") != "missing", F.col("block")))
    shouted = R.extract_links(t.order.withColumn("parent", F.upper("parent")), "parent")
    return Wf.delete_plan(chosen, shouted, guard)


# ---- relative dates: each turn is one day after the one before; some conversations are bent

CH = """SELECT 'Chats/'||conv_id||'/Turn '||conv_id||'-'||turn AS node, conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS top FROM conversations"""
REL = {"n": CH}


def _chains(t):
    turn, conv = F.col("turn"), F.col("conv_id")
    name = lambda c: F.concat(F.lit("Chats/"), conv, F.lit("/Turn "), conv, F.lit("-"), c)
    top = t.read("conversations").groupBy("conv_id").agg(F.max("turn").alias("top"))
    rows = t.read("conversations").join(top, "conv_id")
    node = name(turn).alias("node")
    back = rows.filter("turn > 0").select(node, F.lit(1).alias("ord"), F.lit("equal").alias("kind"), name(turn - 1).alias("target"),
                                          F.lit(1).alias("amount"), F.lit("d").alias("unit"))
    ring = rows.filter("turn = 0 AND conv_id % 10 = 3 AND top > 0").select(
        node, F.lit(1).alias("ord"), F.lit("equal").alias("kind"), name(F.col("top")).alias("target"),
        F.lit(1).alias("amount"), F.lit("d").alias("unit"))
    bound = rows.filter("turn = 2").select(
        node, F.lit(2).alias("ord"), F.when(conv % 2 == 0, "after").otherwise("before").alias("kind"), name(F.lit(0)).alias("target"),
        F.lit(1).alias("amount"), F.lit("w").alias("unit"))
    twice = rows.filter("turn = 2 AND conv_id % 7 = 1").select(
        node, F.lit(3).alias("ord"), F.lit("equal").alias("kind"), name(F.lit(0)).alias("target"), F.lit(5).alias("amount"), F.lit("d").alias("unit"))
    lost = rows.filter("turn = 3").select(node, F.lit(4).alias("ord"), F.lit("equal").alias("kind"),
                                          F.lit(None).cast("string").alias("target"), F.lit(0).alias("amount"), F.lit("d").alias("unit"))
    anchors = rows.filter("turn = 0 AND conv_id % 10 NOT IN (3, 4)").select(node, F.lit("2024-01-31").cast("date").alias("day"))
    return back.union(ring).union(bound).union(twice).union(lost), anchors


@probe("relative_dates", twin(body="""
    SELECT node, CASE WHEN conv_id%10 NOT IN (3,4) THEN strftime(DATE '2024-01-31' + turn*INTERVAL 1 DAY,'%Y-%m-%d') END AS day,
      CASE WHEN conv_id%10=3 THEN 'cycle' WHEN conv_id%10=4 THEN 'unanchored' ELSE 'ok' END AS resolution
    FROM n WHERE turn>0 OR (conv_id%10=3 AND top>0)""", **REL))
def _(t):
    constraints, anchors = _chains(t)
    return RD.relative_dates(constraints, anchors).select(
        "node", F.date_format("day", "yyyy-MM-dd").alias("day"), "resolution")


@probe("relative_date_issues", twin(body="""
    SELECT node, 'relative-date-cycle' AS code FROM n WHERE conv_id%10=3 AND top>0 UNION ALL
    SELECT node, 'relative-date-unanchored' FROM n WHERE conv_id%10=4 AND turn>0 UNION ALL
    SELECT node, 'relative-date-invalid-ref' FROM n WHERE turn=3 UNION ALL
    SELECT node, 'relative-date-contradiction' FROM n WHERE turn=2 AND conv_id%7=1 AND conv_id%10 NOT IN (3,4) UNION ALL
    SELECT node, 'relative-date-bound-violation' FROM n WHERE turn=2 AND conv_id%2=0 AND conv_id%10 NOT IN (3,4)""", **REL))
def _(t):
    constraints, anchors = _chains(t)
    return RD.relative_date_issues(constraints, anchors, RD.relative_dates(constraints, anchors))


# ---- derived fields, defaults, templates

DERIVED = compile_types({"types": {"order": {"fields": {
    "late": {"derived": {"expression": "age > 1000 AND status <> 'F'", "type": "boolean"}},
    "age": {"derived": {"expression": f"datediff(DATE'{ASOF}', to_date(ordered))", "type": "number"}},
    "grade": {"derived": {"expression": "quality * 2", "type": "number"}}}}}})


@probe("derive_fields", twin("order_n", body="""
    SELECT path, datediff('day', ordered::DATE, DATE '2001-08-01')::DOUBLE AS age, datediff('day', ordered::DATE, DATE '2001-08-01') > 1000 AND status<>'F' AS late,
      CASE WHEN k%3=0 THEN NULL ELSE (k%5)*2.0 END::DOUBLE AS grade FROM order_n"""))
def _(t):
    rows = t.order.withColumn("quality", F.when(F.col("k") % 3 != 0, F.col("k") % 5)).withColumn("age", F.lit("stored"))
    return V.derive_fields(rows, DERIVED, "order").select("path", "age", "late", "grade")


@probe("apply_defaults", twin(body="""
    SELECT path, 'priority' AS field, '5-LOW' AS value FROM t WHERE coalesce(priority,'')=''""", **__import__("notegrid.probes.quality", fromlist=["D"]).D))
def _(t):
    return V.apply_defaults(t.drifted, t.schema, ASOF)


@probe("stamp_notes", twin("order_n", body="""
    SELECT path, CASE WHEN k%4=0 THEN NULL ELSE status||' '||k||' 08.2001' END AS new_name, 'Order '||k||' '||CASE WHEN k%4=0 THEN '' ELSE status END||' on 2001-08-01 {who} mid' AS new_body
    FROM order_n"""))
def _(t):
    rows = t.order.select("path", "k", "name", F.when(F.col("k") % 4 != 0, F.col("status")).alias("status"))
    return V.stamp_notes(rows, "{status}: {k} {date:MM.YYYY}", "{name} {status} on {date} {who} {level}",
                         {"level": "mid"}, ASOF).select("path", "new_name", "new_body")


@probe("check_constraints", twin("order_n", body="""
    SELECT path, 'total' AS field, 'range' AS rule, 'total is too high' AS message FROM order_n WHERE NOT total < 300000 UNION ALL
    SELECT path, 'status', 'required', 'status must be closed' FROM order_n WHERE status<>'F'"""))
def _(t):
    return V.check_constraints(t.order, [("total", "range", "total < 300000", "total is too high"),
                                         ("status", "required", "status = 'F'", "status must be closed")])


@probe("stamp_related", twin("part_n", body="""
    SELECT path, 'order' AS type, alias||' log'||CASE WHEN no=1 THEN '' ELSE ' '||no END AS name FROM
      (SELECT path, alias, row_number() OVER (PARTITION BY alias ORDER BY path) AS no FROM part_n)"""))
def _(t):
    rows = t.part.select("path", F.col("alias").alias("name"))
    return V.stamp_related(rows, [("order", "{name} log")], t.index_rows).select("path", "type", "name")


# ---- schema evolution

OLD, NEW = {**SCHEMA}, {**SCHEMA, "types": {k: v for k, v in SCHEMA["types"].items() if k != "turn"}}
NEW["types"]["order"] = {**SCHEMA["types"]["order"], "fields": {
    **{k: v for k, v in SCHEMA["types"]["order"]["fields"].items() if k != "rush"},
    "status": {"kind": "select", "required": True, "options": ["O", "F"]},
    "priority": {"kind": "text", "required": True}, "parent": {"kind": "relation", "source": ["customer"], "multiple": True},
    "channel": {"kind": "text", "default": "web"}}}
NEW["types"]["supplier"] = {**SCHEMA["types"]["supplier"], "extends": "place"}
NEW["types"]["parcel"] = {"output_dir": "Parcels"}


def _tables(t):
    old, new = compile_types(OLD), compile_types(NEW)
    types = Ev.diff_types(old.types_table(t.spark), new.types_table(t.spark))
    fields = Ev.diff_fields(old.fields_table(t.spark), new.fields_table(t.spark))
    return types, fields


def _count_orders(t, df):
    """Schema changes with how many notes of the type they touch."""
    touched = t.index_rows.groupBy("type").agg(F.count(F.lit(1)).alias("n_notes"))
    return df.join(touched, "type", "left").withColumn("n_notes", F.coalesce("n_notes", F.lit(0)))


COUNTS = {"n": "SELECT type, count(*) AS n FROM index_n GROUP BY 1"}


@probe("diff_types", twin("index_n", body="""
    SELECT x.type, change, from_parent, to_parent, coalesce(n,0) AS n_notes FROM (VALUES ('parcel','added',NULL,NULL),('supplier','reparented','party','place'),('turn','removed',NULL,NULL)) x(type,change,from_parent,to_parent)
    LEFT JOIN n ON n.type=x.type""", **COUNTS))
def _(t):
    return _count_orders(t, _tables(t)[0])


@probe("diff_fields", twin("index_n", body="""
    SELECT x.type, field, change, aspects, coalesce(n,0) AS n_notes FROM (VALUES ('order','channel','added',NULL),('order','rush','removed',NULL),('order','status','changed','options'),
      ('order','priority','changed','default'),('order','parent','changed','multiple'),('supplier','balance','removed',NULL)) x(type,field,change,aspects) LEFT JOIN n ON n.type=x.type""", **COUNTS))
def _(t):
    return _count_orders(t, _tables(t)[1].withColumn("aspects", F.array_join("aspects", ",")).drop("a", "b"))


@probe("classify_changes", twin("index_n", body="""
    SELECT x.type, field, op, safe, detail, coalesce(n,0) AS n_notes FROM (VALUES ('parcel',NULL,'add-type',true,NULL),('supplier',NULL,'reparent-type',false,NULL),('turn',NULL,'remove-type',false,NULL),
      ('order','channel','add-field',true,'web'),('order','rush','remove-field',false,NULL),('order','status','clear-invalid-options',false,'O, F'),('order','priority','review-field',false,'required without default'),
      ('order','parent','widen-to-multiple',true,NULL),('supplier','balance','remove-field',false,NULL)) x(type,field,op,safe,detail) LEFT JOIN n ON n.type=x.type""", **COUNTS))
def _(t):
    return _count_orders(t, Ev.classify_changes(*_tables(t)))


@probe("suggest_version", twin("index_n", body="SELECT 6::BIGINT AS review, 3::BIGINT AS safe, '3.0.0' AS version, count(*) AS n_notes FROM index_n"))
def _(t):
    version = Ev.suggest_version(Ev.classify_changes(*_tables(t)), "2.4.1")
    return side_by_side(version, t.index_rows.agg(F.count(F.lit(1)).alias("n_notes")))


@probe("undocumented_types", twin("index_n", body="""
    SELECT x.type, coalesce(n,0) AS n_notes FROM (SELECT unnest(['region','nation','customer','supplier','order','part','document','turn']) AS type) x LEFT JOIN n ON n.type=x.type""", **COUNTS))
def _(t):
    from notegrid.operators.fields import undocumented_types
    gaps = undocumented_types(t.schema, t.spark).filter("what = 'type'").select("type")
    return _count_orders(t, gaps)
