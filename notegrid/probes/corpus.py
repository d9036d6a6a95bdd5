"""Sources, sinks, saved queries, structure of raw headers and streams."""

import uuid

from pyspark.sql import functions as F

from notegrid.operators.fields import explode_fields
from notegrid.operators.lineage import UUID
from notegrid.plans.audit import audit
from notegrid.plans.saved import saved_query
from notegrid.probes.quality import ALL, D
from notegrid.probes.registry import probe, twin
from notegrid.probes.texts import W
from notegrid.session import checkpoint_dir
from notegrid.sources import notes as N
from notegrid.sources import sinks as K
from notegrid.sources.tables import ASOF, SCHEMA, header, quoted
from notegrid.streaming.changes import closed, stream_transitions
from notegrid.types import compile_types


@probe("exclude_paths", twin("index_n", body="""
    SELECT path FROM index_n WHERE NOT (starts_with(path,'Parties/BUILDING/') OR starts_with(path,'Docs/') OR path='Places/ASIA')"""))
def _(t):
    return N.exclude_paths(t.index_rows, ["Parties/BUILDING", "Docs/", "Places/ASIA"]).select("path")


@probe("ignore_patterns", twin("index_n", body="""
    SELECT path FROM index_n WHERE NOT ((starts_with(path,'Parts/Brand#1') AND NOT path LIKE 'Parts/Brand#1/Part 1%')
      OR (starts_with(path,'Orders/1995-') AND NOT starts_with(path,'Orders/1995-03/')) OR name='Doc 7')"""))
def _(t):
    return N.ignore_patterns(t.index_rows, [
        ("", "# whole corpus\n/Parts/Brand#1*/\nOrders/1995-*/\nDoc 7\n!Orders/1995-03/\n"),
        ("Parts/Brand#1", "!Part 1*\n")]).select("path")


@probe("dedupe_paths", twin("part_n", body="SELECT DISTINCT path, k FROM part_n"))
def _(t):
    doubled = t.part.select("path", "k").union(t.part.select(F.replace("path", F.lit("/"), F.lit("//")), "k")) \
        .union(t.part.select("path", "k"))
    out = N.dedupe_paths(doubled)
    return out.select(F.regexp_replace("path", "//+", "/").alias("path"), "k")


@probe("read_unmanaged", twin(body="SELECT path FROM d WHERE folder='Misc'", **D))
def _(t):
    return N.read_unmanaged(t.drifted, t.schema).select("path")


@probe("read_owned", twin("order_n", "customer_n", body="""
    SELECT 'Parties/'||c.segment||'/'||c.name||'/orders/'||o.name AS path, 'Parties/'||c.segment||'/'||c.name||'/'||c.name AS owner_path, 'customer' AS owner_type, 'orders' AS field
    FROM order_n o JOIN customer_n c ON c.k=o.o_custkey"""))
def _(t):
    from notegrid.probes.flows import OWN_SCHEMA
    owners = t.customer.select(F.concat("path", F.lit("/"), "name").alias("path"), "name", F.col("path").alias("folder"), "type", "k")
    orders = t.order.withColumn("c", F.regexp_extract("parent", r"(\d+)", 1).cast("bigint")).join(
        owners.select(F.col("k").alias("c"), F.concat("folder", F.lit("/orders")).alias("home")), "c")
    notes = owners.drop("k").unionByName(orders.select(
        F.concat("home", F.lit("/"), "name").alias("path"), "name", F.col("home").alias("folder"), "type"))
    return N.read_owned(notes, compile_types(OWN_SCHEMA))


@probe("compile_types", twin("index_n", body="""
    SELECT path, CASE WHEN type IN ('customer','supplier') THEN 'party' WHEN type IN ('region','nation') THEN 'place' END AS parent,
      CASE type WHEN 'customer' THEN 3 WHEN 'supplier' THEN 2 WHEN 'order' THEN 9 WHEN 'part' THEN 4 WHEN 'document' THEN 6 WHEN 'nation' THEN 1 ELSE 0 END AS n_fields FROM index_n"""))
def _(t):
    counts = t.schema.fields_table(t.spark).groupBy("type").agg(F.count(F.lit(1)).cast("int").alias("n_fields"))
    dim = F.broadcast(t.schema.types_table(t.spark).select("type", "parent").join(counts, "type", "left"))
    return t.index_rows.join(dim, "type").select("path", "parent", F.coalesce("n_fields", F.lit(0)).alias("n_fields"))


@probe("read_saved_query", twin("order_n", body="""
    SELECT path, name, total, status FROM order_n WHERE starts_with(path,'Orders/1996-05/') AND status='F' AND total>50000 ORDER BY total DESC, name LIMIT 30"""))
def _(t):
    return saved_query(t.order, t.schema, {"type": "order", "path": "Orders/1996-05/", "where": ["status = 'F'", "total > 50000"],
                                           "sort": "total", "desc": True, "limit": 30, "fields": ["total", "status"]})


@probe("saved_query_count", twin("document_n", body="SELECT count(*) AS matched FROM document_n WHERE contains(lower(body),'the') AND lang='en'"))
def _(t):
    return saved_query(t.document, t.schema, '{"type": "document", "body": "The", "where": "lang = \'en\'", "count": true}')


@probe("project_rows", twin("document_n", body="SELECT path AS _path, name AS _name, sha256(body) AS revision, lang, chars FROM document_n"))
def _(t):
    return K.project_rows(t.document, ["lang", "chars"], raw="body")


@probe("project_paths", twin("index_n", body="SELECT path FROM index_n"))
def _(t):
    return K.project_paths(t.index_rows)


def _headed(t):
    return t.document.select("path", "name", "folder", "type", "k", "lang", "body", F.parse_json(header(
        type=quoted(F.col("type")), zeta=F.col("k").cast("string"), lang=quoted(F.col("lang")),
        chars=F.col("chars").cast("string"))).alias("fm"))


@probe("write_notes", twin("document_n", body="""
    SELECT path, '---'||chr(10)||'type: "document"'||chr(10)||'lang: "'||lang||'"'||chr(10)||'chars: '||chars||chr(10)||'zeta: '||k||chr(10)||'---'||chr(10)||body AS raw FROM document_n"""))
def _(t):
    notes = _headed(t)
    return notes.select("path", K.render(notes, t.schema).alias("raw"))


@probe("read_notes", twin("document_n", body="SELECT path, name, folder, 'document' AS type, k AS zeta, lang, md5(body) AS body_md5 FROM document_n"))
def _(t):
    """Writes every document as a Markdown file to the shared folder and reads them back."""
    notes = _headed(t)
    root = f"{checkpoint_dir(t.spark).removeprefix('file:')}/notes-{uuid.uuid4().hex}"
    K.write_files(notes.select("path", K.render(notes, t.schema).alias("raw")), root)
    back = N.read_notes(t.spark, root, t.schema)
    return back.select("path", "name", "folder", "type", F.try_variant_get("fm", "$.zeta", "bigint").alias("zeta"),
                       F.try_variant_get("fm", "$.lang", "string").alias("lang"), F.md5("body").alias("body_md5"))


@probe("explode_written", twin("document_n", body="""
    SELECT path, unnest(['type','lang','chars','zeta']) AS key, unnest(['string','string','number','number']) AS shape FROM document_n"""))
def _(t):
    return explode_fields(_headed(t)).select("path", "key", "shape")


# Raw text with structural defects by key.
RAW = {"r": """SELECT 'Docs/'||source||'/Doc '||doc_id AS path, doc_id AS k, text FROM documents"""}


def _raw(t):
    k = F.col("k")
    head = F.concat(F.lit("---\ntype: document\nlang: "), "lang", F.when(k % 5 == 1, "  ").otherwise(""),
                    F.when(k % 7 == 2, F.concat(F.lit("\nlang: "), "lang")).when(k % 7 == 3, "\nlang: xx").otherwise(""),
                    F.lit("\nnote: |\n  kept   \nend: 1\n---\n"))
    raw = F.when(k % 11 == 4, F.concat(F.lit("intro\n"), head, "body")).when(k % 11 == 5, F.col("body")) \
        .otherwise(F.concat(head, "body"))
    return t.document.select("path", raw.alias("raw"))


@probe("structural_scan", twin(body="""
    SELECT path, CASE WHEN k%11=5 THEN 0 ELSE 1 END AS n_blocks, k%11 NOT IN (4,5) AS at_top, k%11<>5 AS has_type, false AS unterminated FROM r""", **RAW))
def _(t):
    s = F.col("s")
    return _raw(t).select("path", N.structural_scan(F.col("raw")).alias("s")).select(
        "path", s["n_blocks"].alias("n_blocks"), s["at_top"].alias("at_top"), s["has_type"].alias("has_type"),
        s["unterminated"].alias("unterminated"))


@probe("rule_structure", twin(body="""
    SELECT path, 'frontmatter-not-at-top' AS code, NULL AS field, NULL::INT AS line, true AS auto_fixable FROM r WHERE k%11=4 UNION ALL
    SELECT path, 'duplicate-frontmatter-keys', 'lang', NULL, k%7=2 FROM r WHERE k%11<>5 AND k%7 IN (2,3) UNION ALL
    SELECT path, 'trailing-whitespace', 'lang', CASE WHEN k%11=4 THEN 4 ELSE 3 END, true FROM r WHERE k%11<>5 AND k%5=1""", **RAW))
def _(t):
    return N.structural_issues(_raw(t)).select("path", "code", "field", F.col("list_index").alias("line"), "auto_fixable")


@probe("fix_structure", twin("document_n", body="""
    SELECT path, CASE WHEN k%11=5 THEN body ELSE '---'||chr(10)||'type: document'||chr(10)||'lang: '||lang||CASE WHEN k%5=1 THEN '  ' ELSE '' END||chr(10)||CASE WHEN k%7=3 THEN 'lang: xx'||chr(10) ELSE '' END||'note: |'||chr(10)||'  kept   '||chr(10)||'end: 1'||chr(10)||'---'||chr(10)||
      CASE WHEN k%11=4 THEN 'intro'||chr(10) ELSE '' END||body END AS raw FROM document_n"""))
def _(t):
    return _raw(t).select("path", N.fix_structure(F.col("raw")).alias("raw"))


@probe("fork_rows", twin("document_n", body="""
    SELECT path||' fork' AS path, true AS fresh_id, k AS source, lang, chars FROM document_n"""))
def _(t):
    from notegrid.operators.fork import fork_rows
    notes = t.document.select("path", "name", "folder", "type", F.parse_json(header(
        type=quoted(F.col("type")), id=quoted(F.col("id")), aliases=F.lit('["a"]'), lang=quoted(F.col("lang")),
        chars=F.col("chars").cast("string"))).alias("fm"), "k", "id")
    copies = fork_rows(notes, t.schema, suffix=" fork")
    get = lambda f, kind="string": F.try_variant_get("fm", f"$['{f}']", kind)
    fresh = get("id").rlike(UUID) & (get("forked-from") == F.col("source_id")) & (get("id") != F.col("source_id")) \
        & get("aliases", "variant").isNull()
    return copies.select("path", fresh.alias("fresh_id"), F.col("k").alias("source"), get("lang").alias("lang"),
                         get("chars", "bigint").alias("chars"))


# ---- the audit plan with rule choice, and the stream

@probe("audit_only", twin(body="SELECT path, code FROM i WHERE code IN ('invalid-option','missing-required')", **ALL))
def _(t):
    return audit(t.drifted, t.schema, ASOF, only=["invalid-option", "missing-required"]).select("path", "code")


@probe("audit_bodies", twin(body="""
    SELECT path, 'malformed-body-wikilink' AS code, '[[]]' AS value, n0+10 AS line FROM w UNION ALL SELECT path, 'malformed-body-wikilink', '[[', n0+10 FROM w UNION ALL
    SELECT path, 'broken-body-wikilink', '[[Part '||k%2500||'|it]]', n0+10 FROM w, parts WHERE k%2500 > last_part UNION ALL
    SELECT path, 'broken-body-wikilink', '[[NATOIN_'||k%25||']]', n0+10 FROM w UNION ALL
    SELECT path, 'missing-body-section', 'Links', NULL FROM w""", **W))
def _(t):
    rows = audit(t.written, t.schema, ASOF, only=["malformed-body-wikilink", "broken-body-wikilink", "missing-body-section"],
                 names=t.index_rows, aliases=t.aliases, sections={"document": [(2, "Notes"), (2, "Links")]})
    return rows.select("path", "code", "value", F.col("list_index").alias("line"))


@probe("transitions_stream", """
    SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE event_type='error' AND before IS DISTINCT FROM 'error'""")
def _(t):
    """The change log read as a stream and closed behind its end; entries come back from the per-batch output."""
    log = t.spark.readStream.schema(t.read("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    base = f"{checkpoint_dir(t.spark)}/transitions-{uuid.uuid4().hex}"
    stream_transitions(closed(log, base, "user_id", "ts", "event_id", "2200-01-01"), base, "user_id", "ts", "event_id", "event_type", "error").awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("event_id", "user_id")
