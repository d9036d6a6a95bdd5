"""Profiles and quality rules over notes with defects."""

from pyspark.sql import functions as F

from notegrid.operators import fields as P
from notegrid.operators import resolve as R
from notegrid.operators import rules as Q
from notegrid.operators import select as S
from notegrid.plans.audit import audit
from notegrid.probes.registry import probe, twin
from notegrid.sources.tables import ASOF

# The same defects, written once more for the SQL side.
D = {"d0": """SELECT *, o_orderkey AS k, CASE WHEN o_orderkey%137=29 THEN 'Order: ' ELSE 'Order ' END||o_orderkey AS name,
      CASE WHEN o_orderkey%131=28 THEN 'Misc' ELSE 'Orders/'||strftime(o_orderdate,'%Y-%m') END AS folder FROM orders""",
     "d": """SELECT k, folder||'/'||name AS path, name, folder, o_orderstatus, o_orderpriority,
      CASE WHEN k%127=27 THEN NULL WHEN k%109=25 THEN 'ordr' WHEN k%113=26 THEN NULL ELSE 'order' END AS type, k%127<>27 AS headed,
      CASE WHEN k%7=0 THEN lower(o_orderstatus) WHEN k%11=1 THEN 'X' WHEN k%13=2 THEN NULL WHEN k%17=3 THEN '' ELSE o_orderstatus END AS status,
      CASE WHEN k%19=4 THEN 'text' WHEN k%23=5 THEN 'words' WHEN k%29=6 THEN 'list' ELSE 'number' END AS total_is,
      CASE WHEN k%31=7 THEN strftime(o_orderdate,'%Y/%-m/%-d') WHEN k%37=8 THEN 'soon' WHEN k%41=9 THEN strftime(o_orderdate,'%Y') ELSE strftime(o_orderdate,'%Y-%m-%d') END AS ordered,
      strftime(o_orderdate,'%Y-%m-%d') AS day,
      CASE WHEN k%43=10 THEN NULL WHEN k%53=12 THEN '' ELSE o_orderpriority END AS priority,
      CASE WHEN k%43=10 OR k%47=11 THEN o_orderpriority END AS cased,
      CASE WHEN k%3=0 THEN NULL WHEN k%59=13 THEN 'True' WHEN k%61=14 THEN '1' ELSE CASE WHEN k%2=0 THEN 'true' ELSE 'false' END END AS rush,
      CASE WHEN k%67=15 THEN 'twice' WHEN k%71=16 THEN 'holes' WHEN k%73=17 THEN 'solo' WHEN k%79=18 THEN 'mixed' WHEN k%83=19 THEN 'nested' END AS tags,
      CASE WHEN k%103=23 THEN '[[Customer '||k||']' WHEN k%107=24 THEN 'Customer '||k ELSE '[[Customer '||lpad(o_custkey::VARCHAR,9,'0')||']]' END AS parent FROM d0""",
     "t": "SELECT * FROM d WHERE type='order'"}

SQL = {
    "empty-string-required": """SELECT path, 'status' AS field, '' AS value, NULL::INT AS list_index, NULL AS expected, NULL AS suggestion, false AS auto_fixable FROM t WHERE status=''
        UNION ALL SELECT path, 'priority', '', NULL, NULL, NULL, true FROM t WHERE priority=''""",
    "derived-field-persisted": "SELECT path, 'overdue' AS field, 'true' AS value, NULL::INT AS list_index, NULL AS expected, NULL AS suggestion, false AS auto_fixable FROM t WHERE k%101=22",
    "wrong-scalar-type": """SELECT path, 'total' AS field, CASE total_is WHEN 'text' THEN k::VARCHAR WHEN 'words' THEN 'about '||k ELSE '['||k||']' END AS value,
        NULL::INT AS list_index, 'number' AS expected, NULL AS suggestion, total_is<>'words' AND total_is<>'list' AS auto_fixable FROM t WHERE total_is IN ('text','words')
        UNION ALL SELECT path, 'total', '['||k||']', NULL, 'number', NULL, true FROM t WHERE total_is='list'
        UNION ALL SELECT path, 'rush', rush, NULL, 'boolean', NULL, rush='True' FROM t WHERE rush IN ('True','1')
        UNION ALL SELECT path, 'tags', 'solo', NULL, 'list', NULL, true FROM t WHERE tags='solo'""",
    "invalid-date-format": """SELECT path, 'ordered' AS field, ordered AS value, NULL::INT AS list_index, 'day' AS expected,
        CASE WHEN k%31=7 THEN day END AS suggestion, k%31=7 AS auto_fixable FROM t WHERE ordered<>day""",
    "invalid-option": """SELECT path, 'status' AS field, status AS value, NULL::INT AS list_index, 'O, F, P' AS expected,
        CASE WHEN status='X' THEN 'O' ELSE upper(status) END AS suggestion, false AS auto_fixable FROM t WHERE status NOT IN ('O','F','P','')""",
    "unknown-field": """SELECT path, 'Priority' AS field, cased AS value, NULL::INT AS list_index, 'priority' AS expected, 'priority' AS suggestion, coalesce(priority,'')='' AS auto_fixable FROM t WHERE cased IS NOT NULL
        UNION ALL SELECT path, 'tag', 'q', NULL, 'tags', 'tags', false FROM t WHERE k%89=20
        UNION ALL SELECT path, 'totl', '5', NULL, 'total', 'total', false FROM t WHERE k%97=21""",
    "frontmatter-key-casing": """SELECT path, 'Priority' AS field, cased AS value, NULL::INT AS list_index, 'priority' AS expected, NULL AS suggestion,
        coalesce(priority,'')='' AS auto_fixable FROM t WHERE cased IS NOT NULL""",
    "singular-plural-mismatch": """SELECT path, 'tag' AS field, 'q' AS value, NULL::INT AS list_index, 'tags' AS expected, NULL AS suggestion, tags IS NULL AS auto_fixable FROM t WHERE k%89=20""",
    "unknown-enum-casing": """SELECT path, 'status' AS field, status AS value, NULL::INT AS list_index, upper(status) AS expected, NULL AS suggestion, true AS auto_fixable FROM t WHERE status IN ('o','f','p')""",
    "duplicate-list-values": """SELECT path, 'tags' AS field, '["a","a"]' AS value, NULL::INT AS list_index, NULL AS expected, NULL AS suggestion, true AS auto_fixable FROM t WHERE tags='twice'""",
    "invalid-list-element": """SELECT path, 'tags' AS field, NULL AS value, 1 AS list_index, 'null' AS expected, NULL AS suggestion, true AS auto_fixable FROM t WHERE tags='holes'
        UNION ALL SELECT path, 'tags', ' ', 2, 'empty-string', NULL, true FROM t WHERE tags='holes'
        UNION ALL SELECT path, 'tags', '1', 0, 'wrong-type', NULL, true FROM t WHERE tags='mixed'
        UNION ALL SELECT path, 'tags', '["x","y"]', 0, 'nested-list', NULL, true FROM t WHERE tags='nested'""",
    "invalid-boolean-coercion": """SELECT path, 'rush' AS field, 'True' AS value, NULL::INT AS list_index, 'true' AS expected, NULL AS suggestion, true AS auto_fixable FROM t WHERE rush='True'""",
    "malformed-wikilink": """SELECT path, 'parent' AS field, parent AS value, NULL::INT AS list_index, parent||']' AS expected, NULL AS suggestion, true AS auto_fixable FROM t WHERE k%103=23""",
    "format-violation": """SELECT path, 'parent' AS field, parent AS value, NULL::INT AS list_index, 'wikilink' AS expected, NULL AS suggestion, true AS auto_fixable FROM t WHERE parent NOT LIKE '[[%]]'""",
    "missing-frontmatter": "SELECT path, NULL AS field, NULL AS value, NULL::INT AS list_index, NULL AS expected, NULL AS suggestion, k%131<>28 AS auto_fixable FROM d WHERE NOT headed",
    "orphan-file": "SELECT path, NULL AS field, NULL AS value, NULL::INT AS list_index, NULL AS expected, NULL AS suggestion, k%131<>28 AS auto_fixable FROM d WHERE headed AND type IS NULL",
    "invalid-type": "SELECT path, 'type' AS field, type AS value, NULL::INT AS list_index, NULL AS expected, 'order' AS suggestion, false AS auto_fixable FROM d WHERE type='ordr'",
    "unsafe-filename": "SELECT path, NULL AS field, name AS value, NULL::INT AS list_index, 'Order '||k AS expected, NULL AS suggestion, true AS auto_fixable FROM t WHERE k%137=29",
    "wrong-directory": "SELECT path, NULL AS field, 'Misc' AS value, NULL::INT AS list_index, 'Orders' AS expected, NULL AS suggestion, true AS auto_fixable FROM t WHERE folder='Misc'",
    "missing-required": "SELECT path, 'status' AS field, NULL AS value, NULL::INT AS list_index, NULL AS expected, NULL AS suggestion, false AS auto_fixable FROM t WHERE status IS NULL",
}
SEVERITY = {c: "warning" for c in (
    "unknown-field", "frontmatter-key-casing", "singular-plural-mismatch", "unknown-enum-casing",
    "duplicate-list-values", "invalid-list-element", "invalid-boolean-coercion")}
COLS = ["path", "field", "value", "list_index", "expected", "suggestion", "auto_fixable"]


def _field_probe(code):
    @probe(f"rule_{code.replace('-', '_')}", twin(body=SQL[code], **D))
    def _(t):
        return Q.field_issues(t.drifted, t.schema, [code]).select(*COLS)


def _note_probe(code):
    @probe(f"rule_{code.replace('-', '_')}", twin(body=SQL[code], **D))
    def _(t):
        return Q.note_issues(t.drifted, t.schema, ASOF, [code]).select(*COLS)


for _code in Q.FIELD_RULES:
    if _code in SQL:
        _field_probe(_code)
for _code in ("missing-frontmatter", "orphan-file", "invalid-type", "unsafe-filename",
              "wrong-directory", "missing-required"):
    _note_probe(_code)

ALL = {**D, "i": " UNION ALL ".join(
    f"SELECT path, '{c}' AS code, '{SEVERITY.get(c, 'error')}' AS severity, field, value, list_index, expected, suggestion, auto_fixable FROM (SELECT * FROM ({q}))"
    for c, q in SQL.items())}


def _issues(t):
    return Q.field_issues(t.drifted, t.schema).unionByName(Q.note_issues(t.drifted, t.schema, ASOF))


@probe("audit", twin(body="SELECT * FROM i", **ALL))
def _(t):
    return audit(t.drifted, t.schema, ASOF, only=list(SQL))


@probe("audit_summary", twin(body="""
    SELECT (SELECT count(*) FROM d) AS files_checked, count(*) FILTER (e>0) AS files_with_errors, count(*) FILTER (w>0) AS files_with_warnings,
      sum(e)::BIGINT AS total_errors, sum(w)::BIGINT AS total_warnings FROM
      (SELECT path, count(*) FILTER (severity='error') AS e, count(*) FILTER (severity='warning') AS w FROM i GROUP BY 1)""", **ALL))
def _(t):
    return Q.audit_summary(_issues(t), t.drifted.select("path"))


@probe("only_issue", twin(body="SELECT path, code FROM i WHERE code='invalid-option'", **ALL))
def _(t):
    return S.only_issue(_issues(t), "invalid-option").select("path", "code")


@probe("ignore_issue", twin(body="SELECT path, code FROM i WHERE code<>'unknown-field'", **ALL))
def _(t):
    return S.ignore_issue(_issues(t), "unknown-field").select("path", "code")


VALID = {"v": """SELECT path, 'error' AS severity, 'required_field_missing' AS code, 'status' AS field FROM t WHERE coalesce(status,'')=''
    UNION ALL SELECT path, 'error', 'invalid_option_value', 'status' FROM t WHERE status NOT IN ('O','F','P','')
    UNION ALL SELECT path, 'error', 'invalid_type', 'total' FROM t WHERE total_is IN ('words','list')
    UNION ALL SELECT path, 'error', 'invalid_type', 'rush' FROM t WHERE rush IN ('True','1')
    UNION ALL SELECT path, 'error', 'invalid_type', 'tags' FROM t WHERE tags='solo'
    UNION ALL SELECT path, 'error', 'invalid_date', 'ordered' FROM t WHERE ordered<>day
    UNION ALL SELECT path, 'error', 'invalid_type', 'type' FROM d WHERE type='ordr'
    UNION ALL SELECT path, 'error', 'invalid_context_source', 'parent' FROM t LEFT JOIN (SELECT name, count(*) AS n FROM customer_n GROUP BY 1) c ON '[['||c.name||']]'=t.parent
      WHERE t.parent LIKE '[[%]]' AND coalesce(c.n,0)<>1
    UNION ALL SELECT path, 'warning', 'unknown_field', 'Priority' FROM t WHERE cased IS NOT NULL
    UNION ALL SELECT path, 'warning', 'unknown_field', 'tag' FROM t WHERE k%89=20
    UNION ALL SELECT path, 'warning', 'unknown_field', 'totl' FROM t WHERE k%97=21"""}


@probe("validate_rows", twin("customer_n", body="""
    SELECT d.path, coalesce(e,0) AS errors, coalesce(w,0) AS warnings, coalesce(e,0)=0 AS valid, coalesce(listed,'') AS problems FROM d LEFT JOIN
      (SELECT path, count(*) FILTER (severity='error') AS e, count(*) FILTER (severity='warning') AS w,
         string_agg(code||':'||field, ',' ORDER BY severity, code, field) AS listed FROM v GROUP BY 1) x ON x.path=d.path""", **D, **VALID))
def _(t):
    verdict = Q.validate_rows(t.drifted, t.schema, R.name_rows(t.index_rows, t.aliases))
    return verdict.withColumn("problems", F.array_join(F.transform("problems", lambda p: F.concat(p["code"], F.lit(":"), p["field"])), ","))


@probe("rule_illegal_aliases", twin("part_n", body="""
    SELECT path, CASE k%5 WHEN 0 THEN '["'||alias||'","'||alias||'"]' WHEN 1 THEN '["'||alias||'"," "]' ELSE '["'||alias||'",7]' END AS value,
      k%5<2 AS auto_fixable FROM part_n WHERE k%5<3"""))
def _(t):
    from notegrid.sources.tables import header, quoted
    a, k = quoted(F.col("alias")), F.col("k") % 5
    listed = F.concat(F.lit("["), a, F.when(k == 0, F.concat(F.lit(","), a)).when(k == 1, ',\" \"')
                      .when(k == 2, ",7").otherwise(""), F.lit("]"))
    notes = t.part.select("path", "type", F.parse_json(header(type=quoted(F.col("type")), aliases=listed)).alias("fm"))
    return Q.field_issues(notes, t.schema, ["illegal-aliases"]).select("path", "value", "auto_fixable")


@probe("rule_note_id", twin("document_n", body="""
    SELECT path, CASE WHEN k%3=0 THEN 'missing-note-id' ELSE 'invalid-note-id' END AS code, CASE WHEN k%3=1 THEN 'doc '||k END AS value
    FROM document_n WHERE k%3<2"""))
def _(t):
    from notegrid.sources.tables import header, quoted
    k = F.col("k")
    ids = F.when(k % 3 == 1, quoted(F.concat(F.lit("doc "), k))).when(k % 3 == 2, quoted(F.col("id")))
    notes = t.document.select("path", "name", "folder", "type", F.lit("document").alias("directory_type"),
                              F.parse_json(header(type=quoted(F.col("type")), id=ids)).alias("fm"))
    return Q.note_issues(notes, t.schema, ASOF, ["note-id"]).select("path", "code", "value")


@probe("rule_retention_due", twin(body="""
    SELECT path, ordered AS value, CASE WHEN regexp_matches(ordered,'^....-..-..$') THEN strftime(ordered::DATE + INTERVAL 1000 DAY,'%Y-%m-%d') ELSE 'invalid-clock' END AS expected
    FROM (SELECT path, priority, CASE WHEN status IN ('F','f') THEN status END AS status, CASE WHEN k%31=7 OR k%37=8 THEN ordered WHEN k%41=9 THEN NULL ELSE ordered END AS ordered FROM t)
    WHERE status='F' AND coalesce(priority,'')<>'1-URGENT' AND CASE WHEN regexp_matches(ordered,'^....-..-..$') THEN ordered::DATE + INTERVAL 1000 DAY <= DATE '2000-01-01' ELSE true END""", **D))
def _(t):
    from notegrid.sources.tables import SCHEMA
    from notegrid.types import compile_types
    types = dict(SCHEMA["types"])
    types["order"] = {**types["order"], "retention": {
        "when": {"status": ["F"]}, "resolved_when": {"priority": ["1-URGENT"]},
        "clock": "ordered", "after_days": 1000}}
    return Q.note_issues(t.drifted, compile_types({**SCHEMA, "types": types}), "2000-01-01",
                         ["retention-due"]).select("path", "value", "expected")


# ---- profiles

F_SQL = {**D, "h": "SELECT * FROM d WHERE headed", "f": """
    SELECT path, 'status' AS key, CASE WHEN status='' THEN 'empty' ELSE 'string' END AS value_shape FROM h WHERE status IS NOT NULL UNION ALL
    SELECT path, 'type', 'string' FROM h WHERE type IS NOT NULL UNION ALL
    SELECT path, 'total', CASE WHEN total_is='text' THEN CASE WHEN length(k::VARCHAR)=4 THEN 'date' ELSE 'string' END WHEN total_is='words' THEN 'string' ELSE total_is END FROM h UNION ALL
    SELECT path, 'ordered', CASE WHEN k%31=7 OR k%37=8 THEN 'string' WHEN k%41=9 THEN 'number' ELSE 'date' END FROM h UNION ALL
    SELECT path, 'priority', CASE WHEN priority='' THEN 'empty' ELSE 'string' END FROM h WHERE priority IS NOT NULL UNION ALL
    SELECT path, 'Priority', 'string' FROM h WHERE cased IS NOT NULL UNION ALL
    SELECT path, 'rush', CASE rush WHEN 'True' THEN 'string' WHEN '1' THEN 'number' ELSE 'boolean' END FROM h WHERE rush IS NOT NULL UNION ALL
    SELECT path, 'tags', CASE tags WHEN 'solo' THEN 'string' ELSE 'list' END FROM h WHERE tags IS NOT NULL UNION ALL
    SELECT path, 'tag', 'string' FROM h WHERE k%89=20 UNION ALL SELECT path, 'totl', 'number' FROM h WHERE k%97=21 UNION ALL
    SELECT path, 'overdue', 'boolean' FROM h WHERE k%101=22 UNION ALL SELECT path, 'parent', 'string' FROM h"""}


@probe("explode_fields", twin(body="SELECT path, key, value_shape FROM f", **F_SQL))
def _(t):
    return P.classified(P.explode_fields(t.drifted)).drop("type")


@probe("field_facts", twin(body="""
    SELECT key, count(*) AS n, """ + ", ".join(
    f"count(*) FILTER (value_shape='{s}') AS n_{s}" for s in ("string", "number", "boolean", "date", "list", "object", "empty")) + """,
      count(DISTINCT value_shape) FILTER (value_shape<>'empty') > 1 AS mixed, round(count(*)/(SELECT count(*) FROM h), 6)::DOUBLE AS share FROM f GROUP BY 1""", **F_SQL))
def _(t):
    return P.field_facts(t.drifted)


@probe("diverging_rows", twin(body="""
    SELECT path, key, value_shape, baseline FROM f JOIN (SELECT key, value_shape AS baseline FROM f WHERE value_shape<>'empty' GROUP BY 1,2
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, value_shape)=1) USING (key) WHERE value_shape NOT IN ('empty', baseline)""", **F_SQL))
def _(t):
    return P.diverging_rows(t.drifted)


@probe("field_drift", twin(body="""
    SELECT DISTINCT key AS field, 'undeclared' AS drift FROM f WHERE key IN ('Priority','tag','totl') UNION ALL
    SELECT unnest(['balance','segment','parts','kind','size','price','aliases','lang','chars','quality','toxic','id','forked-from','role','prev','next']), 'unused'""", **F_SQL))
def _(t):
    return P.field_drift(t.drifted, t.schema)


@probe("option_drift", twin(body="""
    SELECT 'status' AS key, status AS value, count(*) AS n_notes, min(path) AS first_path FROM h WHERE status NOT IN ('O','F','P','') GROUP BY status""", **F_SQL))
def _(t):
    return P.option_drift(t.drifted, t.schema)
