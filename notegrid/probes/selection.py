"""Selection, predicates, sorting and limits."""

from pyspark.sql import functions as F

from notegrid.functions import values as V
from notegrid.operators import order as O
from notegrid.operators import select as S
from notegrid.probes.registry import probe, twin
from notegrid.sources.tables import note_id


@probe("select_type", twin("customer_n", "supplier_n", body="""
    SELECT path, type FROM customer_n UNION ALL SELECT path, type FROM supplier_n"""))
def _(t):
    return S.select_type(t.index_rows, t.schema, "party").select("path", "type")


@probe("select_type_qualified", twin("nation_n", body="SELECT path FROM nation_n"))
def _(t):
    return S.select_type(t.index_rows, t.schema, "place/nation").select("path")


@probe("select_path", twin("index_n", body="""
    SELECT path FROM index_n WHERE lower(path) LIKE 'parties/building/%'
       OR regexp_matches(path, '(?i)^orders/1996-0[^/]*/Order [^/]*7$')
       OR regexp_matches(path, '(?i)(^|/)part 1[^/]$')"""))
def _(t):
    return t.index_rows.filter(S.path_like("parties/BUILDING/**")
                               | S.path_like("Orders/1996-0*/Order *7")
                               | S.path_like("part 1?")).select("path")


@probe("select_path_audit", twin("index_n", body="""
    SELECT path FROM index_n WHERE contains(path, 'BUILD') OR regexp_matches(path, '(?i)^docs/src1/[^/]*$')"""))
def _(t):
    return t.index_rows.filter(S.path_like_audit("BUILD")
                               | S.path_like_audit("docs/src1/*")).select("path")


@probe("select_id", """
    SELECT substr(md5('17'),1,8)||'-'||substr(md5('17'),9,4)||'-'||substr(md5('17'),13,4)||'-'||
      substr(md5('17'),17,4)||'-'||substr(md5('17'),21,12) AS id, count(*) AS n,
      CASE WHEN count(*)=1 THEN min('Docs/'||source||'/Doc '||doc_id) END AS path,
      CASE WHEN count(*)=0 THEN 'not-found' WHEN count(*)>1 THEN 'duplicate' ELSE 'ok' END AS status
    FROM documents WHERE doc_id=17""")
def _(t):
    import hashlib
    h = hashlib.md5(b"17").hexdigest()
    wanted = "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:]])
    return S.select_id(t.document, wanted)


@probe("select_body", twin("document_n", body="""
    SELECT path FROM document_n WHERE contains(lower(body), 'tion of')"""))
def _(t):
    return t.document.filter(S.body_contains("TION of")).select("path")


@probe("select_all_of", twin("document_n", body="""
    SELECT path, chars FROM document_n WHERE folder='Docs/src3' AND contains(lower(body),'the')
      AND chars > 500"""))
def _(t):
    return S.select_all_of(t.document, t.schema, type_name="document", path="Docs/src3/",
                           body="the", where="chars > 500").select("path", "chars")


@probe("compare_null_safe", twin("document_n", body="""
    SELECT path, quality IS NOT DISTINCT FROM 1 AS is_good, quality IS DISTINCT FROM 1 AS not_good,
      coalesce(quality < 1, false) AS below, coalesce(quality >= 1, false) AS at_least,
      quality IS NULL AS empty FROM document_n"""))
def _(t):
    q, one = F.col("quality"), F.lit(1)
    return t.document.select("path", V.eq(q, one, "number").alias("is_good"),
                             V.ne(q, one, "number").alias("not_good"),
                             V.lt(q, one, "number").alias("below"),
                             V.ge(q, one, "number").alias("at_least"),
                             V.is_empty(q).alias("empty"))


@probe("compare_dates_durations", twin("order_n", body="""
    SELECT path, ordered::TIMESTAMP > TIMESTAMP '1998-01-01' AS newer,
      ordered::TIMESTAMP <= TIMESTAMP '1996-06-30' AS older,
      k % 48 = 24 AS same_span FROM order_n"""))
def _(t):
    span = F.concat((F.col("k") % 48).cast("string"), F.lit("h"))
    return t.order.select("path", V.gt(F.col("ordered"), F.lit("1998-01-01"), "date").alias("newer"),
                          V.le(F.col("ordered"), F.lit("1996-06-30"), "date").alias("older"),
                          V.eq(span, F.lit("1d"), "duration").alias("same_span"))


@probe("regex_match", twin("order_n", body="""
    SELECT path FROM order_n WHERE regexp_matches(priority, '(?i)^[12]-.*h') AND status <> 'P'"""))
def _(t):
    return t.order.filter(V.regex_match(F.col("priority"), "/^[12]-.*H/i")
                          & ~V.regex_match(F.col("status"), "P")
                          & ~V.regex_match(F.col("status"), "")).select("path")


@probe("truthiness", twin("document_n", body="""
    SELECT path, coalesce(toxic,0)<>0 OR coalesce(quality,0)<>0 AS either,
      coalesce(toxic,0)<>0 AND coalesce(quality,0)<>0 AS both,
      NOT coalesce(quality,0)<>0 AS neither_good FROM document_n"""))
def _(t):
    toxic, good = V.truthy(F.col("toxic"), "number"), V.truthy(F.col("quality"), "number")
    return t.document.select("path", (toxic | good).alias("either"), (toxic & good).alias("both"),
                             (~good).alias("neither_good"))


@probe("in_folder", twin("index_n", body="SELECT path FROM index_n WHERE starts_with(folder,'Parts/Brand#1')"))
def _(t):
    return t.index_rows.filter(V.in_folder(F.col("folder"), F.lit("Parts/Brand#1"))).select("path")


@probe("has_tag", """
    SELECT 'Order '||o_orderkey AS name FROM orders
    WHERE list_contains([lower(split_part(o_orderpriority,'-',2)), lower(o_orderstatus)], 'urgent')""")
def _(t):
    tags = F.array(F.lower(F.split_part("priority", F.lit("-"), F.lit(2))), F.lower("status"))
    return t.order.filter(V.has_tag(tags, F.lit("urgent"))).select("name")


@probe("relation_source_filter", twin("customer_n", "supplier_n", body="""
    SELECT path FROM customer_n WHERE segment IN ('BUILDING','MACHINERY') AND parent <> '[[NATION_1]]'"""))
def _(t):
    return t.customer.filter(S.source_filter({
        "segment": {"in": ["BUILDING", "MACHINERY"]},
        "parent": {"not_equals": "[[NATION_1]]"}})).select("path")


@probe("retention_condition", twin("order_n", body="""
    SELECT path FROM order_n WHERE status IN ('F') AND priority IN ('5-LOW','3-MEDIUM')"""))
def _(t):
    return t.order.filter(S.retention_condition(
        {"status": ["F"], "priority": ["5-LOW", "3-MEDIUM"]})).select("path")


@probe("sort_rows", twin("part_n", body="SELECT name, kind FROM part_n ORDER BY k"))
def _(t):
    return O.sort_rows(t.part.select("name", "kind"), "name")


@probe("sort_missing_last", twin("document_n", body="SELECT name, quality FROM document_n ORDER BY quality IS NULL, quality DESC, name"))
def _(t):
    return O.sort_rows(t.document.select("name", "quality"), "quality", desc=True)


@probe("sort_default", twin("supplier_n", body="SELECT name FROM supplier_n ORDER BY name"))
def _(t):
    return O.sort_rows(t.supplier.select("name"))


@probe("limit_rows", twin("order_n", body="""
    SELECT name, total FROM order_n ORDER BY total DESC, name LIMIT 15"""))
def _(t):
    return O.limit_rows(t.order.select("name", "total"), 15, "total", desc=True)


@probe("count_rows", twin("order_n", body="""
    SELECT count(*) AS matched FROM order_n WHERE status='F' AND total > 100000"""))
def _(t):
    return O.count_rows(t.order.filter((F.col("status") == "F") & (F.col("total") > 100000)))


@probe("recent_rows", twin("order_n", body="""
    SELECT path, ordered FROM order_n ORDER BY ordered DESC, path LIMIT 20"""))
def _(t):
    return O.recent_rows(t.order.select("path", "ordered"), mtime="ordered")


@probe("query_receipt", twin("order_n", body="""
    SELECT 'order' AS type, 'status = F' AS filter, count(*) AS matched,
      least(count(*), 50)::BIGINT AS returned, count(*) > 50 AS truncated
    FROM order_n WHERE status='F'"""))
def _(t):
    return O.query_receipt(t.order.filter("status = 'F'"),
                           {"type": "order", "filter": "status = F"}, limit=50)
