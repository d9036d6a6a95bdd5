"""Header access, registered SQL functions and summaries of runs."""

import uuid

from pyspark.sql import functions as F

from notegrid.functions import header as A
from notegrid.functions.register import register
from notegrid.operators import evolve as Ev
from notegrid.operators import headers as E
from notegrid.operators import repair as X
from notegrid.operators import rules as Q
from notegrid.probes.quality import ALL, D
from notegrid.probes.registry import probe, twin
from notegrid.session import checkpoint_dir
from notegrid.sources.tables import header, quoted


def _docs(t):
    k = F.col("k")
    return t.document.select("path", "name", "k", F.parse_json(header(
        lang=quoted(F.col("lang")), quality=F.coalesce(F.col("quality").cast("string"), F.when(k % 2 == 0, "null")),
        name=F.when(k % 3 == 0, quoted(F.concat(F.lit("Named "), k))),
        meta=F.concat(F.lit('{"chars":'), F.col("chars").cast("string"), F.lit("}")))).alias("fm"))


@probe("field_access", twin("document_n", body="""
    SELECT path, lang, chars::BIGINT AS chars, CASE WHEN k%3=0 THEN 'Named '||k ELSE name END AS shown, NULL AS gone FROM document_n"""))
def _(t):
    return _docs(t).select("path", A.field(F.col("fm"), "lang").alias("lang"), A.field(F.col("fm"), "meta.chars", "bigint").alias("chars"),
                           A.note_name(F.col("fm"), F.col("name")).alias("shown"), A.field(F.col("fm"), "nope.deep").alias("gone"))


@probe("is_defined", twin("document_n", body="""
    SELECT path, quality IS NOT NULL OR k%2=0 AS defined, quality IS NULL AS is_null FROM document_n"""))
def _(t):
    return _docs(t).select("path", A.is_defined(F.col("fm"), "quality").alias("defined"),
                           A.is_null(F.col("fm"), "quality").alias("is_null"))


@probe("now", twin("order_n", body="SELECT path, true AS past FROM order_n"))
def _(t):
    return t.order.select("path", (F.current_timestamp() > F.col("ordered").cast("timestamp")).alias("past"))


@probe("sql_functions", twin("order_n", "customer_n", body="""
    SELECT o.path, c.name AS target, c.name AS base, k48*3600000::BIGINT AS ms, strftime(date_trunc('month',ordered::DATE) + INTERVAL 1 MONTH + (day(ordered::DATE)-1)*INTERVAL 1 DAY,'%Y-%m-%d') AS next_month
    FROM (SELECT *, (k%48)::BIGINT AS k48 FROM order_n) o JOIN customer_n c ON c.k=o.o_custkey"""))
def _(t):
    register(t.spark)
    return t.order.select("path", F.expr("ng_link_target(parent)").alias("target"), F.expr("ng_target_base(parent)").alias("base"),
                          F.expr("ng_duration_ms(concat(k % 48, 'h'))").alias("ms"),
                          F.expr("date_format(ng_add_months(ng_iso_day(ordered), 1), 'yyyy-MM-dd')").alias("next_month"))


@probe("fix_summary", twin(body="""
    SELECT (SELECT count(*) FROM i WHERE code IN ('unknown-enum-casing','invalid-boolean-coercion') AND auto_fixable) AS fixable, 0::BIGINT AS skipped,
      (SELECT count(*) FROM i WHERE code IN ('unknown-enum-casing','invalid-boolean-coercion') AND auto_fixable) AS fixed, 0::BIGINT AS remaining""", **ALL))
def _(t):
    codes = ["unknown-enum-casing", "invalid-boolean-coercion"]
    changes = X.repair_fields(t.drifted, t.schema, ["fix_enum_case", "fix_boolean"])
    after = Q.field_issues(E.apply_changes(t.drifted, changes), t.schema, codes)
    return X.fix_summary(Q.field_issues(t.drifted, t.schema, codes), changes, after)


@probe("migration_log", twin(body="SELECT k, path, 'add-field' AS op, '1.0.0' AS from_version, '1.1.0' AS to_version FROM d", **D))
def _(t):
    """Appends one record per migrated note and reads the log back."""
    folder = f"{checkpoint_dir(t.spark)}/log-{uuid.uuid4().hex}"
    Ev.migration_log(t.drifted.select("k", "path", F.lit("add-field").alias("op")), "1.0.0", "1.1.0", folder)
    return t.spark.read.parquet(folder)
