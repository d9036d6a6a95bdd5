"""The helpers as SQL functions for one session. They are SQL bodies, so the optimizer inlines
them like any other expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "ng_truthy(v STRING) RETURNS BOOLEAN": "coalesce(v, '') <> ''",
    "ng_is_empty(v STRING) RETURNS BOOLEAN": "v IS NULL OR v = ''",
    "ng_number(v STRING) RETURNS DOUBLE": "coalesce(try_cast(v AS DOUBLE), 0)",
    "ng_link_target(v STRING) RETURNS STRING":
        r"nullif(trim(regexp_extract(v, r'^\"?\[\[([^\]|#]+)', 1)), '')",
    "ng_target_base(v STRING) RETURNS STRING":
        r"element_at(split(trim(regexp_extract(coalesce(nullif(regexp_extract(v, r'^\"?\[\[([^\]|#]+)', 1), ''), v), r'^([^|#]*)', 1)), '/'), -1)",
    "ng_duration_ms(v STRING) RETURNS BIGINT":
        r"""try_cast(regexp_extract(v, r"^'?(\d+)(min|mon|h|d|w|y)'?$", 1) AS BIGINT) * CASE regexp_extract(v, r"^'?(\d+)(min|mon|h|d|w|y)'?$", 2)
            WHEN 'min' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'd' THEN 86400000 WHEN 'w' THEN 604800000
            WHEN 'mon' THEN 2592000000 WHEN 'y' THEN 31536000000 END""",
    "ng_iso_day(v STRING) RETURNS DATE": r"CASE WHEN v RLIKE r'^\d{4}-\d{2}-\d{2}$' THEN try_to_date(v, 'yyyy-MM-dd') END",
    "ng_add_months(d DATE, n INT) RETURNS DATE":
        "date_add(add_months(trunc(d, 'month'), n), dayofmonth(d) - 1)",
    "ng_similarity(a STRING, b STRING) RETURNS DOUBLE":
        """CASE WHEN trim(a) = '' OR trim(b) = '' THEN 0D WHEN lower(trim(a)) = lower(trim(b)) THEN 1D
           WHEN contains(lower(trim(a)), lower(trim(b))) OR contains(lower(trim(b)), lower(trim(a))) THEN
             greatest(0.6D, 1D - levenshtein(lower(trim(a)), lower(trim(b))) / greatest(length(trim(a)), length(trim(b))))
           ELSE 1D - levenshtein(lower(trim(a)), lower(trim(b))) / greatest(length(trim(a)), length(trim(b))) END""",
}


def register(spark: SparkSession) -> list[str]:
    for signature, body in FUNCTIONS.items():
        head, returns = signature.split(" RETURNS ")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
