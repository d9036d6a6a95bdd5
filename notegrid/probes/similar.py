"""Similar names for what a lookup or a link does not find, over the names of all tables."""

from pyspark.sql import functions as F

from notegrid.operators import resolve as R
from notegrid.operators import rules as Q
from notegrid.operators import similar as S
from notegrid.probes.flows import BENT, _bent
from notegrid.probes.registry import probe, twin

# Every target against every name, scored in full.
POINTS = {
    "names": "SELECT DISTINCT name, lower(name) AS f FROM index_n",
    "asked": """SELECT DISTINCT target, lower(trim(target)) AS t FROM (
        SELECT target FROM c WHERE k%11=0 OR (k%13<>1 AND k%17<>2 AND k%19=3) UNION ALL
        SELECT 'Suplier '||lpad(k::VARCHAR,8,'0') FROM supplier_n UNION ALL
        SELECT replace(replace(lower(name),'nation','Natin'),'_','') FROM nation_n UNION ALL
        SELECT name||' order' FROM region_n)""",
    "w": r"""SELECT a.target, n.name, a.t, n.f, length(a.t) AS lt, length(n.f) AS lf,
        list_filter(string_split_regex(a.t, '[\s\-_]+'), lambda x: length(x) >= 2) AS tw,
        list_filter(string_split_regex(n.f, '[\s\-_]+'), lambda x: length(x) >= 2) AS fw FROM asked a JOIN names n ON a.t <> n.f""",
    "points": """SELECT target, name, f,
        CASE WHEN least(lt, lf) >= 4 AND (starts_with(f, t) OR starts_with(t, f)) THEN 50 ELSE 0 END
        + CASE WHEN least(lt, lf) >= 4 AND (contains(f, t) OR contains(t, f)) THEN 30 ELSE 0 END
        + 10 * len(list_filter(tw, lambda x: len(list_filter(fw, lambda y: x = y OR (length(x) >= 4 AND length(y) >= 4 AND (contains(x, y) OR contains(y, x))))) > 0))
        + CASE WHEN greatest(lt, lf) < 20 AND levenshtein(t, f) <= greatest(1, least(lt, lf) // 5)
          THEN 15 * (greatest(1, least(lt, lf) // 5) + 1 - levenshtein(t, f)) ELSE 0 END AS score FROM w""",
    "ranked": """SELECT target, name, score, row_number() OVER (PARTITION BY target ORDER BY score DESC, f, name) AS rank FROM points WHERE score >= 10"""}


def _asked(t):
    """Targets that name nothing: dead links of customers and misspelt names of places and suppliers."""
    dead = _bent(t).filter("resolution = 'none'").select("target")
    bent = t.supplier.select(F.concat(F.lit("Suplier "), F.lpad(F.col("k").cast("string"), 8, "0")).alias("target")).unionByName(
        t.nation.select(F.replace(F.replace(F.lower("name"), F.lit("nation"), F.lit("Natin")), F.lit("_"), F.lit("")).alias("target"))).unionByName(
        t.region.select(F.concat("name", F.lit(" order")).alias("target")))
    return dead.unionByName(bent).distinct()


@probe("similar_names", twin("index_n", "customer_n", "nation_n", "supplier_n", "region_n", body="""
    SELECT target, name, score::INTEGER AS score, rank::INTEGER AS rank FROM ranked WHERE rank <= 5""", **BENT, **POINTS))
def _(t):
    return S.similar_names(_asked(t), t.index_rows.select("name"))


@probe("lookup_or_suggest", twin("index_n", "customer_n", "nation_n", "supplier_n", "region_n", body="""
    SELECT target AS query, CAST(NULL AS VARCHAR) AS tier, 0::BIGINT AS n, CAST(NULL AS VARCHAR) AS path, count(r.name) > 0 AS ambiguous,
      coalesce(string_agg(r.name||':'||b.n, ',' ORDER BY r.rank), '') AS suggestions
    FROM asked LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r USING (target) LEFT JOIN bearers b ON b.name = r.name GROUP BY target
    UNION ALL SELECT s.name, 'name', 1, s.path, false, '' FROM supplier_n s""",
    **BENT, **POINTS, bearers="SELECT name, count(*) AS n FROM index_n GROUP BY name"))
def _(t):
    asked = _asked(t).select(F.col("target").alias("query")).unionByName(t.supplier.select(F.col("name").alias("query")))
    got = S.lookup_or_suggest(asked, t.index_rows, t.aliases)
    listed = F.array_join(F.transform("suggestions", lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ",")
    return got.withColumn("suggestions", listed)


@probe("stale_reference_similar", twin("index_n", "customer_n", "nation_n", "supplier_n", "region_n", body="""
    SELECT path, 'parent' AS field, '[['||target||']]' AS value, coalesce(alike, '') AS similar_names FROM c LEFT JOIN (
      SELECT target, string_agg(name, ',' ORDER BY rank) AS alike FROM ranked WHERE rank <= 5 GROUP BY target) USING (target)
    WHERE k%11=0 OR (k%13<>1 AND k%17<>2 AND k%19=3)""", **BENT, **POINTS))
def _(t):
    links = _bent(t)
    issues = Q.link_issues(links, ["stale-reference"])
    similar = S.suggestions(links.filter("resolution = 'none'").select("target"), t.index_rows.select("name"))
    named = issues.withColumn("target", R.L.target_path(F.col("value"))).join(similar, "target", "left")
    return named.select("path", "field", "value", F.coalesce(F.array_join("similar", ","), F.lit("")).alias("similar_names"))
