"""Dates, calendars and suggestions."""

from pyspark.sql import functions as F

from notegrid.functions import calendars as C
from notegrid.functions import dates as D
from notegrid.functions import text as X
from notegrid.operators import order as O
from notegrid.probes.registry import probe, twin
from notegrid.sources.tables import ASOF

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SUGGEST = """
    WITH v AS (SELECT DISTINCT CASE o_orderkey%6 WHEN 0 THEN lower(c) WHEN 1 THEN left(c,3) WHEN 2
        THEN c||'S' WHEN 3 THEN substr(c,1,3)||'X'||substr(c,5) WHEN 4 THEN 'zzzz' ELSE substr(c,4,4) END AS value
      FROM orders, (SELECT ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'] AS o),
        LATERAL (SELECT o[(o_orderkey%5+1)::INT] AS c)),
    opt AS (SELECT unnest(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY']) AS option,
      unnest([0,1,2,3,4]) AS ordinal),
    s AS (SELECT value, option, ordinal, lower(value) AS v, lower(option) AS o FROM v, opt),
    r AS (SELECT *, levenshtein(v,o) AS d, CASE WHEN v=o THEN 0 WHEN starts_with(o,v) THEN 1
      WHEN contains(o,v) OR contains(v,o) THEN 2
      WHEN levenshtein(v,o) <= ceil(greatest(length(value),length(option))*0.4) THEN 3 END AS rank FROM s)
    SELECT v.value, (SELECT option FROM r WHERE r.value=v.value AND rank IS NOT NULL
      ORDER BY rank, CASE WHEN rank=3 THEN d ELSE 0 END, ordinal LIMIT 1) AS suggestion FROM v"""


def _misspelt(t):
    k = F.col("o_orderkey")
    c = F.element_at(F.array(*map(F.lit, SEGMENTS)), (k % 5 + 1).cast("int"))
    return t.read("orders").select(
        F.when(k % 6 == 0, F.lower(c)).when(k % 6 == 1, F.substring(c, 1, 3))
        .when(k % 6 == 2, F.concat(c, F.lit("S")))
        .when(k % 6 == 3, F.concat(F.substring(c, 1, 3), F.lit("X"), F.substring(c, 5, 20)))
        .when(k % 6 == 4, "zzzz").otherwise(F.substring(c, 4, 4)).alias("value")).distinct()


@probe("suggest_option", SUGGEST)
def _(t):
    return _misspelt(t).select("value", X.suggest_option(
        F.col("value"), F.array(*map(F.lit, SEGMENTS))).alias("suggestion"))


@probe("suggest_key", SUGGEST.replace("WHEN starts_with(o,v) THEN 1", "")
       .replace("WHEN contains(o,v) OR contains(v,o) THEN 2", "")
       .replace("ceil(greatest(length(value),length(option))*0.4)", "least(2, ceil(length(option)*0.4))"))
def _(t):
    return _misspelt(t).select("value", X.suggest_key(
        F.col("value"), F.array(*map(F.lit, SEGMENTS))).alias("suggestion"))


# Orders' dates written in many ways, picked by the order key.
WRITTEN = {"w": """SELECT path, k, CASE k%9 WHEN 0 THEN ordered WHEN 1 THEN strftime(d,'%d/%m/%Y') WHEN 2 THEN strftime(d,'%-m/%-d/%Y')
    WHEN 3 THEN strftime(d,'%Y/%-m/%-d') WHEN 4 THEN strftime(d,'%Y.%m.%d') WHEN 5 THEN strftime(d,'%Y-%m') WHEN 6 THEN strftime(d,'%Y')
    WHEN 7 THEN ordered||' 10:30' ELSE ordered[1:4]||'-13-'||ordered[9:10] END AS c, d
    FROM (SELECT *, ordered::DATE AS d FROM order_n)"""}


def _written(t):
    k, d = F.col("k") % 9, F.to_date("ordered")
    fmt = lambda p: F.date_format(d, p)
    c = F.when(k == 0, F.col("ordered")).when(k == 1, fmt("dd/MM/yyyy")).when(k == 2, fmt("M/d/yyyy")) \
        .when(k == 3, fmt("yyyy/M/d")).when(k == 4, fmt("yyyy.MM.dd")).when(k == 5, fmt("yyyy-MM")) \
        .when(k == 6, fmt("yyyy")).when(k == 7, F.concat("ordered", F.lit(" 10:30"))) \
        .otherwise(F.concat(F.substring("ordered", 1, 4), F.lit("-13-"), F.substring("ordered", 9, 2)))
    return t.order.select("path", "k", c.alias("c"))


SLASH = "(k%9=1 AND regexp_matches(c,'^(1[3-9]|2|3)')) OR (k%9=2 AND regexp_matches(c,'/(1[3-9]|2[0-9]|3[01])/'))"


@probe("parse_date", twin("order_n", body=f"""
    SELECT path, c, CASE WHEN k%9 IN (0,7) OR {SLASH} THEN strftime(d,'%Y-%m-%d') END AS parsed,
      CASE WHEN k%9 IN (3,4,5,6) THEN 'unrecognized' WHEN k%9=8 THEN 'invalid' WHEN k%9 IN (1,2) AND NOT ({SLASH}) THEN 'ambiguous' END AS error
    FROM w""", **WRITTEN))
def _(t):
    p = D.parse_date(F.col("c"))
    return _written(t).select("path", "c", F.date_format(p["date"], "yyyy-MM-dd").alias("parsed"),
                              p["error"].alias("error"))


@probe("parse_date_pattern", twin("order_n", body="""
    SELECT path, CASE WHEN k%9=1 THEN strftime(d,'%Y-%m-%d')
      WHEN k%9=2 AND month(d)>9 AND day(d) BETWEEN 10 AND 12 THEN strftime(make_date(year(d),day(d),month(d)),'%Y-%m-%d') END AS parsed
    FROM w""", **WRITTEN))
def _(t):
    return _written(t).select("path", F.date_format(
        D.parse_date_pattern(F.col("c"), "DD/MM/YYYY"), "yyyy-MM-dd").alias("parsed"))


@probe("partial_date", twin("order_n", body="""
    SELECT path, CASE WHEN k%9=0 THEN 'day' WHEN k%9=5 THEN 'month' WHEN k%9=6 THEN 'year' END AS precision,
      CASE WHEN k%9=0 THEN c WHEN k%9=5 THEN c||'-01' WHEN k%9=6 THEN c||'-01-01' END AS first_day,
      k%9 IN (0,5) AS month_or_finer FROM w""", **WRITTEN))
def _(t):
    p = D.partial_date(F.col("c"))
    return _written(t).select(
        "path", p["precision"].alias("precision"),
        F.date_format(p["first_day"], "yyyy-MM-dd").alias("first_day"),
        D.acceptable_date(F.col("c"), F.lit("month")).alias("month_or_finer"))


@probe("suggest_date", twin("order_n", body="""
    SELECT path, CASE WHEN k%9 IN (0,3,4) THEN strftime(d,'%Y-%m-%d') WHEN k%9=8 THEN c END AS suggestion FROM w""", **WRITTEN))
def _(t):
    return _written(t).select("path", D.suggest_date(F.col("c")).alias("suggestion"))


@probe("normalize_date", twin("order_n", body=f"""
    SELECT path, CASE WHEN k%9 IN (0,7) OR {SLASH} THEN strftime(d,'%Y-%m-%d') WHEN k%9=5 THEN c END AS value,
      CASE WHEN k%9=6 THEN 'too-coarse' WHEN k%9 IN (3,4) THEN 'unrecognized' WHEN k%9=8 THEN 'invalid'
        WHEN k%9 IN (1,2) AND NOT ({SLASH}) THEN 'ambiguous' END AS error FROM w""", **WRITTEN))
def _(t):
    n = D.normalize_date(F.col("c"), F.lit("month"))
    return _written(t).select("path", n["value"].alias("value"), n["error"].alias("error"))


@probe("date_default", twin("order_n", body="""
    SELECT path, '2001-08-15' AS due, '2001-07-31' AS before FROM order_n"""))
def _(t):
    return t.order.select("path", D.date_default("today() + 14d", ASOF).alias("due"),
                          D.date_default("@today - '1d'", ASOF).alias("before"))


@probe("add_offset", twin("order_n", body="""
    SELECT path, strftime(date_trunc('month',ordered::DATE) + INTERVAL 1 MONTH + (day(ordered::DATE)-1)*INTERVAL 1 DAY,'%Y-%m-%d') AS month_on,
      strftime(ordered::DATE + INTERVAL 14 DAY,'%Y-%m-%d') AS weeks_on FROM order_n"""))
def _(t):
    d = F.to_date("ordered")
    return t.order.select(
        "path", F.date_format(D.add_offset(d, F.lit(1), F.lit("mon")), "yyyy-MM-dd").alias("month_on"),
        F.date_format(D.add_offset(d, F.lit(2), F.lit("w")), "yyyy-MM-dd").alias("weeks_on"))


CALENDAR = {"hours_in_day": 20, "months": [{"days": 30}, {"days": 12}, {"days": 41}],
            "eras": [{"short": "BF", "backwards": True}, {"short": "AF"}]}
# 83 days of 20 hours make a year of 1660 hours; the oracle builds dates from the order number.
CAL = {"n": "SELECT path, k, k-7000 AS day_no, (k*7)%20 AS hour, (k*11)%60 AS minute FROM order_n",
       "y": "SELECT *, CASE WHEN day_no<0 THEN (-day_no-1)//83+1 ELSE day_no//83+1 END AS year, CASE WHEN day_no<0 THEN 'BF' ELSE 'AF' END AS era, ((day_no%83)+83)%83 AS doy FROM n",
       "c": "SELECT *, CASE WHEN doy<30 THEN 1 WHEN doy<42 THEN 2 ELSE 3 END AS month, CASE WHEN doy<30 THEN doy+1 WHEN doy<42 THEN doy-29 ELSE doy-41 END AS day FROM y",
       "w": "SELECT *, era||' '||year||'-'||lpad(month::VARCHAR,2,'0')||'-'||lpad(day::VARCHAR,2,'0')||CASE WHEN hour+minute>0 THEN ' '||hour||':'||lpad(minute::VARCHAR,2,'0') ELSE '' END AS text FROM c"}


def _calendar_text(t):
    day_no = F.col("k") - 7000
    hours = day_no * 20 + (F.col("k") * 7) % 20 + ((F.col("k") * 11) % 60) / 60.0
    return t.order.select("path", "name", "k", hours.alias("hours")) \
        .withColumn("text", C.calendar_format(F.col("hours"), CALENDAR))


@probe("calendar_format", twin("order_n", body="SELECT path, text FROM w", **CAL))
def _(t):
    return _calendar_text(t).select("path", "text")


@probe("calendar_linear", twin("order_n", body="""
    SELECT path, era, year::INT AS year, month::INT AS month, day::INT AS day,
      round(day_no*20 + hour + minute/60.0, 4)::DOUBLE AS linear FROM w""", **CAL))
def _(t):
    p = C.calendar_parse(F.col("text"), "moon", CALENDAR)
    return _calendar_text(t).select("path", p["era"].alias("era"), p["year"].alias("year"),
                                    p["month"].alias("month"), p["day"].alias("day"),
                                    F.round(p["linear"], 4).alias("linear"))


@probe("calendar_parse_errors", twin("order_n", body="""
    SELECT path, CASE k%6 WHEN 0 THEN 'era' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'hour' WHEN 4 THEN 'format' END AS error FROM order_n"""))
def _(t):
    k = F.col("k") % 6
    c = F.when(k == 0, "XX 3-1-1").when(k == 1, "AF 3-4-1").when(k == 2, "AF 3-2-13") \
        .when(k == 3, "BF 3-2-1 20:00").when(k == 4, "AF 3/2/1").otherwise("AF 3-2-12 19:59")
    return t.order.select("path", C.calendar_parse(c, "moon", CALENDAR)["error"].alias("error"))


@probe("calendar_compare", twin("order_n", body="""
    SELECT path, CASE WHEN k%4<>0 THEN round(day_no*20 + hour + minute/60.0, 4)::DOUBLE END AS hours_apart FROM w""", **CAL))
def _(t):
    here = C.calendar_parse(F.col("text"), "moon", CALENDAR)
    other = F.when(F.col("k") % 4 == 0, C.calendar_parse(F.lit("AF 1-1-1"), "sun", CALENDAR)) \
        .otherwise(C.calendar_parse(F.lit("AF 1-1-1"), "moon", CALENDAR))
    return _calendar_text(t).select("path", F.round(C.calendar_compare(here, other), 4)
                                    .alias("hours_apart"))


@probe("sort_calendar", twin("order_n", body="""
    SELECT path, round(day_no*20 + hour + minute/60.0, 4)::DOUBLE AS linear FROM w ORDER BY linear""", **CAL))
def _(t):
    p = C.calendar_parse(F.col("text"), "moon", CALENDAR)
    dated = _calendar_text(t).select("path", "name", p["calendar"].alias("calendar"),
                                     F.round(p["linear"], 4).alias("linear"))
    return O.sort_calendar(dated, "calendar", "linear").select("path", "linear")
