"""Scalar functions."""

from pyspark.sql import functions as F

from notegrid.functions import links as L
from notegrid.functions import values as V
from notegrid.probes.registry import probe, twin


@probe("text_functions", twin("part_n", body="""
    SELECT path, contains(alias,'bolt') AS has_bolt, starts_with(alias,'red') AS red,
      ends_with(kind,'Y') AS ends_y, upper(alias) AS up, lower(kind) AS low,
      trim('  '||alias||' ') AS trimmed, length(alias)::INT AS len,
      CASE WHEN strpos(alias,'e')>0 THEN substr(alias,1,strpos(alias,'e')-1)||'E'||
        substr(alias,strpos(alias,'e')+1) ELSE alias END AS first_e FROM part_n"""))
def _(t):
    a, k = F.col("alias"), F.col("kind")
    return t.part.select(
        "path", V.contains(a, F.lit("bolt")).alias("has_bolt"),
        V.starts_with(a, F.lit("red")).alias("red"), V.ends_with(k, F.lit("Y")).alias("ends_y"),
        V.upper(a).alias("up"), V.lower(k).alias("low"),
        V.trim(F.concat(F.lit("  "), a, F.lit(" "))).alias("trimmed"), V.length(a).alias("len"),
        V.replace_first(a, F.lit("e"), F.lit("E")).alias("first_e"))


@probe("date_parts", twin("order_n", body="""
    SELECT path, year(ordered::DATE)::INT AS y, month(ordered::DATE)::INT AS m,
      day(ordered::DATE)::INT AS d FROM order_n"""))
def _(t):
    c = F.col("ordered")
    return t.order.select("path", V.year(c).alias("y"), V.month(c).alias("m"),
                          V.day(c).alias("d"))


@probe("date_arithmetic", twin("order_n", body="""
    SELECT path, strftime(ordered::TIMESTAMP + INTERVAL 36 HOUR, '%Y-%m-%d %H') AS later,
      strftime(ordered::TIMESTAMP - INTERVAL 30 DAY, '%Y-%m-%d') AS earlier,
      (epoch_ms(TIMESTAMP '2001-08-01') - epoch_ms(ordered::TIMESTAMP))::BIGINT AS age_ms FROM order_n"""))
def _(t):
    c, kinds = F.col("ordered"), ("date", "duration")
    return t.order.select(
        "path", F.date_format(V.add(c, F.lit("36h"), kinds), "yyyy-MM-dd HH").alias("later"),
        F.date_format(V.subtract(c, F.lit("1mon"), kinds), "yyyy-MM-dd").alias("earlier"),
        V.subtract(F.lit("2001-08-01"), c, ("date", "date")).alias("age_ms"))


@probe("number_arithmetic", twin("part_n", body="""
    SELECT path, round(size + price, 4) AS plus, round(size - price, 4) AS minus,
      round(coalesce(try_cast(kind AS DOUBLE),0) * price, 4) AS zero,
      round(price / nullif(size % 3, 0), 4) AS ratio, -size::DOUBLE AS neg FROM part_n"""))
def _(t):
    s, p = F.col("size"), F.col("price")
    return t.part.select(
        "path", F.round(V.add(s, p), 4).alias("plus"), F.round(V.subtract(s, p), 4).alias("minus"),
        F.round(V.multiply(F.col("kind"), p), 4).alias("zero"),
        F.round(V.divide(p, s % 3), 4).alias("ratio"), V.negate(s).alias("neg"))


@probe("parse_duration", twin("part_n", body="""
    SELECT path, CASE k % 7 WHEN 0 THEN size*60000 WHEN 1 THEN size*3600000 WHEN 2 THEN size*86400000
      WHEN 3 THEN size*604800000 WHEN 4 THEN size*2592000000 WHEN 5 THEN size*31536000000 END::BIGINT AS ms
    FROM (SELECT path, k, size::BIGINT AS size FROM part_n)"""))
def _(t):
    units = F.array(*[F.lit(u) for u in ("min", "h", "d", "w", "mon", "y", "q")])
    written = F.concat(F.col("size").cast("string"),
                       F.element_at(units, (F.col("k") % 7 + 1).cast("int")))
    return t.part.select("path", V.duration_ms(written).alias("ms"))


@probe("safe_name", twin("part_n", body="""
    SELECT path, raw, CASE WHEN k % 50 = 0 THEN '_CON' WHEN k % 50 = 1 THEN
      repeat('x', 171)||'--'||substr(sha256(raw),1,16)
      ELSE 'Part 1 of '||k END AS safe
    FROM (SELECT path, k, CASE WHEN k % 50 = 0 THEN 'CON. ' WHEN k % 50 = 1 THEN repeat('x', 200)||k
      ELSE 'Part: 1  of '||k||'?.' END AS raw FROM part_n)"""))
def _(t):
    k = F.col("k")
    raw = F.when(k % 50 == 0, "CON. ") \
        .when(k % 50 == 1, F.concat(F.repeat(F.lit("x"), 200), k.cast("string"))) \
        .otherwise(F.concat(F.lit("Part: 1  of "), k, F.lit("?.")))
    return t.part.select("path", raw.alias("raw")).withColumn("safe", V.safe_name(F.col("raw")))


@probe("link_functions", twin("customer_n", body="""
    SELECT path, '[['||name||']]' AS wiki, '['||name||']('||name||'.md)' AS mark,
      name AS from_mark, name AS base, path AS full_path, n_name AS parent_target
    FROM customer_n JOIN nation USING (n_nationkey)"""))
def _(t):
    full = F.concat(F.lit("[["), F.col("path"), F.lit("#top|shown]]"))
    mark = L.to_markdown_link(F.col("name"))
    return t.customer.select(
        "path", L.to_wikilink(F.col("name")).alias("wiki"), mark.alias("mark"),
        L.link_target(mark).alias("from_mark"), L.target_base(full).alias("base"),
        L.target_path(full).alias("full_path"), L.link_target(F.col("parent")).alias("parent_target"))


@probe("coercions", twin("part_n", body="""
    SELECT path, CASE WHEN k%4=0 THEN NULL ELSE size::DOUBLE END AS num,
      CASE k%3 WHEN 0 THEN true WHEN 1 THEN false END AS flag,
      alias AS single, '['||alias||']' AS listed FROM part_n"""))
def _(t):
    k = F.col("k")
    num = F.when(k % 4 == 0, F.concat(F.lit("1e"), F.col("size"))).otherwise(F.col("size").cast("string"))
    flag = F.when(k % 3 == 0, " True").when(k % 3 == 1, "false").otherwise("yes")
    listed = V.scalar_to_list(F.col("alias"))
    return t.part.select(
        "path", V.coerce_number(num).alias("num"), V.coerce_boolean(flag).alias("flag"),
        V.list_to_scalar(listed).alias("single"),
        F.concat(F.lit("["), V.display_value(listed, True), F.lit("]")).alias("listed"))


@probe("parse_literal", twin("part_n", body="""
    SELECT path, CASE k%4 WHEN 0 THEN 'BOOLEAN' WHEN 1 THEN 'NUMBER' WHEN 2 THEN 'STRING' END AS shape
    FROM part_n"""))
def _(t):
    k = F.col("k")
    written = F.when(k % 4 == 0, "true").when(k % 4 == 1, F.col("size").cast("string")) \
        .when(k % 4 == 2, F.col("alias")).otherwise("")
    shape = F.schema_of_variant(V.parse_literal(written))
    return t.part.select("path", F.when(shape.isin("BIGINT", "DOUBLE"), "NUMBER")
                         .otherwise(shape).alias("shape"))


@probe("static_value", twin("part_n", body="""
    SELECT path, CASE k%3 WHEN 0 THEN '2001-08-01' WHEN 1 THEN 'bot' ELSE kind END AS filled FROM part_n"""))
def _(t):
    k = F.col("k")
    written = F.when(k % 3 == 0, "$TODAY").when(k % 3 == 1, "$ACTOR").otherwise(F.col("kind"))
    return t.part.select("path", V.static_value(
        written, F.current_timestamp().cast("string"), F.lit("2001-08-01"), F.lit("bot"))
        .alias("filled"))
