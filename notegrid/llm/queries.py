"""The registered queries of these operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.llm import ann, chat, minhash, mixing, packing, prefix_trie, quality, runs, site_style, token_counts, toxicity, vector_dedup, warc
from notegrid.llm.common import WORD_BREAK, in_fold, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    lexicon = toxicity.learn(docs, labels, held_out)
    return (toxicity.score(docs, lexicon, threshold=0.3)
            .select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted", "hits"))


@query
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", "text"), weights=(5, 2, 1), share=1.5, most_passes=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken",
                        F.transform("places", lambda x: x["shard"]).alias("shards"))


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.learn(docs, labels, in_fold(F.col("doc_id"), 3, 1))
    return (quality.score(docs, model, threshold=0.5)
            .select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted"))


@query
def op7_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), percent=80, words=2)


@query
def op8_pack(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    items = packing.pieces(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(items, 1024).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                                            "ids_crc32", "sequence_id", "offset")


@query
def op2_site_style(spark: SparkSession, folder: str) -> DataFrame:
    return site_style.extract(table(spark, folder, "pages"))


@query
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat.format_chats(rows.select("conv_id", "turn", "role", F.array(chat.text_part(F.col("text"))[0]).alias("parts")))
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    read = chats.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       "formatted_chars")


ORACLES["op4_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))
    + length('<|turn|><|text|><|end|>') + 1 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""


@query
def op6_collision_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op9_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, folder, "embeddings"), 0.95)


ORACLES["op9_vector_dedup"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(e) > 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT a AS v, a AS w FROM links UNION SELECT r.v, l.b FROM reach r JOIN links l ON r.w = l.a),
low AS (SELECT v, min(w) AS w FROM reach GROUP BY v),
degree AS (SELECT a AS v, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(w, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(w, vec_id)) AS kept
FROM embeddings e LEFT JOIN low ON low.v = e.vec_id LEFT JOIN degree d ON d.v = e.vec_id"""


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"), least=100)


ORACLES["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""

ORACLES["op7_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
long AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
same AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met, any_value(a.n) AS an, any_value(b.n) AS bn
  FROM long a JOIN long b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
half AS (SELECT a, b FROM same WHERE 100 * met >= 80 * (an + bn - met)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT a AS v, a AS w FROM links UNION SELECT r.v, l.b FROM reach r JOIN links l ON r.w = l.a),
low AS (SELECT v, min(w) AS w FROM reach GROUP BY v)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(w, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(w, doc_id)) AS kept
FROM sets LEFT JOIN low ON low.v = sets.doc_id"""


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII text, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), "
            f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: {step})))")


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"), family=20, taken=prefix_trie.crc32_mod(4))


ORACLES["op11_prefix_trie"] = rf"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT c, c - c % 20 AS base, {crc32_sql("c::VARCHAR")} % 4 AS h FROM own),
turns AS (
  SELECT c.c, 0 AS part, o.k, o.role, o.text FROM convs c JOIN own o ON o.c = c.base AND o.k <= c.h
  UNION ALL SELECT c.c, 1, o.k, o.role, o.text FROM convs c JOIN own o ON o.c = c.c AND o.k > c.h),
placed AS (
  SELECT c, row_number() OVER w AS depth, sha256(role || chr(0) || text) AS turn_key,
    len(regexp_extract_all(text, '[^ 	-
]+')) AS words FROM turns WINDOW w AS (PARTITION BY c ORDER BY part, k)),
paths AS (
  SELECT c, depth, words, string_agg(turn_key, ',') OVER (PARTITION BY c ORDER BY depth) AS path,
    coalesce(string_agg(turn_key, ',') OVER (PARTITION BY c ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up
  FROM placed UNION ALL SELECT c, 0, 0, '', NULL FROM convs),
ends AS (SELECT c, max(depth) AS depth FROM paths GROUP BY c),
nodes AS (
  SELECT path, any_value(up) AS up, p.depth, min(p.c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (e.depth = p.depth), '')) AS ends_sha256
  FROM paths p JOIN ends e USING (c) GROUP BY path, p.depth),
kids AS (SELECT up AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
below AS (
  SELECT a.path, sum((b.n_convs - 1) * b.words) AS saved, count(*) FILTER (b.path NOT IN (SELECT path FROM kids)) AS leaves
  FROM nodes a JOIN nodes b ON a.path = '' OR b.path = a.path OR starts_with(b.path, a.path || ',') GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (path) LEFT JOIN kids k USING (path) LEFT JOIN nodes u ON u.path = n.up AND n.depth > 0"""


@query
def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", (h % 10 == 0).alias("planted"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("planted"), F.array_remove(F.split("text", WORD_BREAK + "+"), ""))
    docs = docs.withColumn("words", words).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.expr("CAST(g % nullif(greatest(n, 0), 0) AS INT)"))
    docs = docs.withColumn("p", F.expr("CAST(1 + floor((n - a) / (3 + g % 8)) AS INT)"))
    again = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a)")
    text = F.when(F.col("planted") & (F.col("n") > 0), F.array_join(F.concat(F.expr("slice(words, 1, a)"), again), " ")).otherwise(F.col("text"))
    return runs.periodic_runs(docs.select("doc_id", text.alias("text"))).drop("runs")


ORACLES["op13_periodic_runs"] = rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
sized AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM split),
placed AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN g % n END AS a, g FROM sized),
fixed AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1]
    ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM placed),
long AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM fixed),
grams AS (
  SELECT doc_id, n, i, hash(word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d) AS gram FROM long
  WINDOW d AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(word, 3) OVER d IS NOT NULL),
-- Four words equal to those q later; a run of length L gives L - q - 3 of them in a row.
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q + 3 AS len FROM islands GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM stretches WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    arg_min(row(s, len, q), row(-len, s, q)) AS top FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM long ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT f.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top[1]::BIGINT AS start, top[2]::BIGINT AS length, top[3]::BIGINT AS period,
  (1000 * top[2] // top[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM fixed f LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""
