"""Target index, link resolution and lookups.

Every multi-match is reduced to a count and one representative per key *before* links meet it, so
a link joins at most one index row and a key shared by very many notes never multiplies rows. The
only hot side left is the link side of an N:1 left join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.functions import links as L
from notegrid.session import broadcast_if_small, settle
from notegrid.types import TypeSchema

DIM = T.StructType([T.StructField("d_type", T.StringType()),
                    T.StructField("d_field", T.StringType()),
                    T.StructField("source_types", T.ArrayType(T.StringType()))])


def name_rows(notes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, path, type, kind): every lower-cased name, path and alias, shadowed ones included."""
    real = notes.select(
        "path", "type",
        F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("path")))).alias("key"),
        F.lit("real").alias("kind")).select("key", "path", "type", "kind")
    if aliases is None:
        return real
    return real.unionByName(aliases.filter(F.coalesce(F.trim("alias"), F.lit("")) != "").select(
        F.lower("alias").alias("key"), "path", "type", F.lit("alias").alias("kind")).distinct())


def build_targets(notes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(key, path, type, kind) where an alias equal to some real name or path is dropped.

    Names are looked up among the distinct aliases first: few aliases meet them where they lie, and no name is shuffled.
    """
    real = name_rows(notes)
    if aliases is None:
        return real
    alias = name_rows(notes, aliases).filter("kind = 'alias'")
    asked = broadcast_if_small(alias.select("key").distinct())
    shadowed = real.select("key").join(asked, "key", "left_semi").distinct()
    return real.unionByName(alias.join(shadowed, "key", "left_anti"))


def target_index(targets: DataFrame) -> DataFrame:
    """One row per key: how many notes, a sole path, and the same per note type.

    Takes ``name_rows`` or ``build_targets``; a key with a real name ignores its aliases. The
    per-type map has at most one entry per schema type, so it stays small however many notes share
    the key.
    """
    by_type = targets.groupBy("key", (F.col("kind") == "alias").alias("alias"),
                              F.coalesce("type", F.lit("")).alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    entry = F.struct("type", "n", "path", "alias")
    per_key = by_type.groupBy("key").agg(F.collect_list(entry).alias("all"),
                                         F.bool_or(~F.col("alias")).alias("real"))
    kept = F.filter("all", lambda e: e["alias"] != F.col("real"))
    return per_key.select("key", kept.alias("kept")).select(
        "key", F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, e: a + e["n"]).alias("n"),
        F.array_min(F.transform("kept", lambda e: e["path"])).alias("path"),
        F.map_from_entries(F.transform("kept", lambda e: F.struct(
            e["type"], F.struct(e["n"].alias("n"), e["path"].alias("path"))))).alias("types"))


def path_map(targets: DataFrame) -> DataFrame:
    """key -> single path: the last note in path order wins for names and paths; the first
    claim wins for aliases."""
    real = F.col("kind") != "alias"
    return targets.groupBy("key").agg(
        F.coalesce(F.max(F.when(real, F.col("path"))),
                   F.min(F.when(~real, F.col("path")))).alias("path"))


def type_map(notes: DataFrame) -> DataFrame:
    """name or path -> type; the last note in path order wins."""
    keyed = notes.filter(F.col("type").isNotNull()).select(
        F.explode(F.array_distinct(F.array("name", "path"))).alias("key"), "path", "type")
    return keyed.groupBy("key").agg(F.max_by("type", "path").alias("type"))


def extract_links(df: DataFrame, field: str, is_list: bool = False) -> DataFrame:
    """(src_path, src_type, field, pos, raw) of one scalar or list field."""
    values = F.col(field) if is_list else F.array(F.col(field))
    return df.select(F.col("path").alias("src_path"), F.col("type").alias("src_type"),
                     F.lit(field).alias("field"), F.posexplode(values).alias("pos", "raw")) \
        .filter(F.col("raw").isNotNull() & (F.trim("raw") != ""))


def link_keys(links: DataFrame) -> DataFrame:
    """Distinct keys that raw links name."""
    return links.select(F.lower(F.coalesce(L.target_path(F.col("raw")), F.lit(""))).alias("key")).distinct()


def asked_index(targets: DataFrame, links: DataFrame) -> DataFrame:
    """``target_index`` of only the keys that raw links name: where these are few by measure, other names leave before
    anything is shuffled."""
    return target_index(targets.join(broadcast_if_small(link_keys(links)), "key", "left_semi"))


def _source_dim(schema: TypeSchema, links: DataFrame) -> DataFrame:
    rows = [(t, f, schema.source_family(d)) for t, fields in schema.fields.items()
            for f, d in fields.items() if d.get("kind") == "relation"]
    return F.broadcast(links.sparkSession.createDataFrame(rows, DIM))  # schema-sized


def resolve_links(links: DataFrame, index: DataFrame, schema: TypeSchema) -> DataFrame:
    """Adds target, n_candidates, resolved_path and resolution to raw links.

    resolution is none / unique / ambiguous / no-source-match. For a bare name the candidates of
    an allowed source type decide; a path-qualified target skips that preference.
    """
    target = F.coalesce(L.target_path(F.col("raw")), F.lit(""))
    probe = links.withColumn("target", target).withColumn("key", F.lower("target"))
    dim = _source_dim(schema, links)
    probe = probe.join(dim, (F.col("src_type") == F.col("d_type"))
                       & (F.col("field") == F.col("d_field")), "left").drop("d_type", "d_field")
    idx = index.select("key", F.col("n").alias("n_all"), F.col("path").alias("p_all"), "types")
    joined = probe.join(idx, "key", "left")
    hits = F.filter(F.transform("source_types", lambda s: F.try_element_at("types", s)),
                    lambda h: h.isNotNull())
    src_n = F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, h: a + h["n"])
    prefer = (F.size("source_types") > 0) & ~F.contains(F.col("target"), F.lit("/"))
    joined = joined.withColumn("src_n", F.when(prefer, src_n)) \
        .withColumn("src_p", F.when(prefer, F.array_min(F.transform(hits, lambda h: h["path"]))))
    n = F.coalesce("n_all", F.lit(0))
    resolution = F.when(n == 0, "none") \
        .when(F.col("src_n").isNotNull(), F.when(F.col("src_n") == 1, "unique")
              .when(F.col("src_n") > 1, "ambiguous").otherwise("no-source-match")) \
        .when(n == 1, "unique").otherwise("ambiguous")
    resolved = F.when(F.col("src_n") == 1, F.col("src_p")) \
        .when(F.coalesce("src_n", F.lit(0)) > 1, F.lit(None)) \
        .when(n == 1, F.col("p_all"))
    keep = [c for c in links.columns]
    return joined.select(*keep, "target", n.alias("n_candidates"),
                         resolved.alias("resolved_path"), resolution.alias("resolution"),
                         F.size("source_types").alias("n_source_types"))


def link_candidates(ambiguous: DataFrame, targets: DataFrame) -> DataFrame:
    """Long form of the candidates of each distinct ambiguous target; where these are few by measure, no target is shuffled."""
    keys = broadcast_if_small(ambiguous.select(F.lower("target").alias("key")).distinct())
    return targets.join(keys, "key", "left_semi").select("key", "path", "type")


def relation_quantifier(links: DataFrame, notes: DataFrame, predicate: Column) -> DataFrame:
    """Per source: n linked, n holding, n unresolved, any, all.

    ``links`` are resolved; ``predicate`` reads columns of ``notes``. The predicate is evaluated
    once per note and the result is the only thing that travels.
    """
    truth = notes.select(F.col("path").alias("resolved_path"),
                         F.coalesce(predicate, F.lit(False)).alias("holds"))
    joined = links.join(truth, "resolved_path", "left")
    per = joined.groupBy("src_path").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.count_if(F.col("holds")).alias("n_true"),
        F.count_if(F.col("holds").isNull()).alias("n_unresolved"))
    return per.select("src_path", "n_links", "n_true", "n_unresolved",
                      (F.col("n_true") > 0).alias("any_holds"),
                      (F.col("n_true") == F.col("n_links")).alias("all_hold"))


def relation_any(notes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Notes with at least one linked note that holds; none linked means false."""
    return notes.join(verdicts.filter("any_holds"), notes.path == verdicts.src_path, "left_semi")


def relation_all(notes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Notes all of whose linked notes hold; none linked means true."""
    return notes.join(verdicts.filter("NOT all_hold"), notes.path == verdicts.src_path,
                      "left_anti")


TIERS = ["path", "name", "name-ignoring-case", "alias"]


def exact_lookup(queries: DataFrame, notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Batch lookup: the first tier with hits decides; several hits there are ambiguous."""
    def tier(df: DataFrame, rank: int, key: Column) -> DataFrame:
        return df.select(F.lit(rank).alias("tier"), key.alias("key"), "path")

    clean = F.regexp_replace("query", r"\.md$", "")
    asked = queries.select("query").distinct().select("query", F.explode(F.array(
        F.struct(F.lit(0).alias("tier"), clean.alias("key")),
        F.struct(F.lit(1).alias("tier"), clean.alias("key")),
        F.struct(F.lit(2).alias("tier"), F.lower(clean).alias("key")),
        F.struct(F.lit(3).alias("tier"), F.lower(clean).alias("key")))).alias("p")) \
        .select("query", "p.tier", "p.key")
    asked = settle(asked)
    # Names nobody asks for leave where they lie, if the questions are few by measure.
    entries = tier(notes, 0, F.col("path")).unionAll(tier(notes, 1, F.col("name"))) \
        .unionAll(tier(notes, 2, F.lower("name"))).unionAll(tier(aliases, 3, F.lower("alias")))
    entries = entries.join(broadcast_if_small(asked.select("tier", "key").distinct()), ["tier", "key"], "left_semi")
    entries = entries.filter("tier < 3").unionAll(entries.filter("tier = 3").distinct())
    index = entries.groupBy("tier", "key").agg(F.count(F.lit(1)).alias("n"),
                                               F.min("path").alias("path"))
    hit = asked.join(index, ["tier", "key"], "left")
    best = F.min(F.when(F.col("n").isNotNull(), F.struct("tier", "n", "path")))
    names = F.array(*[F.lit(x) for x in TIERS])
    return hit.groupBy("query").agg(best.alias("b")).select(
        "query", F.try_element_at(names, F.col("b.tier") + 1).alias("tier"),
        F.coalesce("b.n", F.lit(0)).alias("n"),
        F.when(F.col("b.n") == 1, F.col("b.path")).alias("path"),
        F.coalesce(F.col("b.n") > 1, F.lit(False)).alias("ambiguous"))


def backlinks(resolved: DataFrame) -> DataFrame:
    """Reference counts per note: total, distinct sources, by relation field."""
    hit = resolved.filter(F.col("resolved_path").isNotNull())
    per_source = hit.groupBy("resolved_path", "field", "src_path").agg(
        F.count(F.lit(1)).alias("n"))
    return per_source.groupBy(F.col("resolved_path").alias("path"), "field").agg(
        F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_sources"))


def typed_backlinks(resolved: DataFrame) -> DataFrame:
    """Relation fields pointing at a note, by referring type and field."""
    return resolved.filter(F.col("resolved_path").isNotNull()).groupBy(
        F.col("resolved_path").alias("path"), "src_type", "field").agg(
        F.count(F.lit(1)).alias("n"))


def owner_index(notes: DataFrame, owned_links: DataFrame, schema: TypeSchema) -> DataFrame:
    """Owned note -> owner, by declaration and by location, with the number of owners.

    ``owned_links`` are resolved links of owned fields (src_path, field, resolved_path). A note
    lies in an owner's place when its folder is ``<owner folder>/<field>`` of that owner; a folder
    that several owners share says nothing about whose the note is, so such folders are counted
    and left to the declarations.
    """
    owned_fields = [(t, f) for t, fs in schema.fields.items() for f, d in fs.items()
                    if d.get("owned")]
    dim = F.broadcast(notes.sparkSession.createDataFrame(
        owned_fields, "d_type string, d_field string"))
    declared = owned_links.join(dim, (F.col("src_type") == F.col("d_type"))
                                & (F.col("field") == F.col("d_field")), "left_semi") \
        .filter(F.col("resolved_path").isNotNull()) \
        .select(F.col("resolved_path").alias("path"), F.col("src_path").alias("owner_path"),
                "field", F.lit("declared").alias("how"))
    owners = notes.join(dim, F.col("type") == F.col("d_type")).groupBy(
        F.concat("folder", F.lit("/"), "d_field").alias("folder"), F.col("d_field").alias("field")).agg(
        F.count(F.lit(1)).alias("n_here"), F.min("path").alias("owner_path"))
    by_place = notes.select("path", "folder").join(owners.filter("n_here = 1"), "folder").filter(
        F.col("path") != F.col("owner_path")).select(
        "path", "owner_path", "field", F.lit("location").alias("how"))
    both = declared.unionByName(by_place)
    return both.groupBy("path", "owner_path", "field").agg(
        F.max((F.col("how") == "declared")).alias("declared"),
        F.max((F.col("how") == "location")).alias("located"))


def owner_counts(owners: DataFrame) -> DataFrame:
    pairs = owners.select("path", "owner_path").distinct()
    return pairs.groupBy("path").agg(F.count(F.lit(1)).alias("n_owners"),
                                     F.min("owner_path").alias("owner_path"))


def may_reference(resolved: DataFrame, owners: DataFrame) -> DataFrame:
    """Links to owned notes that come from someone other than an owner."""
    owned = owners.select(F.col("path").alias("resolved_path")).distinct()
    pairs = owners.select(F.col("path").alias("resolved_path"),
                          F.col("owner_path").alias("src_path")).distinct()
    return resolved.join(owned, "resolved_path", "left_semi") \
        .join(pairs, ["resolved_path", "src_path"], "left_anti")


def shortest_link(notes: DataFrame) -> DataFrame:
    """Link text per row: the bare name where unique in the corpus, else the path."""
    counts = notes.groupBy("name").agg(F.count(F.lit(1)).alias("same"))
    return notes.join(counts, "name").select(
        "path", F.concat(F.lit("[["), F.when(F.col("same") == 1, F.col("name"))
                         .otherwise(F.col("path")), F.lit("]]")).alias("link"))
