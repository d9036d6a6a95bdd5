"""The relational tables seen as typed notes.

Each ``frame`` is a wide DataFrame of one type with plainly typed field columns, so filters and
column pruning reach the Parquet scan. ``index_rows`` is the narrow (path, name, type) union that
link resolution needs; no text travels with it.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.session import tune
from notegrid.types import TypeSchema, compile_types

ASOF = "2001-08-01"

SCHEMA = {
    "types": {
        "place": {"output_dir": "Places", "description": "somewhere"},
        "region": {"extends": "place", "output_dir": "Places"},
        "nation": {"extends": "place", "output_dir": "Places", "recursive": True,
                   "fields": {"parent": {"kind": "relation", "source": ["region", "nation"]}}},
        "party": {"output_dir": "Parties", "description": "a trading partner",
                  "fields": {"balance": {"kind": "number", "description": "open balance"}}},
        "customer": {"extends": "party", "output_dir": "Parties", "fields": {
            "segment": {"kind": "select", "required": True, "options": [
                "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
            "parent": {"kind": "relation", "source": ["nation"]}}},
        "supplier": {"extends": "party", "output_dir": "Parties/Suppliers",
                     "fields": {"parent": {"kind": "relation", "source": ["nation"]}}},
        "order": {"output_dir": "Orders", "fields": {
            "status": {"kind": "select", "required": True, "options": ["O", "F", "P"]},
            "ordered": {"kind": "date", "required": True},
            "total": {"kind": "number", "required": True},
            "priority": {"kind": "text", "required": True, "default": "5-LOW"},
            "rush": {"kind": "boolean"},
            "tags": {"kind": "list"},
            "parent": {"kind": "relation", "source": ["customer"]},
            "parts": {"kind": "relation", "source": ["part"], "multiple": True},
            "overdue": {"kind": "boolean", "derived": {
                "expression": "ordered < '2000-01-01'", "type": "boolean"}}}},
        "part": {"output_dir": "Parts", "fields": {
            "kind": {"kind": "text"}, "size": {"kind": "number"}, "price": {"kind": "number"},
            "aliases": {"kind": "list", "alias": True}}},
        "document": {"output_dir": "Docs", "fields": {
            "lang": {"kind": "select", "options": ["en", "de", "fr", "es"]},
            "chars": {"kind": "number"}, "quality": {"kind": "number"},
            "toxic": {"kind": "number"}, "id": {"kind": "text"},
            "forked-from": {"kind": "text"}}},
        "turn": {"output_dir": "Chats", "fields": {
            "role": {"kind": "select", "options": ["user", "assistant"]},
            "prev": {"kind": "relation", "source": ["turn"]},
            "next": {"kind": "relation", "source": ["turn"]}}},
    },
}


def wiki(c: Column) -> Column:
    return F.concat(F.lit("[["), c, F.lit("]]"))


def note_id(c: Column) -> Column:
    """UUID-shaped id from the digest of a key."""
    h = F.md5(c.cast("string"))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


class Tables:
    """Lazy frames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def schema(self) -> TypeSchema:
        return compile_types(SCHEMA)

    @staticmethod
    def _note(df: DataFrame, type_name: str, folder: Column, name: Column,
              **fields: Column) -> DataFrame:
        return df.select(F.concat(folder, F.lit("/"), name).alias("path"), name.alias("name"),
                         folder.alias("folder"), F.lit(type_name).alias("type"),
                         *[c.alias(k) for k, c in fields.items()])

    @cached_property
    def region(self) -> DataFrame:
        return self._note(self.read("region"), "region", F.lit("Places"), F.col("r_name"),
                          k=F.col("r_regionkey"))

    @cached_property
    def nation(self) -> DataFrame:
        regions = self.read("region")
        df = self.read("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        return self._note(df, "nation", F.lit("Places"), F.col("n_name"),
                          k=F.col("n_nationkey"), parent=wiki(F.col("r_name")))

    def _party(self, table: str, p: str, type_name: str, folder: Column, **fields) -> DataFrame:
        nations = self.read("nation").select("n_nationkey", "n_name")
        df = self.read(table).join(nations, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        return self._note(df, type_name, folder,
                          F.regexp_replace(f"{p}_name", "#", " "),
                          k=F.col("c_custkey" if p == "c" else "s_suppkey"),
                          balance=F.col(f"{p}_acctbal"), parent=wiki(F.col("n_name")), **fields)

    @cached_property
    def customer(self) -> DataFrame:
        return self._party("customer", "c", "customer",
                           F.concat(F.lit("Parties/"), F.col("c_mktsegment")),
                           segment=F.col("c_mktsegment"))

    @cached_property
    def supplier(self) -> DataFrame:
        return self._party("supplier", "s", "supplier", F.lit("Parties/Suppliers"))

    @staticmethod
    def customer_name(key: Column) -> Column:
        return F.concat(F.lit("Customer "), F.lpad(key.cast("string"), 9, "0"))

    @staticmethod
    def order_folder() -> Column:
        return F.concat(F.lit("Orders/"), F.date_format("o_orderdate", "yyyy-MM"))

    @cached_property
    def order(self) -> DataFrame:
        return self._note(
            self.read("orders"), "order", self.order_folder(),
            F.concat(F.lit("Order "), F.col("o_orderkey")), k=F.col("o_orderkey"),
            status=F.col("o_orderstatus"), ordered=F.date_format("o_orderdate", "yyyy-MM-dd"),
            total=F.col("o_totalprice"), priority=F.col("o_orderpriority"),
            parent=wiki(self.customer_name(F.col("o_custkey"))))

    @cached_property
    def part(self) -> DataFrame:
        return self._note(
            self.read("part"), "part", F.concat(F.lit("Parts/"), F.col("p_brand")),
            F.concat(F.lit("Part "), F.col("p_partkey")), k=F.col("p_partkey"),
            kind=F.col("p_type"), size=F.col("p_size"), price=F.col("p_retailprice"),
            alias=F.col("p_name"))

    @cached_property
    def document(self) -> DataFrame:
        # One label row per document by construction, so the optimizer drops this join wherever no
        # label is asked for.
        labels = self.read("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"),
                                                           F.max("toxic").alias("toxic"))
        df = self.read("documents").join(labels, "doc_id", "left")
        return self._note(
            df, "document", F.concat(F.lit("Docs/"), F.col("source")),
            F.concat(F.lit("Doc "), F.col("doc_id")), k=F.col("doc_id"), lang=F.col("lang"),
            chars=F.col("n_chars"), quality=F.col("quality"), toxic=F.col("toxic"),
            id=note_id(F.col("doc_id")),
            forked_from=note_id(F.floor(F.col("doc_id") / 3).cast("bigint")),
            body=F.col("text"))

    @cached_property
    def turn(self) -> DataFrame:
        name = F.concat(F.lit("Turn "), F.col("conv_id"), F.lit("-"), F.col("turn"))
        before = F.concat(F.lit("[[Turn "), F.col("conv_id"), F.lit("-"), F.col("turn") - 1,
                          F.lit("]]"))
        return self._note(
            self.read("conversations"), "turn", F.concat(F.lit("Chats/"), F.col("conv_id")),
            name, k=F.col("turn"), role=F.col("role"),
            prev=F.when(F.col("turn") > 0, before), body=F.col("text"))

    def frame(self, type_name: str) -> DataFrame:
        return getattr(self, type_name)

    def frames(self, *names: str) -> DataFrame:
        """Narrow union of several types: path, name, folder, type."""
        cols = ["path", "name", "folder", "type"]
        return reduce(DataFrame.unionAll, [self.frame(n).select(*cols) for n in names])

    @cached_property
    def index_rows(self) -> DataFrame:
        # Labels play no part in names, so documents come without that join here.
        documents = self.read("documents").select(
            F.concat(F.lit("Docs/"), "source", F.lit("/Doc "), "doc_id").alias("path"),
            F.concat(F.lit("Doc "), "doc_id").alias("name"),
            F.concat(F.lit("Docs/"), "source").alias("folder"), F.lit("document").alias("type"))
        return self.frames("region", "nation", "customer", "supplier", "order", "part").unionAll(documents)

    @cached_property
    def aliases(self) -> DataFrame:
        return self.part.select("path", "name", "type", "alias")

    @cached_property
    def part_links(self) -> DataFrame:
        """Orders' multi-valued ``parts`` field in long form."""
        lines = self.read("lineitem").select("l_orderkey", "l_partkey").distinct()
        orders = self.read("orders").select(
            "o_orderkey", F.concat(self.order_folder(), F.lit("/Order "),
                                   F.col("o_orderkey")).alias("src_path"))
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "src_path", F.lit("order").alias("src_type"), F.lit("parts").alias("field"),
            wiki(F.concat(F.lit("Part "), F.col("l_partkey"))).alias("raw"))

    @cached_property
    def parent_links(self) -> DataFrame:
        parts = [self.frame(n).select(F.col("path").alias("src_path"),
                                      F.col("type").alias("src_type"),
                                      F.lit("parent").alias("field"),
                                      F.col("parent").alias("raw"))
                 for n in ("nation", "customer", "supplier", "order")]
        return reduce(DataFrame.unionAll, parts)

    @cached_property
    def written(self) -> DataFrame:
        """Documents with a tail of links, code, sections and names, all by key arithmetic."""
        k = F.col("doc_id").cast("string")
        m = lambda n: (F.col("doc_id") % n).cast("string")
        tail = F.concat(
            F.lit("\nAsk Part "), m(2500), F.lit(" near NATION_"), m(30), F.lit(" with "),
            F.when(F.col("doc_id") % 2 == 0, "red widget").otherwise("Blue Bolt"), F.lit(" for Doc "),
            (F.col("doc_id") + 1).cast("string"), F.lit(" by Doc "), k, F.lit(" hand.\nNATION_"), m(25),
            F.lit(" again; `Part 1` [[Part 2]] [x](Part 3.md) https://a.b/Part 4 and Part "), m(2000),
            F.lit("7x.\n```\nPart 5 [[Nowhere]]\n```\n## Notes\n- [ ] call NATION_3\n- [x] done "), k,
            F.lit("\n### Links\n[[]] [[Part "), m(2500), F.lit("|it]] [[NATOIN_"), m(25),
            F.lit("]] [f](../src1/Doc%20"), k, F.lit(".md) ![p](pic.png) [u](http://x.y) [[open"))
        return self._note(self.read("documents").withColumn("body", F.concat("text", tail)),
                          "document", F.concat(F.lit("Docs/"), F.col("source")),
                          F.concat(F.lit("Doc "), F.col("doc_id")), k=F.col("doc_id"),
                          body=F.col("body"))

    # -- notes with defects ------------------------------------------------
    @cached_property
    def drifted(self) -> DataFrame:
        """Orders as notes with dynamic headers and, by key arithmetic, every kind of defect."""
        k = F.col("o_orderkey")
        hit = lambda n, r: k % n == r
        status = F.when(hit(7, 0), quoted(F.lower("o_orderstatus"))).when(hit(11, 1), '"X"') \
            .when(hit(13, 2), F.lit(None)).when(hit(17, 3), '""') \
            .otherwise(quoted(F.col("o_orderstatus")))
        total = F.when(hit(19, 4), quoted(k.cast("string"))) \
            .when(hit(23, 5), quoted(F.concat(F.lit("about "), k))) \
            .when(hit(29, 6), F.concat(F.lit("["), k, F.lit("]"))) \
            .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        ordered = F.when(hit(31, 7), quoted(F.date_format("o_orderdate", "yyyy/M/d"))) \
            .when(hit(37, 8), '"soon"').when(hit(41, 9), F.date_format("o_orderdate", "yyyy")) \
            .otherwise(quoted(F.date_format("o_orderdate", "yyyy-MM-dd")))
        priority = F.when(hit(43, 10), F.lit(None)).when(hit(53, 12), '""') \
            .otherwise(quoted(F.col("o_orderpriority")))
        cased = F.when(hit(43, 10) | hit(47, 11), quoted(F.col("o_orderpriority")))
        rush = F.when(hit(3, 0), F.lit(None)).when(hit(59, 13), '"True"').when(hit(61, 14), "1") \
            .otherwise(F.when(k % 2 == 0, "true").otherwise("false"))
        tags = F.when(hit(67, 15), '["a","a"]').when(hit(71, 16), '["a",null," "]') \
            .when(hit(73, 17), '"solo"').when(hit(79, 18), '[1,"b"]') \
            .when(hit(83, 19), '[["x","y"]]')
        parent = F.when(hit(103, 23), quoted(F.concat(F.lit("[[Customer "), k, F.lit("]")))) \
            .when(hit(107, 24), quoted(F.concat(F.lit("Customer "), k))) \
            .otherwise(quoted(wiki(self.customer_name(F.col("o_custkey")))))
        type_name = F.when(hit(109, 25), "ordr").when(hit(113, 26), F.lit(None)).otherwise("order")
        fm = header(type=quoted(type_name), status=status, total=total, ordered=ordered,
                    priority=priority, Priority=cased, rush=rush, tags=tags,
                    tag=F.when(hit(89, 20), '"q"'), totl=F.when(hit(97, 21), "5"),
                    overdue=F.when(hit(101, 22), "true"), parent=parent)
        name = F.concat(F.when(hit(137, 29), "Order: ").otherwise("Order "), k)
        folder = F.when(hit(131, 28), "Misc").otherwise(self.order_folder())
        none = hit(127, 27)
        return self.read("orders").select(
            F.concat(folder, F.lit("/"), name).alias("path"), name.alias("name"),
            folder.alias("folder"), F.when(~none, type_name).alias("type"),
            F.when(~hit(131, 28), "order").alias("directory_type"),
            F.when(~none, F.parse_json(fm)).alias("fm"), k.alias("k"))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def header(**fragments: Column) -> Column:
    """JSON text of a header; null fragments are keys the note does not have."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[
        F.concat(F.lit(f'"{key}":'), c) for key, c in fragments.items()]), F.lit("}"))
