"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's input.

STAGES lists (name, function); a function takes (spark, docs, folder of the tables) and returns the
rows that go on, with the columns of ``documents`` in all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.llm import minhash, mixing, packing, quality, toxicity
from notegrid.llm.common import table
from notegrid.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows whose toxicity score is under 0.3, scored by a lexicon of all labelled input rows."""
    lexicon = toxicity.learn(docs, table(spark, folder, "labels"), F.lit(False))
    return toxicity.score(docs, lexicon, 0.3, keep=(*COLUMNS,)).filter("predicted = 0").select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows whose quality score is 0.5 or more."""
    model = quality.learn(docs, table(spark, folder, "labels"), F.lit(False))
    return quality.score(docs, model, 0.5, keep=(*COLUMNS,)).filter("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near copies by five-word shingles: the smallest doc_id's, once. Rows without doc_id stay.

    Rows that share a doc_id but not their text are judged each by its own group.
    """
    kept = (minhash.near_duplicates(docs, words=5, nodes_too=True).filter("kept AND doc_id IS NOT NULL")
            .groupBy("doc_id", "root").agg(F.coalesce(F.min("node"), F.lit(0)).alias("set")).select("doc_id", "set"))
    named = minhash.with_node(docs.filter("doc_id IS NOT NULL").select(*COLUMNS), 5).withColumn("set", F.coalesce("node", F.lit(0)))
    named = named.join(kept, ["doc_id", "set"], "left_semi").dropDuplicates(["doc_id", "set"])
    return named.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mix of the sources at weights 5, 2, 1: a row per copy, shard after shard in mixed order, n_chars of the text taken."""
    mixed = mixing.mixed_rows(mixing.mix(docs.select(*COLUMNS)), COLUMNS)
    order = ["_shard", "_order", F.xxhash64("doc_id", "text")]  # ranges of a shard are tasks of their own
    return (mixed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n_chars", F.length("text").cast("long"))
            .select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 1024 tokens, with their ids."""
    import public_tokenizers
    items = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    return packing.pack(items, 1024).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                                            "ids_crc32", "ids", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Learnt scores and token ids have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
