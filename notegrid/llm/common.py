"""Small things every operator here shares: reading tables, label folds, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.session import checkpoint_dir

WORD_BREAK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


# A batch is held several times over, in the executor, in transit and in a worker, and workers keep what they once took.
BATCH_BYTES = "2m"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded in bytes, not only in rows: texts of any length fit beside each other in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    Unlike ``checkpoint()`` later reads take only the columns they use, and rows are compressed.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_fold(key: Column, parts: int, fold: int) -> Column:
    """crc32(key as text) mod ``parts`` is ``fold``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, value: int,
                    most: int) -> DataFrame:
    """About ``most`` texts whose label is ``value``, spread evenly over all rows by a hash of the id.

    Only the sampled label rows, whose number is bounded by ``most`` (with a margin of a half), are
    broadcast. A document counts once, however often it or its label is repeated.
    """
    rows = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .filter(F.col("doc_id").isNotNull() & (F.col("label") == value) & ~held_out).distinct())
    count = rows.count()
    if count > most:
        share = int(most / count * (1 << 31))
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 31)) < share)
    rows = rows.limit(most + most // 2)
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(rows), "doc_id").dropDuplicates(["doc_id"]).select("text", "label"))
