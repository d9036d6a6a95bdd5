"""Numbering and free names that stay distributed however many rows want the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from notegrid.session import settle


def number_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Row numbers 1..n per group in the given order, without one task per group.

    Rows are range-partitioned on group and order, so a large group spreads over many partitions;
    each piece is numbered on its own and shifted by the sizes of the group's earlier pieces, of
    which there are at most as many as partitions.
    """
    ranged = settle(df.repartitionByRange(F.col(group), *[F.col(c) for c in order])
                    .withColumn("piece_", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "piece_").agg(F.count(F.lit(1)).alias("size_"))
    before = W.partitionBy(group).orderBy("piece_").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(group, "piece_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("shift_"))
    inner = F.row_number().over(W.partitionBy(group, "piece_").orderBy(*order))
    return ranged.withColumn("nth_", inner).join(shifts, [group, "piece_"]).withColumn(
        name, (F.col("nth_") + F.col("shift_")).cast("bigint")).drop("piece_", "nth_", "shift_")


def free_names(wanted: DataFrame, notes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``no`` and ``free_name`` to rows with a ``want``ed name: the first free number each.

    "Plan" is number 1 of "Plan", "Plan 3" is number 3. The n-th new row takes the n-th number no
    existing note uses. With used numbers u1 < u2 < ... that is n plus how many uj lie before it,
    those with uj - j < n; sorting both by that key makes the answer a row number.
    """
    stems = notes.select(F.explode(F.array(
        F.struct(F.col("name").alias("want"), F.lit(1).cast("bigint").alias("used")),
        F.struct(F.regexp_replace("name", r" \d+$", "").alias("want"),
                 F.regexp_extract("name", r" (\d+)$", 1).try_cast("bigint").alias("used")))).alias("s")) \
        .select("s.want", "s.used").filter("used >= 1").distinct()
    taken = stems.join(wanted.select("want").distinct(), "want", "left_semi")
    used = number_within(taken, "want", ["used"], "j").select(
        "want", (F.col("used") - F.col("j")).alias("key_"), F.lit(1).alias("is_used"), F.lit(None).alias("row_"))
    keep = F.struct(*[c for c in wanted.columns if c != "want"])
    fresh = number_within(wanted, "want", order, "n_").select(
        "want", F.col("n_").alias("key_"), F.lit(0).alias("is_used"), keep.alias("row_"))
    both = number_within(fresh.unionByName(used), "want", ["key_", "is_used"], "no").filter("is_used = 0")
    name = F.when(F.col("no") == 1, F.col("want")).otherwise(
        F.concat("want", F.lit(" "), F.col("no").cast("string")))
    return both.select("want", "row_.*", "no", name.alias("free_name"))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row from several one-row reports, put together by an aggregate."""
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    columns: list[Column] = [F.max(c).alias(c) for c in out.columns]
    return out.agg(*columns)
