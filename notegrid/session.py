"""Session settings and the one lineage-cutting helper every iterative operator uses."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "notegrid", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch one only for local sessions without it."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="notegrid-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder, so a lost executor costs no replay."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

# Runtime settings that matter to the wide row-local expressions here: methods the JVM would refuse
# to compile are split instead of fused, and the list a generator explodes is not computed a second
# time just to test that it is not empty. Dates are UTC days.
# Arrow batches are bounded in bytes too, so that a Python worker's memory does not grow with the rows a task has.
RUNTIME = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.session.timeZone": "UTC",
           "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
EXCLUDED_RULE = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"
SCAN_TASK_BYTES = 128 << 20
BROADCAST_BYTES = 32 << 20


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    excluded = spark.conf.get("spark.sql.optimizer.excludedRules", None) or ""
    if EXCLUDED_RULE not in excluded:
        spark.conf.set("spark.sql.optimizer.excludedRules", ",".join(filter(None, [excluded, EXCLUDED_RULE])))
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input too small to keep the cores busy; leave every other input alone.

    Judged from the plan's size estimate alone: when scanning would give fewer than a quarter of
    the cores a task, heavy row-local work is worth one shuffle of that little data.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SCAN_TASK_BYTES * cores // 4 else df


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Settled copy of a lookup table, marked for broadcast only when its measured size allows.

    The measure counts the text of all rows plus a fixed share per row; beyond the limit the join
    stays a shuffled one.
    """
    from pyspark.sql import functions as F
    table = settle(df)
    width = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in table.columns), F.lit(16))
    size = table.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(table) if size <= limit else table
