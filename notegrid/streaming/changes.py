"""Workflow rules over an append-only change log as a stream.

``transition_stream`` keeps, per key, the rows that event time has not passed yet and the last value before
them, in Spark's keyed state store. A batch reads and writes the state of the keys it touches, and of those
whose timers fire, not of all keys. Rows wait until the watermark has passed their time and are then judged
in the order of their time, so a row that comes late, but within ``delay``, is judged by the value
before its time, and the rows after it by its own. Later ones are left out by the watermark, as usual.

``judge_batch`` does the same for one batch against a table of last values, without waiting.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from notegrid.operators.workflow import previous_values
from notegrid.types import TypeSchema


# Keyed state with timers needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Entered(StatefulProcessor):
    """Holds rows back until event time has passed them, then tells which enter the wanted value."""

    def __init__(self, columns: list[str], kinds: list[str], entered):
        self.columns, self.kinds, self.entered = columns, kinds, entered

    def init(self, handle) -> None:
        _, tie, value = self.kinds
        self.handle = handle
        self.last = handle.getValueState("last", f"value {value}")
        self.waiting = handle.getListState("waiting", f"micros long, tie {tie}, value {value}")

    def plain(self, value):
        """Whole numbers beside a null come as floats."""
        return int(value) if self.kinds[2] in ("tinyint", "smallint", "int", "bigint") else value

    def handleInputRows(self, key, rows, timerValues):
        """The rows of a key are appended as one list, with one timer for the first of them."""
        _, time, tie, value = self.columns
        first = None
        for part in rows:
            micros = part[time].astype("datetime64[us]").astype("int64")
            fresh = [(int(at), order.item() if hasattr(order, "item") else order, None if pd.isna(now) else self.plain(now))
                     for at, order, now in zip(micros, part[tie], part[value])]
            if fresh:
                self.waiting.appendList(fresh)
                first = min(row[0] for row in fresh) if first is None else min(first, *(row[0] for row in fresh))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Judges all rows that event time has passed; the first of those that stay gets the next timer."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = {(at, tie): now for at, tie, now in self.waiting.get()} if self.waiting.exists() else {}
        due = sorted(place for place in rows if place[0] < passed)
        if not due:
            return
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for place in due:
            now = rows.pop(place)
            if now == self.entered and before != self.entered:
                out.append((key[0], pd.Timestamp(place[0], unit="us"), place[1], now, before))
            before = now
        self.last.update((before,))
        if rows:
            self.waiting.put([(at, tie, now) for (at, tie), now in rows.items()])
            self.handle.registerTimer(min(at for at, _ in rows) // 1000 + 1)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=[*self.columns, "before"])

    def close(self) -> None:
        pass


def transition_stream(log: DataFrame, key: str, time: str, tie: str, value: str, entered: str, delay: str = "10 minutes") -> DataFrame:
    """Streaming rows (key, time, tie, value, before) at which the watched field enters a value.

    ``tie`` tells rows of one key and time apart and orders them. Rows without one of
    the three are left out. Times lie
    before the year 2262, as pandas asks.
    """
    log.sparkSession.conf.set(*STORE)
    columns = [key, time, tie, value]
    log = log.select(key, F.col(time).cast("timestamp").alias(time), tie, value)  # event time has a zone
    kinds = [log.schema[c].dataType.simpleString() for c in columns]
    schema = T.StructType([*log.schema.fields, T.StructField("before", log.schema[value].dataType)])
    rows = log.filter(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(tie).isNotNull()).withWatermark(time, delay)
    return rows.groupBy(key).transformWithStateInPandas(Entered(columns, kinds[1:], entered), outputStructType=schema,
                                                        outputMode="Append", timeMode="EventTime")


def judge_batch(log: DataFrame, state: DataFrame | None, key: str, time: str, tie: str, value: str,
                entered: str) -> tuple[DataFrame, DataFrame]:
    """(entries of this batch, new state). A row older than the key's state is late: it is judged
    against its own batch only and never rewinds the state."""
    known = previous_values(log, key, time, tie, value)
    first = log.groupBy(key).agg(F.min(F.struct(time, tie)).alias("first_"))
    known = known.join(first, key)
    is_first = F.struct(F.col(time), F.col(tie)) == F.col("first_")
    last = log.groupBy(key).agg(F.max_by(F.struct(F.col(time).alias("t"), F.col(value).alias("v")),
                                         F.struct(time, tie)).alias("now_"))
    if state is not None:
        held = state.select(key, F.struct(F.col("last_time").alias("t"), F.col("last_value").alias("v")).alias("old_"))
        known = known.join(held, key, "left").withColumn("before", F.when(
            is_first & (F.col("old_.t") <= F.col(time)), F.col("old_.v")).otherwise(F.col("before")))
        merged = last.join(held, key, "full_outer").select(key, F.when(
            F.col("old_").isNull() | (F.col("now_.t") >= F.col("old_.t")), F.col("now_"))
            .otherwise(F.col("old_")).alias("s"))
    else:
        merged = last.select(key, F.col("now_").alias("s"))
    entries = known.filter((F.col(value) == entered) & ~F.col("before").eqNullSafe(F.lit(entered)))
    return entries.select(*log.columns, "before"), merged.select(
        key, F.col("s.t").alias("last_time"), F.col("s.v").alias("last_value"))


def stream_transitions(log: DataFrame, base: str, key: str, time: str, tie: str, value: str, entered: str, delay: str = "10 minutes",
                       on_entries=None, trigger: dict | None = None) -> StreamingQuery:
    """Run the transition rule over a streaming log; entries land in ``<base>/out/batch=N``.

    A batch that runs again replaces its own files. ``on_entries(entries, batch)`` may derive effects or
    successors from the same rows.
    """
    def step(entries: DataFrame, batch: int) -> None:
        out = f"{base.rstrip('/')}/out/batch={batch}"
        entries.write.mode("overwrite").parquet(out)
        if on_entries is not None:
            on_entries(entries.sparkSession.read.schema(entries.schema).parquet(out), batch)

    return transition_stream(log, key, time, tie, value, entered, delay).writeStream.foreachBatch(step).outputMode("append") \
        .option("checkpointLocation", f"{base.rstrip('/')}/progress").trigger(**(trigger or {"availableNow": True})).start()


def closed(log: DataFrame, base: str, key: str, time: str, tie: str, at: str) -> DataFrame:
    """``log`` followed by one row of time ``at`` and no other use, so that event time passes all rows before it."""
    folder = f"{base.rstrip('/')}/closing"
    spark = log.sparkSession
    needed = (key, tie)
    end = spark.range(1).select(*[F.lit(at).cast(f.dataType).alias(f.name) if f.name == time else
                                  F.lit("0" if f.name in needed else None).cast(f.dataType).alias(f.name) for f in log.schema.fields])
    end.write.mode("overwrite").parquet(folder)
    return log.unionByName(spark.readStream.schema(log.schema).parquet(folder))


def stream_notes(spark: SparkSession, root: str, schema: TypeSchema) -> DataFrame:
    """New and changed note files as a stream of parsed notes; row-local rules apply as they are."""
    from notegrid.sources.notes import directory_type, note_type, parse_notes
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.md") \
        .option("recursiveFileLookup", "true").schema(
        "path string, modificationTime timestamp, length bigint, content binary").load(root)
    notes = parse_notes(files, root)
    return notes.withColumn("type", note_type(schema, F.col("fm"))).withColumn(
        "directory_type", directory_type(schema, F.col("folder")))
