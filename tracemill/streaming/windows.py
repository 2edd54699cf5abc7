"""Event-time windows and incremental reads; extras of the engine that batches share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import changes
from tracemill.session import materialise, shared_dir


def tumbling(events: DataFrame, ts: str, by: str, value: str, width: str, late: str) -> DataFrame:
    """Count and sum per window and key; rows later than `late` behind the newest are dropped in a stream."""
    held = events.withWatermark(ts, late) if events.isStreaming else events
    g = held.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(28,9)")).cast("double").alias("amount"))
    return g.select(F.unix_micros("w.start").alias("start"), by, "n", "amount")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str) -> DataFrame:
    held = events.withWatermark(ts, late) if events.isStreaming else events
    g = held.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.unix_micros("w.start").alias("start"), by, "n")


def after(log: DataFrame, key: str, offset: int) -> DataFrame:
    """Rows of a log behind an offset."""
    return log.filter(F.col(key) > offset)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Drives a stream through what there is now, batch by batch, with its checkpoint in the shared folder."""
    import uuid

    spark = stream.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


class ChangeApplier:
    """Keeps the state of a change feed over batches: each batch is folded and merged; repeats and late rows change nothing that is newer."""

    def __init__(self, keys: list[str], seq: str, op: str, payload: list[str]):
        self.keys, self.seq, self.op, self.payload = keys, seq, op, payload
        self.state: DataFrame | None = None

    def __call__(self, batch: DataFrame, _: int = 0) -> None:
        part = changes.fold_changes(batch, self.keys, self.seq, self.op, self.payload)
        self.state = materialise(part if self.state is None else changes.merge_states(self.state, part, self.keys), "state")

    def rows(self) -> DataFrame | None:
        return None if self.state is None else changes.current_rows(self.state, self.keys, self.payload)


def file_stream(spark: SparkSession, folder: str, schema, pattern: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)
