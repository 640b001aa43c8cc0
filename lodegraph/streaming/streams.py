"""Structured Streaming forms of the change log, usage and queue operators.

Events carry their own time; state is bounded by a watermark of an hour, and later rows are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "1 hour"


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream, with ts as a timestamp."""
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts by window and type."""
    return events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: the focus set's touches that lie no further apart than its time to live."""
    s = events.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark([key])


def merged_tasks(events: DataFrame) -> DataFrame:
    """project, kind, merged, priority: the queue's fold as state by (project, kind): a task that comes while one is pending joins it."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key, batches, state):
        merged, priority = state.get if state.exists else (0, 2**31 - 1)
        for b in batches:
            merged, priority = merged + len(b), min(priority, int(b["priority"].min()))
        state.update((merged, priority))
        yield pd.DataFrame({"project": [key[0]], "kind": [key[1]], "merged": [merged], "priority": [priority]})

    return events.groupBy("project", "kind").applyInPandasWithState(fold, "project long, kind string, merged long, priority long", "merged long, priority long", "update", GroupStateTimeout.NoTimeout)


def start(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append", once: bool = True):
    """Hands each batch to sink with its number; a batch that comes again has the number it had, so a sink that overwrites by number writes once."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(availableNow=True) if once else w).start()


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own number, keys kept together."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return put
