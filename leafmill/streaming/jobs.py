"""Structured streaming over files of events: watermarked windows, sessions, deduplication and stateful counts.

Each job reads a folder as a stream and writes through foreachBatch or a file sink with a checkpoint in the session's shared folder, under
the name that the caller gives. With the available-now trigger a job reads what is there and ends, so the same code serves batch tests and a running stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmill.session import shared_dir

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, root: str, name: str = "events*", files_per_batch: int = 100) -> DataFrame:
    """The event table's files under root as a stream with a fixed schema."""
    return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(root)


def stream_folder(spark: SparkSession, name: str | None) -> str:
    """Where a job of a name keeps its checkpoint and output; a job without one starts anew and never goes on."""
    return f"{shared_dir(spark)}/stream-{name or uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", name: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is available and gives its result so far.

    A job with a name goes on where its last run ended, after a failure as well: the checkpoint knows the batches that are done, and a
    batch that is written again replaces its own rows. append: all rows; complete: those of the last batch; update: the last row of each
    of `keys`, over all batches of all runs.
    """
    spark = stream.sparkSession
    base = stream_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys whose last rows are the result")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{'batch=' + str(number) if mode == 'update' else 'whole'}")

    writer.foreachBatch(keep).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{base}/out/whole")
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{base}/out").parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n: counts in tumbling or sliding windows; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")


def streamed_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_counts(events: DataFrame, idle_ms: int | None = None, late: str = "10 minutes") -> DataFrame:
    """user_id, n: custom state per user, in Arrow batches. With idle_ms, the state of a user whose last event is so far behind the
    watermark is dropped, and the count starts anew; without it every user is kept."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0)
        for b in batches:
            n += len(b)
            last = max(last, int(b["ts"].max().timestamp() * 1000))
        state.update((n, last))
        if idle_ms:
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    rows, timeout = events.select("user_id", "ts"), GroupStateTimeout.NoTimeout
    if idle_ms:
        rows, timeout = rows.withWatermark("ts", late), GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("user_id").applyInPandasWithState(count, "user_id long, n long", "n long, last long", "update", timeout)


def upsert_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], name: str | None = None) -> None:
    """Feeds each micro-batch with its number to a merge that must be idempotent by that number; a job with a name goes on where it ended."""
    base = stream_folder(stream.sparkSession, name)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
