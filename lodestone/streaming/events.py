"""Structured Streaming over an event table: windows, sessions, deduplication and thread state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table's file as a stream, with a session-zone timestamp."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, late: str = "1 day", size: str = "6 hours") -> DataFrame:
    """Counts and sums of each type in windows of a fixed size; later events than the watermark allows are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, late: str = "1 day", size: str = "1 day", step: str = "12 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, late: str = "1 day", gap: str = "2 hours") -> DataFrame:
    """Sessions of a user: events with less than ``gap`` between them."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each request once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


THREAD = "user_id long, turn_count long, last_type string"
#: A thread that had no event for so long, by the watermark, is forgotten.
IDLE_MS = 30 * 24 * 3_600_000


def thread_state(events: DataFrame, late: str = "1 day", idle_ms: int = IDLE_MS) -> DataFrame:
    """A user's thread: how many events there have been and the last one's type, kept across batches until it is idle."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, at, event, last = state.get if state.exists else (0, 0, -1, "")
        for rows in batches:
            count += len(rows)
            newest = rows.sort_values(["ts", "event_id"]).iloc[-1]
            if (newest["ts"].value, newest["event_id"]) >= (at, event):
                at, event, last = newest["ts"].value, int(newest["event_id"]), newest["event_type"]
        state.update((count, at, event, last))
        state.setTimeoutTimestamp(max(at // 1_000_000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "turn_count": [count], "last_type": [last]})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, THREAD, "n long, at long, event long, type string", "update", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that there is, and give the rows that its batches wrote to a shared folder.

    A batch that is run again overwrites what it wrote; in complete mode the last batch counts.
    """
    spark = stream.sparkSession
    rows = lambda number: f"{folder}/rows/batch={0 if mode == 'complete' else number}"
    spark.createDataFrame([], stream.schema).write.parquet(rows(-1))
    query = stream.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(rows(number))).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/*").select(stream.columns)
