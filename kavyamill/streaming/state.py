"""Structured Streaming: keyed daily quotas, latest-wins state, sliding windows, resumable file streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def quota_stream(events: DataFrame, key: str, time: str, limit: int = 10) -> DataFrame:
    """(key, day, event_id, accepted): the first `limit` events of each key and day, in the order of arrival.

    The state is one day and one count a key; a batch's rows of a key are taken by time and id. A later day resets the
    count, an earlier one is rejected.
    """
    rows = events.select(F.col(key).cast("string").alias("k"), F.date_format(time, "yyyy-MM-dd").alias("day"), "event_id", F.col(time).alias("t"))

    def count(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        today, used = state.get if state.exists else ("", 0)
        batch = pd.concat(list(parts)).sort_values(["t", "event_id"])
        accepted = []
        for day in batch["day"]:
            if day > today:
                today, used = day, 0
            good = day == today and used < limit
            used += good
            accepted.append(bool(good))
        state.update((today, used))
        yield pd.DataFrame({"k": k[0], "day": batch["day"].to_numpy(), "event_id": batch["event_id"].to_numpy(), "accepted": accepted})

    return rows.groupBy("k").applyInPandasWithState(count, "k string, day string, event_id long, accepted boolean", "day string, used int", "append", GroupStateTimeout.NoTimeout)


def latest_stream(events: DataFrame, key: str, order: list[str], rest: list[str]) -> DataFrame:
    """The last row of each key so far, as an updating aggregate."""
    best = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("last"))
    return best.select(key, *[f"last.{c}" for c in (*order, *rest)])


def windowed_counts(events: DataFrame, time: str, size: str, slide: str, late: str) -> DataFrame:
    """Counts in sliding windows, closed by a watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def run_to_end(stream: DataFrame, mode: str, sink: str, checkpoint: str) -> None:
    """Process all that is there and stop; the checkpoint makes a rerun go on from there."""
    stream.writeStream.outputMode(mode).format("parquet" if mode == "append" else "memory").queryName(sink.rsplit("/", 1)[-1]).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
