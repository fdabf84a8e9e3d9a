"""Snapshot deliveries as a stream: changes and versions are recomputed for the keys a delivery touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def late_rows(rows: DataFrame, time: str, key: str, delay: str, window: str) -> DataFrame:
    """Rows per key and event-time window; rows later than `delay` behind the watermark are left out of open windows.

    For a stream of delivered rows: what arrived in time for the delivery it belongs to.
    """
    return rows.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count("*").alias("rows"))


def first_seen(rows: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """The first of repeated rows; the state of a key is dropped once the watermark has passed it by `delay`."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def append(result: DataFrame, name: str, folder: str) -> StreamingQuery:
    """Append the closed windows to an in-memory table, for tests and inspection."""
    return result.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
