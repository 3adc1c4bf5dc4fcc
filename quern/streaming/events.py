"""The dialect over streams: windows with watermarks, upserts and registered functions for every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources import keyed


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and key; rows later than the watermark are dropped when it is a stream."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def upsert_batches(path: str, key: str, order: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into a keyed table, whose files out of the batch's keys stay as they are.

    A batch that comes again is left out by its number.  The last ``keep`` versions stay for readers that began before.
    """

    def merge(batch: DataFrame, number: int) -> None:
        keyed.upsert(batch.sparkSession, path, batch, key, order, number)
        keyed.vacuum(batch.sparkSession, path, keep)

    return merge
