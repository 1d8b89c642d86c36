"""Snapshot announcements as an event stream: repeats and late ones dropped, state bounded.

Announcements may come more than once (a retried publish, several watchers) and out of order.
``dropDuplicatesWithinWatermark`` keeps the first announcement of each snapshot and forgets the
key once the event-time watermark has passed it by ``delay``, so the state holds only the
snapshots of the last ``delay`` however long the stream runs; an announcement later than the
watermark is dropped as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

__all__ = ["ARRIVALS", "distinct_arrivals", "follow_arrivals"]

ARRIVALS = "snapshot string, announced_at timestamp"


def distinct_arrivals(arrivals: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first announcement of each snapshot within ``delay`` of event time."""
    return arrivals.withWatermark("announced_at", delay).dropDuplicatesWithinWatermark(["snapshot"])


def follow_arrivals(
    spark: SparkSession, source: str, sink: str, checkpoint: str, delay: str = "1 hour",
    every: str | None = None,
) -> StreamingQuery:
    """Streams JSON announcements from ``source`` into Parquet at ``sink``, repeats dropped.

    Without ``every`` it processes what is there and stops.
    """
    stream = spark.readStream.schema(ARRIVALS).json(source)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        distinct_arrivals(stream, delay)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
