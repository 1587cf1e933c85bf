"""Push sinks: handlers called with each event, in the order of its document, where the rows are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StreamingQuery

Handler = Callable[[int, Row], None]
# opens a partition's handler, by batch and partition; None if these were handled before
Opener = Callable[[int, int], Handler | None]


def push(events: DataFrame, opener: Opener, keys: list[str], batch: int = 0, partitions: int | None = None) -> None:
    """Call a handler with ``(mask bit, row)`` for every event: each document whole in a partition, its events by number.

    ``opener(batch, partition)`` runs on the executor and gives the partition's handler. A task that is lost runs again and
    its handler gets the same rows in the same order, so one that keeps what it did under ``(batch, partition)`` (and gives
    None, or writes over it, when opened again) handles each event once. A handler with ``close()`` is closed at the end.
    Rows don't go through the driver. ``keys`` name a document; of documents with null keys all events come as one.
    """
    # a stated number is not changed at run time, so a batch that is run again has the same partitions
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = events.repartition(n, *keys).sortWithinPartitions(*keys, "seq")

    def handle(rows: Iterator[Row]) -> None:
        handler = opener(batch, TaskContext.get().partitionId())
        if handler is None:
            return
        for row in rows:
            handler(row["event_mask"], row)
        close = getattr(handler, "close", None)
        if close is not None:
            close()

    laid.foreachPartition(handle)


def push_stream(events: DataFrame, opener: Opener, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """The same for every batch of a stream: a batch that is run again after a failure has its number again."""

    def batch(df: DataFrame, number: int) -> None:
        push(df, opener, keys, number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
