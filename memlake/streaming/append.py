"""Streaming ingest: every micro-batch of turns goes through the batch path, keyed by the micro-batch's id.

A turn's place is its arrival, not its time, so there is no watermark: a late turn is applied last. A micro-batch that is
replayed after a failure is found committed and left alone, which makes appends exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from memlake.sources.store import Store


def append_stream(turns: DataFrame, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream of normalised turns to the store."""

    def each(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, batch_id)

    writer = turns.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
