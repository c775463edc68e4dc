"""Ingest with keyed state: turn numbers by session and the current version by object, each in Spark's state store.

A micro-batch touches the state of its own keys alone; the log of what came before is not read. Two queries make the
pipeline: turns are numbered and kept as events, and the events' candidates are decided against their object's state and
kept as actions. Both write to file sinks whose commits are part of the checkpoint, so a restart neither loses nor doubles
a row. There is no watermark: a turn's place is its arrival, and state is kept as long as its object.

Within a micro-batch a key's rows are put in order, so a key may have as many of them as a micro-batch may hold, which the
source's limit (maxFilesPerTrigger and the like) bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from memlake.operators import extract, reconcile

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_VERSION = "event_id string, action string, nv string"


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState asks for this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class TurnNumbers(StatefulProcessor):
    """The next turn_index of each session."""

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "n long")

    def handleInputRows(self, key, rows, timerValues):
        held = pd.concat(list(rows)).sort_values("seq", kind="stable")
        n = self.next.get()[0] if self.next.exists() else 0
        held["turn_index"] = range(n, n + len(held))
        self.next.update((n + len(held),))
        yield held

    def close(self) -> None:
        pass


class Decisions(StatefulProcessor):
    """The latest version of each object, by which its candidates are decided in order."""

    def __init__(self, model: Callable[[dict, dict], str | None] | None = None):
        self.model = model

    def init(self, handle) -> None:
        self.latest = handle.getValueState("latest", _VERSION)
        self.compare = lru_cache(maxsize=1 << 14)(reconcile._compare)

    def handleInputRows(self, key, rows, timerValues):
        held = pd.concat(list(rows)).sort_values(list(reconcile.ORDER), kind="stable")
        first = last = tuple(self.latest.get()) if self.latest.exists() else None
        made = []
        for event, nv, status in zip(held["event_id"], held["normalized_value"], held["status"], strict=True):
            before = last
            action, reason = reconcile.decide_one(last[2] if last else None, nv, status, self.compare, self.model)
            if action in ("ADD", "PATCH", "SUPERSEDE"):
                last = (event, action, nv)
            made.append((action, reason, *(before or (None,) * 3), *(last or (None,) * 3)))
        if last != first:
            self.latest.update(last)
        names = ["action", "reason", *(f"{side}_{c}" for side in ("before", "after") for c in ("event_id", "action", "nv"))]
        held[names] = made
        yield held

    def close(self) -> None:
        pass


def number_turns(turns: DataFrame) -> DataFrame:
    """A stream of turns with turn_index, which continues in each session from micro-batch to micro-batch."""
    use_rocksdb(turns.sparkSession)
    schema = StructType([*turns.schema.fields, *StructType.fromDDL("turn_index long").fields])
    return turns.groupBy("corpus_id", "session_id").transformWithStateInPandas(TurnNumbers(), outputStructType=schema, outputMode="Append", timeMode="None")


def reconcile_stream(candidates: DataFrame, model: Callable[[dict, dict], str | None] | None = None) -> DataFrame:
    """A stream of candidates with action, reason, version_id and previous_version_id, decided as they come."""
    use_rocksdb(candidates.sparkSession)
    sides = ", ".join(f"{side}_{c} string" for side in ("before", "after") for c in ("event_id", "action", "nv"))
    schema = StructType([*candidates.schema.fields, *StructType.fromDDL(f"action string, reason string, {sides}").fields])
    done = candidates.groupBy("object_id").transformWithStateInPandas(Decisions(model), outputStructType=schema, outputMode="Append", timeMode="None")
    both = {f"_{side}": f"if({side}_event_id is null, null, named_struct('event_id', {side}_event_id, 'action', {side}_action, 'nv', {side}_nv))" for side in ("before", "after")}
    return reconcile.name_versions(done.selectExpr("*", *(f"{x} as {n}" for n, x in both.items()))).drop(*(f"{side}_{c}" for side in ("before", "after") for c in ("event_id", "action", "nv")))


def append_stateful(turns: DataFrame, path: str, checkpoint: str, model: Callable | None = None, once: bool = False) -> list[StreamingQuery]:
    """Start both queries: turns to path/events, and those to path/actions. once: take what is there, one query after the other, and stop."""
    spark = turns.sparkSession
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")

    def start(df: DataFrame, name: str) -> StreamingQuery:
        writer = df.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append")
        query = (writer.trigger(availableNow=True) if once else writer).start()
        if once:
            query.awaitTermination()
        return query

    events = extract.events(number_turns(turns))
    first = start(events, "events")
    kept = spark.readStream.schema(events.schema).parquet(f"{path}/events")
    return [first, start(reconcile_stream(extract.candidates(extract.atoms(kept)), model), "actions")]
