"""Point reads, listings and timelines over the stored tables. Orders are part of the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.snapshots import entity_events


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key) == value)


def events_of(events: DataFrame, corpus_id: str, session_id: str | None = None, limit: int | None = None) -> DataFrame:
    rows = events.where(F.col("corpus_id") == corpus_id)
    rows = rows.where(F.col("session_id") == session_id) if session_id is not None else rows
    rows = rows.orderBy("session_id", "turn_index")
    return rows.limit(limit) if limit is not None else rows


def atoms_of_event(atoms: DataFrame, event_id: str) -> DataFrame:
    return atoms.where(F.col("event_id") == event_id).orderBy("atom_id")


def snapshot(snapshots: DataFrame, corpus_id: str, kind: str, scope_id: str) -> DataFrame:
    return snapshots.where((F.col("corpus_id") == corpus_id) & (F.col("snapshot_kind") == kind) & (F.col("scope_id") == scope_id))


def snapshots_of(snapshots: DataFrame, corpus_id: str, kind: str) -> DataFrame:
    return snapshots.where((F.col("corpus_id") == corpus_id) & (F.col("snapshot_kind") == kind)).orderBy("scope_id")


def objects_of(objects: DataFrame, corpus_id: str, subject: str | None = None) -> DataFrame:
    rows = objects.where(F.col("corpus_id") == corpus_id)
    return rows.orderBy("subject", "slot", "object_id") if subject is None else rows.where(F.col("subject") == subject).orderBy("slot", "object_id")


def versions_of(versions: DataFrame, object_id: str | None = None, corpus_id: str | None = None) -> DataFrame:
    start = F.coalesce("valid_from", F.lit(""))
    if object_id is not None:
        return versions.where(F.col("object_id") == object_id).orderBy(start, "version_id")
    return versions.where(F.col("corpus_id") == corpus_id).orderBy("object_id", start, "version_id")


def links_of(links: DataFrame, corpus_id: str) -> DataFrame:
    return links.where(F.col("corpus_id") == corpus_id).orderBy("event_id", "object_id", "link_id")


def latest_versions(objects: DataFrame, versions: DataFrame) -> DataFrame:
    """Each object with its latest version."""
    v = versions.select(F.col("version_id").alias("latest_version_id"), "value", "summary", F.col("status").alias("version_status"), "valid_from", "operation", F.col("event_id").alias("version_event_id"), F.col("confidence").alias("version_confidence"))
    return objects.join(v, "latest_version_id")


def active_versions(objects: DataFrame, versions: DataFrame, subject: str | None = None) -> DataFrame:
    o = objects if subject is None else objects.where(F.col("subject") == subject)
    return versions.where("status = 'active'").join(o.select("object_id", "subject", "slot"), "object_id").orderBy("subject", "slot", "valid_from", "version_id")


def objects_for_session(objects: DataFrame, links: DataFrame, session_id: str | None = None) -> DataFrame:
    """Objects with evidence in a session; a semi-join, so nothing is made distinct afterwards."""
    l = links if session_id is None else links.where(F.col("session_id") == session_id)
    if session_id is not None:
        return objects.join(l, "object_id", "left_semi").orderBy("subject", "slot", "object_id")
    return l.select("session_id", "object_id").distinct().join(objects.select("object_id", "subject", "slot"), "object_id")


def timeline(objects: DataFrame, versions: DataFrame, links: DataFrame, events: DataFrame, subject: str, limit: int = 32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A subject's objects, their versions, and its first `limit` events."""
    o = objects.where(F.col("subject") == subject)
    v = versions.join(o.select("object_id", "slot"), "object_id", "inner").orderBy("slot", "object_id", F.coalesce("valid_from", F.lit("")), "version_id")
    e = entity_events(events, links.join(o, "object_id", "left_semi"), o, limit).orderBy(F.col("rank").desc())
    return o.orderBy("slot", "object_id"), v, e


def subjects(objects: DataFrame) -> DataFrame:
    return objects.select("corpus_id", "subject").distinct()


def sessions(events: DataFrame) -> DataFrame:
    return events.select("corpus_id", "session_id").distinct()


def corpora(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    return snapshots.select("corpus_id").union(events.select("corpus_id")).where("corpus_id is not null").distinct()


def next_turn_index(events: DataFrame) -> DataFrame:
    return events.groupBy("corpus_id", "session_id").agg((F.max("turn_index") + 1).alias("next_index"))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert's rule: of rows with one key the last by order stays."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def placed(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with their position, from 1, in each group's order: a listing of every group at once."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def first_events(events: DataFrame, limit: int) -> DataFrame:
    """The first events of each session by turn; Spark limits before the shuffle."""
    return placed(events, ["corpus_id", "session_id"], ["turn_index"]).where(F.col("position") <= limit)
