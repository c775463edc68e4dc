"""Session, entity and root snapshots as bounded group-wise summaries.

Texts enter a snapshot in a fixed order until its character limit is reached, and a text takes at least one character:
so of each group only the first few hundred rows can matter to it. They are picked by a partial window limit before any
array is made, which bounds what a task gathers however large a session or an entity is. References are merged over all
texts: each reference's first place in a group is a pre-aggregated minimum, and the first few by place stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from memlake.functions import text as T
from memlake.functions.ids import stable_id
from memlake.operators.extract import LINE_REFS

SUMMARY, SYNOPSIS, REFS = 760, 180, 16


def _top(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark limits before and after the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n)


def _gather(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    sorted_ = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*by).agg(F.transform(sorted_, lambda x: x["_v"]).alias(name))


def _merged_refs(texts: list[tuple[DataFrame, list[str], str]], by: list[str], limit: int = REFS, name: str = "entity_refs") -> DataFrame:
    """(by, name): the first `limit` distinct references of the tables (rows, order, text) of texts, one table after another, each in its order; text may be an array of references."""
    found = []
    for part, (rows, order, text) in enumerate(texts):
        refs = F.col(text) if isinstance(rows.schema[text].dataType, ArrayType) else T.memory_references(F.array(text), LINE_REFS)
        each = rows.select(*by, F.struct(F.lit(0).alias("_"), *order).alias("at"), F.posexplode(refs).alias("pos", "ref"))
        first = each.groupBy(*by, "ref").agg(F.min(F.struct("at", "pos")).alias("at"))
        found.append(first.withColumn("part", F.lit(part)))
    # A part's places are its own; all parts' first references are ranked within the part, then across parts.
    ranked = [_top(f, by, ["at"], limit).select(*by, "ref", "part", "_n") for f in found]
    every = reduce(DataFrame.union, ranked).groupBy(*by, "ref").agg(F.min(F.struct("part", "_n")).alias("at"))
    return _gather(_top(every, by, ["at"], limit), by, ["at"], "ref", name)


def _text_columns(first: str, second: str) -> dict[str, Column]:
    return {"summary": T.summarize_texts(F.concat(first, second), SUMMARY), "synopsis": T.synopsis(F.concat(F.slice(first, 1, 4), F.slice(second, 1, 4)), SYNOPSIS), "entity_refs": _array("entity_refs")}


def time_range(first: Column, last: Column) -> Column:
    return F.when(first.isNotNull(), F.concat(first, F.lit(".."), last))


def _array(name: str) -> Column:
    return F.coalesce(F.col(name), T.words_array([])).alias(name)


def session_objects(links: DataFrame, objects: DataFrame, latest: DataFrame) -> DataFrame:
    """(corpus_id, session_id, object_id, subject, slot, summary, status) once for each object with evidence in a session."""
    pairs = links.select("corpus_id", "session_id", "object_id").distinct()
    return pairs.join(objects.select("object_id", "subject", "slot", "latest_version_id"), "object_id").join(latest.select(F.col("version_id").alias("latest_version_id"), "summary", "status"), "latest_version_id")


def session_snapshots(events: DataFrame, objects: DataFrame, versions: DataFrame, links: DataFrame, title: str = "") -> DataFrame:
    by = ["corpus_id", "session_id"]
    held = session_objects(links, objects, versions)
    order = ["subject", "slot", "object_id"]
    on = held.where("status = 'active'")
    active = _gather(_top(on, by, order, SUMMARY), by, order, "summary", "states")
    ids = _gather(_top(held, by, order, 24), by, order, "object_id", "object_ids")
    counts = held.groupBy(*by).agg(F.count("*").alias("num_objects"))
    said = events.withColumn("line", F.concat_ws(": ", "speaker", "text"))
    lines = _gather(_top(said, by, ["turn_index"], SUMMARY), by, ["turn_index"], "line", "lines")
    refs = _merged_refs([(on, order, "summary"), (said, ["turn_index"], "line_refs")], by)
    tail = _top(said, by, [F.col("turn_index").desc()], 24)
    ends = tail.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("turn_index", "event_id", "raw_span_id"))).alias("tail"))
    dated = events.groupBy(*by).agg(F.count("*").alias("num_events"), F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("turn_index"))).alias("t0"), F.max_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("turn_index"))).alias("t1"))
    rows = dated.join(lines, by).join(ends, by).join(active, by, "left").join(ids, by, "left").join(counts, by, "left").join(refs, by, "left")
    rows = rows.select(*by, "num_events", F.coalesce("num_objects", F.lit(0)).alias("num_objects"), "t0", "t1", "tail", "lines", _array("states"), _array("object_ids"), "entity_refs").withColumns(_text_columns("states", "lines"))
    ids_of = F.transform("tail", lambda x: x["event_id"])
    return rows.select(
        stable_id("snap", F.col("corpus_id"), F.lit("session"), F.col("session_id")).alias("snapshot_id"), "corpus_id", stable_id("snap", F.col("corpus_id"), F.lit("root")).alias("parent_id"),
        F.lit("session").alias("snapshot_kind"), F.col("session_id").alias("scope_id"), F.concat(F.lit(f"{title}:"), "session_id").alias("title"), "synopsis", "summary", "object_ids", ids_of.alias("event_ids"),
        F.transform("tail", lambda x: x["raw_span_id"]).alias("raw_refs"), F.slice(ids_of, F.greatest(F.lit(1), F.size(ids_of) - 11), 12).alias("child_ids"), "entity_refs", T.canonicalize_entities("entity_refs").alias("canonical_entity_refs"),
        time_range(F.col("t0"), F.col("t1")).alias("time_range"), "num_events", "num_objects",
    )


def entity_events(events: DataFrame, links: DataFrame, objects: DataFrame, limit: int = 12) -> DataFrame:
    """(subject, event columns, rank): the first `limit` events of each subject by session ascending and turn descending.

    An event belongs to a subject that its references name or that an object with evidence in it is about.
    """
    subjects = objects.select("corpus_id", "subject").distinct()
    by_link = links.join(objects.select("object_id", "subject"), "object_id").select("corpus_id", "event_id", "subject")
    by_ref = events.select("corpus_id", "event_id", F.explode("canonical_entity_refs").alias("subject")).join(subjects, ["corpus_id", "subject"], "left_semi").select("corpus_id", "event_id", "subject")
    pairs = by_link.union(by_ref).distinct()
    slim = events.select("event_id", "session_id", "turn_index", "speaker", "text", "timestamp", "raw_span_id", "line_refs")
    return _top(pairs.join(slim, "event_id"), ["corpus_id", "subject"], ["session_id", F.col("turn_index").desc(), "event_id"], limit).withColumnRenamed("_n", "rank")


def entity_snapshots(events: DataFrame, objects: DataFrame, versions: DataFrame, links: DataFrame, title: str = "") -> DataFrame:
    by = ["corpus_id", "subject"]
    order = ["slot", "object_id", "_from", "version_id"]
    held = versions.where("status = 'active'").join(objects.select("object_id", "subject", "slot"), "object_id").withColumn("_from", F.coalesce("valid_from", F.lit("")))
    active = _gather(_top(held, by, order, SUMMARY), by, order, "summary", "states")
    ids = _gather(_top(objects, by, ["slot", "object_id"], 32), by, ["slot", "object_id"], "object_id", "object_ids")
    counts = objects.groupBy(*by).agg(F.count("*").alias("num_objects"))
    recent = entity_events(events, links, objects).withColumns({"line": F.concat_ws(": ", "speaker", "text"), "_last": -F.col("rank")})
    refs = _merged_refs([(counts, [], "subject"), (held, order, "summary"), (recent, ["_last"], "line_refs")], by)
    # Twelve at most; reversed: the last by rank comes first.
    recent = recent.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_last").alias("r"), "event_id", "raw_span_id", "line", "timestamp"))).alias("recent"))
    rows = counts.join(ids, by).join(active, by, "left").join(recent, by, "left").join(refs, by, "left")
    rows = rows.withColumn("recent", F.coalesce("recent", F.array().cast(rows.schema["recent"].dataType))).select(*by, "num_objects", "object_ids", _array("states"), "recent", F.transform("recent", lambda x: x["line"]).alias("lines"), "entity_refs")
    rows = rows.withColumns(_text_columns("states", "lines"))
    stamps = F.filter(F.transform("recent", lambda x: x["timestamp"]), lambda x: x.isNotNull() & (x != ""))
    return rows.select(
        stable_id("snap", F.col("corpus_id"), F.lit("entity"), F.col("subject")).alias("snapshot_id"), "corpus_id", stable_id("snap", F.col("corpus_id"), F.lit("root")).alias("parent_id"),
        F.lit("entity").alias("snapshot_kind"), F.col("subject").alias("scope_id"), F.concat(F.lit(f"{title}:"), "subject").alias("title"), "synopsis", "summary", "object_ids",
        F.transform("recent", lambda x: x["event_id"]).alias("event_ids"), F.transform("recent", lambda x: x["raw_span_id"]).alias("raw_refs"), F.slice("object_ids", 1, 24).alias("child_ids"), "entity_refs",
        T.canonicalize_entities("entity_refs").alias("canonical_entity_refs"), time_range(F.get(stamps, F.lit(0)), F.try_element_at(stamps, F.lit(-1))).alias("time_range"), F.size("recent").cast("long").alias("num_events"), "num_objects",
    )


def root_snapshot(events: DataFrame, sessions: DataFrame, entities: DataFrame, title: str = "") -> DataFrame:
    """One row for each corpus from a batch's session and entity snapshots; its own last events where there are none."""
    by = ["corpus_id"]
    pick = lambda df, n, last: _top(df, by, [F.col("scope_id").desc() if last else F.col("scope_id")], n)
    s = _gather(pick(sessions, 6, True), by, ["scope_id"], "summary", "s")
    e = _gather(pick(entities, 6, False), by, ["scope_id"], "summary", "e")
    # Children: all of the batch's sessions, so their number follows the batch and not the corpus.
    kids = sessions.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("scope_id", "snapshot_id"))).alias("kids"), F.count("*").alias("num_sessions"))
    some = _gather(pick(entities, 24, False), by, ["scope_id"], "snapshot_id", "some")
    number = entities.groupBy(*by).agg(F.count("*").alias("num_entities"))
    tail = _top(events, by, [F.col("session_id").desc(), F.col("turn_index").desc()], 24)
    tail = tail.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("session_id", "turn_index", "event_id", "raw_span_id", F.concat_ws(": ", "speaker", "text").alias("line")))).alias("tail"))
    order = F.when(F.col("timestamp").isNotNull(), F.struct("session_id", "turn_index"))
    dated = events.groupBy(*by).agg(F.count("*").alias("num_events"), F.min_by("timestamp", order).alias("t0"), F.max_by("timestamp", order).alias("t1"))
    rows = dated.join(tail, by).join(s, by, "left").join(e, by, "left").join(kids, by, "left").join(some, by, "left").join(number, by, "left")
    parts = F.concat(F.coalesce("s", T.words_array([])), F.coalesce("e", T.words_array([])))
    lines = F.transform("tail", lambda x: x["line"])
    inputs = F.when(F.size(parts) > 0, parts).otherwise(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 11), 12))
    rows = rows.withColumn("inputs", inputs).withColumn("entity_refs", T.memory_references("inputs", 20))
    children = F.concat(F.coalesce(F.transform("kids", lambda x: x["snapshot_id"]), T.words_array([])), F.coalesce("some", T.words_array([])))
    return rows.select(
        stable_id("snap", F.col("corpus_id"), F.lit("root")).alias("snapshot_id"), "corpus_id", F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("snapshot_kind"), F.col("corpus_id").alias("scope_id"),
        F.lit(title).alias("title"), T.synopsis(F.slice("inputs", 1, 6), 220).alias("synopsis"), T.summarize_texts("inputs", 900).alias("summary"), T.words_array([]).alias("object_ids"), F.transform("tail", lambda x: x["event_id"]).alias("event_ids"),
        F.transform("tail", lambda x: x["raw_span_id"]).alias("raw_refs"), children.alias("child_ids"), "entity_refs", T.canonicalize_entities("entity_refs", 20).alias("canonical_entity_refs"), time_range(F.col("t0"), F.col("t1")).alias("time_range"),
        "num_events", F.coalesce("num_sessions", F.lit(0)).alias("num_sessions"), F.coalesce("num_entities", F.lit(0)).alias("num_entities"),
    )
