"""Exact event ranking that scores only what can reach the top: term postings, and cells with score bounds.

The index files each event under its terms and its speaker, and in a cell: its day and the pivot whose direction is
nearest to its embedding. What shares no term with a question, is not chosen for it, and whose speaker it doesn't name has the
score of its date, which its cell knows, and of its cosine, which the cell bounds: a vector at an angle of at most r from the
pivot is no closer to the question than the angle between question and pivot less r. So a question first scores the events
that its postings give; the k-th best of them is a threshold; then it opens only those cells whose bound reaches it. Both steps are
equi-joins, and the rest is never met. Results are those of rank_events() and evidence_spans(), row by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.functions.vectors import cosine
from memlake.operators.search import evidence_spans, rank_events, temporal_score
from memlake.sources.scratch import written

PIVOTS = 32
#: Added to bounds, for scores are rounded to six places.
SLACK = 2e-6


@dataclass
class EventIndex:
    """events: searchable_events() with cell; postings (term, event_id); cells (cell, day, pivot, radius, n); pivots: unit vectors."""

    events: DataFrame
    postings: DataFrame
    cells: DataFrame
    pivots: list[list[float]]


def _angle(c: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def index_events(events: DataFrame, pivots: int = PIVOTS) -> EventIndex:
    """Index searchable_events(). Pivots are `pivots` events drawn by a hash of their ids: what is drawn changes the bounds, never the results. Events without a date or a vector have cells of their own."""
    found: list[list[float]] = []
    if "embedding" in events.columns:
        size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
        some = events.where(F.col("embedding").isNotNull()).withColumn("_n", size).where("_n > 0").orderBy(F.xxhash64("event_id"), "event_id").limit(pivots)
        drawn = some.select(F.transform("embedding", lambda x: x / F.col("_n")).alias("v")).collect()
        found = [list(v) for v in dict.fromkeys(tuple(r["v"]) for r in drawn)]  # a direction drawn twice is one pivot
    rows = events.withColumn("day", F.to_date("anchor"))
    if found:
        # The pivots are unit vectors, so the vector is brought to that length once and each cosine is a sum of products.
        size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        dot = lambda u, p: F.when(F.size(u) == len(p), F.aggregate(F.zip_with(u, F.lit(p), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
        near = lambda u: F.array_max(F.array(*(F.struct(dot(u, p).alias("c"), F.lit(i).alias("p")) for i, p in enumerate(found))))
        vector = F.transform("embedding", lambda x: x.cast("double"))
        of = T.let(vector, lambda v: T.let(size(v), lambda n: F.when(n != 0, T.let(F.transform(v, lambda x: x / n), near))))
        rows = rows.withColumn("_near", F.when(F.col("embedding").isNotNull(), of))
        rows = rows.withColumns({"_pivot": F.coalesce(F.col("_near.p"), F.lit(-1)), "_off": F.coalesce(_angle(F.col("_near.c")), F.lit(0.0))}).drop("_near")
    else:
        rows = rows.withColumns({"_pivot": F.lit(-1), "_off": F.lit(0.0)})
    rows = written(rows.withColumn("cell", F.concat_ws("/", F.coalesce(F.col("day").cast("string"), F.lit("")), F.col("_pivot").cast("string"))), "cells")
    cells = written(rows.groupBy("cell", "day", F.col("_pivot").alias("pivot")).agg(F.max("_off").alias("radius"), F.count("*").alias("n")), "bounds")
    speaker = F.array(F.concat(F.lit("\x00"), F.lower(T.strip("speaker"))))
    postings = written(rows.select(F.explode(F.array_distinct(F.concat("event_terms", speaker))).alias("term"), "event_id"), "postings")
    return EventIndex(rows.drop("_pivot", "_off", "day"), postings, cells, found)


def bounds(index: EventIndex, questions: DataFrame) -> DataFrame:
    """(qid, cell, bound, n): the most that an event of a cell can score for a question by its date and vector alone. Cells are few beside events, and questions a bounded set."""
    both = index.cells.join(F.broadcast(questions.select("qid", "hints", "q_embedding")), F.lit(True))
    pivots = F.array(*(F.lit(p) for p in index.pivots)) if index.pivots else None
    if pivots is None:
        close = F.lit(0.0)
    else:
        angle = _angle(cosine("q_embedding", F.element_at(pivots, F.col("pivot") + 1)))
        close = F.when(F.col("pivot") < 0, 0.0).otherwise(F.cos(F.greatest(F.lit(0.0), F.least(F.lit(math.pi), angle - F.col("radius") - 1e-7))))
        # A question without a vector has a cosine of 0 with everything.
        close = F.when(F.col("q_embedding").isNull(), 0.0).otherwise(F.greatest(close, F.lit(0.0)))
    return both.select("qid", "cell", (temporal_score(F.col("hints"), F.col("day")) + 0.9 * close + SLACK).alias("bound"), "n")


def ranked_spans(index: EventIndex, questions: DataFrame, selected: DataFrame | None = None, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """evidence_spans(rank_events(...), k), and (qid, scored, events): how many events each question was scored on, of how many.

    A question that wants diverse days is thresholded by the k-th best of days' best events: where there are k of them, nothing else is among its spans.
    """
    # Questions and their terms are a bounded set, which Spark can't know: without a hint it would shuffle the postings and all that is scored by them.
    asked = questions.select("qid", F.explode(F.array_distinct(F.concat("terms", F.transform("entities", lambda e: F.concat(F.lit("\x00"), e))))).alias("term"))
    listed = index.postings.join(F.broadcast(asked), "term").select("qid", "event_id")
    if selected is not None:
        listed = listed.union(selected.select("qid", "event_id"))
    listed = written(listed.distinct(), "listed")
    first = written(_scored(index, questions, listed, selected), "first")
    # The k-th best of what counts: for diverse questions of each day's best, undated events each by themselves. Behind k of its day nothing counts.
    by_day = Window.partitionBy("qid", "day").orderBy(F.col("score").desc())
    counted = first.withColumn("_d", F.row_number().over(by_day)).where(F.col("_d") <= k).where(~F.col("diverse") | F.col("day").isNull() | (F.col("_d") == 1))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc())
    least = counted.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k).select("qid", F.col("score").alias("least"))
    opened = bounds(index, questions).join(least, "qid", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("qid", "cell")
    more = written(opened.join(index.events.select("cell", "event_id"), "cell").select("qid", "event_id").join(listed, ["qid", "event_id"], "left_anti"), "more")
    every = first if more.isEmpty() else first.unionByName(written(_scored(index, questions, more, selected), "scored"))
    share = every.groupBy("qid").agg(F.count("*").alias("scored")).withColumn("events", F.lit(index.events.count()))
    # What isn't read to rank is read for the spans alone.
    spans = evidence_spans(every, k)
    rest = index.events.select("event_id", *(c for c in index.events.columns if c not in every.columns and c not in ("cell", "event_terms")))
    return rest.join(F.broadcast(spans), "event_id"), share


#: What scores and orders of spans read of an event.
_READ = ("event_id", "session_id", "turn_index", "speaker", "event_terms", "anchor", "embedding")


def _scored(index: EventIndex, questions: DataFrame, pairs: DataFrame, selected: DataFrame | None) -> DataFrame:
    return rank_events(index.events.select(*(c for c in _READ if c in index.events.columns)), questions, selected, pairs)
