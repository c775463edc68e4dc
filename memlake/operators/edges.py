"""Graph edges of spans: mentions, co-occurrence, atoms' relations and dates, by array functions within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import text as T
from memlake.functions.ids import stable_id


def _edge(key: list[Column], src: Column, relation: Column, dst: Column, confidence: Column) -> Column:
    return F.struct(stable_id("edge", *key).alias("edge_id"), src.alias("src"), relation.alias("relation"), dst.alias("dst"), confidence.cast("double").alias("confidence"))


def graph_edges(events: DataFrame, atoms: DataFrame) -> DataFrame:
    """(edge_id, corpus_id, src, relation, dst, valid_from, confidence, provenance) of events and their atoms.

    A span's entities are its atoms' in order, eight at most, so that pairs within a span are bounded.
    """
    a = F.array_sort(F.collect_list(F.struct("atom_pos", "atom_id", "atom_type", "content", "entities", "canonical_entities", "confidence")))
    rows = events.select("event_id", "raw_span_id", "corpus_id", "speaker", "timestamp", "temporal_grounding").join(atoms.groupBy("event_id").agg(a.alias("atoms")), "event_id")
    raw = F.slice(F.array_distinct(F.flatten(F.transform("atoms", lambda x: F.when(F.size(x["canonical_entities"]) > 0, x["canonical_entities"]).otherwise(x["entities"])))), 1, 8)
    rows = rows.withColumn("entities", F.array_distinct(F.filter(F.transform(raw, T.canonicalize_entity), lambda x: x != ""))).withColumn("said", F.array_join(F.transform("atoms", lambda x: F.lower(x["content"])), " "))
    span, speaker = F.col("raw_span_id"), F.col("speaker")
    mentions = F.transform("entities", lambda e: _edge([span, speaker, e, F.lit("mentions")], speaker, F.lit("mentions"), e, F.lit(0.5)))
    against = T.contains_any(F.col("said"), ["failed", "not ", "no longer", "instead of", "replaced", "contradict"])
    towards = T.contains_any(F.col("said"), ["support", "because", "therefore", "so that", "decision", "prefer"])
    relation, confidence = F.when(against, "contradicts").when(towards, "supports").otherwise("co_occurs_with"), F.when(against, 0.5).when(towards, 0.45).otherwise(0.4)
    rows = rows.withColumns({"_r": relation, "_k": confidence})
    pairs = F.flatten(F.transform("entities", lambda l, i: F.transform(F.slice("entities", i + 2, 8), lambda r: _edge([span, l, r, F.col("_r")], l, F.col("_r"), r, F.col("_k")))))

    def of_atom(x: Column) -> Column:
        low = F.lower(x["content"])
        rel = F.when(T.contains_any(low, ["failed", "not ", "no longer", "contradict"]), "contradicts").when(T.contains_any(low, ["instead", "replace", "supersede", "updated", "changed"]), "supersedes").otherwise("supports")
        named = F.filter(F.transform(F.slice(x["entities"], 1, 4), T.canonicalize_entity), lambda e: e != "")
        return F.transform(named, lambda e: _edge([span, x["atom_id"], e, rel], x["atom_type"], rel, e, F.greatest(F.lit(0.45), x["confidence"])))

    g = F.col("temporal_grounding")
    day = F.coalesce(g["grounded_date"], g["grounded_month"], g["grounded_year"].cast("string"))
    dated = F.when(day.isNotNull(), F.array(_edge([span, speaker, day, F.lit("occurred_on")], speaker, F.lit("occurred_on"), day, F.lit(0.55)))).otherwise(F.slice(mentions, 1, 0))
    every = F.concat(mentions, pairs, F.flatten(F.transform("atoms", of_atom)), dated)
    return rows.select("corpus_id", F.col("timestamp").alias("valid_from"), F.col("raw_span_id").alias("provenance"), F.explode(every).alias("e")).select("e.*", "corpus_id", "valid_from", "provenance")
