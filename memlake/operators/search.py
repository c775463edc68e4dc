"""Hybrid retrieval: snapshots, then events, by cosine, term overlap and boosts; exact, for a batch of questions at once.

The questions are the small side: they are broadcast only up to MAX_QUESTIONS, beyond which callers pass them in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from memlake.functions import answers as A
from memlake.functions import text as T
from memlake.functions.temporal import parse_anchor, temporal_hints
from memlake.functions.vectors import cosine, nearest, nulls_in, unit_rows

MAX_QUESTIONS = 10_000
Embed = Callable[[Column], Column]


def analyse(questions: DataFrame, embed: Embed | None = None) -> DataFrame:
    """(qid, question) with terms, entities, hints, diversity and embedding."""
    hints = temporal_hints("question")
    rows = questions.withColumns({"terms": T.query_terms("question"), "entities": F.transform(T.extract_entities("question"), lambda x: F.lower(T.strip(x))), "hints": hints, "q_embedding": embed(F.col("question")) if embed else F.lit(None).cast("array<double>")})
    dated = F.col("hints.year").isNotNull() | F.col("hints.month").isNotNull() | F.col("hints.day").isNotNull()
    return rows.withColumn("diverse", dated | F.startswith(T.strip(F.lower("question")), F.lit("how many ")))


def _meet(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Every row with every question of a bounded set."""
    n = questions.limit(MAX_QUESTIONS + 1).count()
    if n > MAX_QUESTIONS:
        raise ValueError(f"more than {MAX_QUESTIONS} questions; pass them in blocks")
    return rows.join(F.broadcast(questions), F.lit(True))


def _best(df: DataFrame, k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)


def searchable_snapshots(snapshots: DataFrame, embed: Embed | None = None) -> DataFrame:
    """Snapshots with what a search reads of them, computed once when they are made: snapshot_terms and, with a model, embedding."""
    terms = T.query_terms(F.concat_ws(" ", "title", "synopsis", "summary", F.array_join("canonical_entity_refs", " ")))
    rows = snapshots.withColumn("snapshot_terms", terms)
    return rows.withColumn("embedding", embed(F.col("summary"))) if embed else rows


def rank_snapshots(snapshots: DataFrame, questions: DataFrame, k: int = 6) -> DataFrame:
    """Top k snapshots of each question; ties go root, entities, sessions, each by scope."""
    rows = snapshots if "snapshot_terms" in snapshots.columns else searchable_snapshots(snapshots)
    both = _meet(rows, questions)
    named = (F.col("snapshot_kind") == "entity") & (F.array_contains("entities", F.col("scope_id")) | F.array_contains("terms", F.col("scope_id")))
    score = 0.35 * T.term_overlap(F.col("terms"), F.col("snapshot_terms")) + F.when(named, 0.4).otherwise(0.0)
    if "embedding" in snapshots.columns:
        score = score + 0.8 * cosine("q_embedding", "embedding")
    kind = F.when(F.col("snapshot_kind") == "root", 0).when(F.col("snapshot_kind") == "entity", 1).otherwise(2)
    return _best(both.withColumn("score", F.round(score, 6)), k, F.col("score").desc(), kind, "scope_id").drop("snapshot_terms")


def select_events(top: DataFrame, by_subject: DataFrame) -> DataFrame:
    """(qid, event_id) of the events that top snapshots list, and of the recent events of entities that a question or its top snapshots name."""
    listed = top.select("qid", F.explode("event_ids").alias("event_id"))
    scopes = top.where("snapshot_kind = 'entity'").select("qid", F.col("scope_id").alias("subject")).union(top.select("qid", F.explode("entities").alias("subject"))).distinct()
    return listed.union(scopes.join(by_subject.select("subject", "event_id"), "subject").select("qid", "event_id")).distinct()


def temporal_score(hints: Column, anchor: Column) -> Column:
    hit = lambda a, b, w: F.when(a == b, w).otherwise(0.0)
    return hit(hints["year"], F.year(anchor), 0.18) + hit(hints["month"], F.month(anchor), 0.28) + hit(hints["day"], F.dayofmonth(anchor), 0.36)


def searchable_events(events: DataFrame, embed: Embed | None = None, metadata_text: Column | None = None) -> DataFrame:
    """Events with what a search reads of them, computed once at ingest: event_terms, anchor and, with a model, embedding."""
    terms = T.query_terms(F.concat_ws(" ", F.col("text"), F.array_join("canonical_entity_refs", " "), *([metadata_text] if metadata_text is not None else [])))
    rows = events.withColumns({"event_terms": terms, "anchor": parse_anchor("timestamp")})
    return rows.withColumn("embedding", embed(F.col("surface"))) if embed else rows


def rank_events(events: DataFrame, questions: DataFrame, selected: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """All of searchable_events(), or those of pairs (qid, event_id), scored for each question, and their day.

    The questions that chose an event are gathered by event and joined to the events before these meet the questions, so the
    product of both is never shuffled.
    """
    if selected is not None:
        choosers = selected.groupBy("event_id").agg(F.collect_set("qid").alias("chosen_by"))  # of a bounded set of questions
        events = events.join(choosers, "event_id", "left")
    both = _meet(events, questions) if pairs is None else pairs.join(events, "event_id").join(F.broadcast(questions), "qid")
    score = 0.55 * T.term_overlap(F.col("terms"), F.col("event_terms")) + temporal_score(F.col("hints"), F.col("anchor")) + F.when(F.array_contains("entities", F.lower(T.strip("speaker"))), 0.22).otherwise(0.0)
    if "embedding" in events.columns:
        score = score + 0.9 * cosine("q_embedding", "embedding")
    if selected is not None:
        score = score + F.when(F.array_contains("chosen_by", F.col("qid")), 0.15).otherwise(0.0)
    return both.withColumns({"score": F.round(score, 6), "day": F.to_date("anchor")}).drop("event_terms", "chosen_by")


def evidence_spans(ranked: DataFrame, k: int = 8) -> DataFrame:
    """Top k spans of each question. Diverse questions first take the best of each day (undated ones are never held back), then the rest.

    A row that k rows of its question and day go before can't be among them; those are dropped before the shuffle.
    """
    order = [F.col("score").desc(), "session_id", "turn_index", "event_id"]
    rows = ranked.withColumn("_d", F.row_number().over(Window.partitionBy("qid", "day").orderBy(*order))).where(F.col("_d") <= k)
    later = F.when(F.col("diverse") & F.col("day").isNotNull() & (F.col("_d") > 1), 1).otherwise(0)
    return _best(rows.withColumn("later", later), k, "later", *order).drop("_d")


def expand_objects(top: DataFrame, objects: DataFrame, latest: DataFrame) -> DataFrame:
    """Latest versions of the objects of top snapshots, in order, at most 24, then of named entities until there are twelve."""
    ids = top.select("qid", "rank", F.posexplode("object_ids").alias("pos", "object_id"))
    ids = ids.groupBy("qid", "object_id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    first = _best(ids.withColumn("tier", F.lit(0)), 24, "at", "object_id").select("qid", "object_id", "tier", F.col("rank").alias("n"))
    scopes = top.where("snapshot_kind = 'entity'").groupBy("qid", F.col("scope_id").alias("subject")).agg(F.min("rank").alias("r"))
    more = scopes.join(objects.select("object_id", "subject", "slot"), "subject").join(first, ["qid", "object_id"], "left_anti")
    more = _best(more, 25, "r", "slot", "object_id").select("qid", "object_id", F.lit(1).alias("tier"), F.col("rank").alias("n"))
    have = first.groupBy("qid").agg(F.count("*").alias("have"))
    more = more.join(have, "qid", "left").where(F.col("n") <= F.greatest(F.lit(1), 12 - F.coalesce("have", F.lit(0)))).drop("have")
    rows = first.union(more).join(latest, "object_id")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("tier", "n"))).drop("tier", "n")


def top_similar(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, key, score, rank): exact top k by cosine.

    The queries, a bounded set, go to the tasks as one matrix. Of each batch of vectors a matrix product tells which can be among a
    query's first k; those alone are scored as cosine() does, term by term, and ranked.
    """
    asked = queries.select("qid", F.col(vector).cast("array<double>").alias("_q"))
    held = asked.limit(MAX_QUESTIONS + 1).toArrow()
    if held.num_rows > MAX_QUESTIONS:
        raise ValueError(f"more than {MAX_QUESTIONS} questions; pass them in blocks")
    qids, wanted = held.column("qid").combine_chunks(), held.column("_q").to_pylist()
    q, q_nulls = unit_rows(wanted), nulls_in(wanted)
    rows = vectors.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
    schema = StructType([StructField("qid", asked.schema["qid"].dataType), StructField(key, rows.schema["_k"].dataType), StructField("_s", DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                given = part.column(1).to_pylist()
                v, v_nulls = unit_rows(given), nulls_in(given)
                for b in range(0, len(qids), 512):
                    at, of, scores = nearest(v, q, b, b + 512, k)
                    # Null elements make a null cosine of vectors of one length.
                    null = (v_nulls[at] | q_nulls[of]) & (v[1][at] == q[1][of])
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(of)), part.column(0).take(pa.array(at)), pa.array(scores, mask=null)], names=["qid", key, "_s"])

    met = rows.mapInArrow(run, schema)
    return _best(met.select("qid", key, F.round("_s", 6).alias("score")), k, F.col("score").desc(), key)


def ordered_ids(top: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(qid, id, position): the ids that top snapshots list, each once, by the rank of the first that lists it and the place there."""
    ids = top.select("qid", "rank", F.posexplode(column).alias("pos", "id")).groupBy("qid", "id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    rows = ids.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("at", "id")).cast("long")).drop("at")
    return rows.where(F.col("position") <= limit) if limit is not None else rows


def pages(top: DataFrame) -> DataFrame:
    """Top snapshots as pages, by rank, without their embeddings."""
    return top.select(
        "qid", "rank", F.col("snapshot_id").alias("page_id"), "corpus_id", "parent_id", F.col("snapshot_kind").alias("level"), "title", "synopsis", "summary", F.col("snapshot_kind").alias("page_kind"),
        *(F.coalesce(c, T.words_array([])).alias(c) for c in ("entity_refs", "canonical_entity_refs", "raw_refs", "child_ids")), "time_range", "score",
    )


def raw_spans(ranked: DataFrame) -> DataFrame:
    return ranked.select("qid", "rank", F.coalesce("raw_span_id", "event_id").alias("span_id"), "corpus_id", "session_id", "speaker", "text", "turn_index", "timestamp", "metadata", "score")


def state_atoms(expanded: DataFrame) -> DataFrame:
    """Latest versions of objects as atoms."""
    return expanded.select(
        "qid", "position", F.col("latest_version_id").alias("atom_id"), F.coalesce("version_event_id", "latest_version_id").alias("span_id"), F.col("slot").alias("atom_type"), F.col("summary").alias("content"),
        "memory_kind", F.col("version_status").alias("status"), F.col("valid_from").alias("time_range"), F.col("version_confidence").alias("confidence"),
    )


def answer_views(questions: DataFrame, evidence: dict[str, DataFrame]) -> DataFrame:
    """(qid, question, view, text) of a search's evidence."""
    gather = lambda df, at, *cols: df.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(at, F.struct(*cols).alias("x")))), lambda r: r["x"]).alias("a"))
    p, f, s = gather(evidence["pages"], "rank", "title", "synopsis", "summary"), gather(evidence["atoms"], "position", "content"), gather(evidence["raw_spans"], "rank", "timestamp", "speaker", "text")
    rows = questions.join(p.withColumnRenamed("a", "p"), "qid", "left").join(f.select("qid", F.transform("a", lambda r: r["content"]).alias("f")), "qid", "left").join(s.withColumnRenamed("a", "s"), "qid", "left")
    rows = rows.withColumn("view", A.answer_view("question", "p", "f", "s"))
    return rows.select("qid", "question", "view", A.render_view("question", "view").alias("text"))


def search(questions: DataFrame, tables: dict[str, DataFrame], embed: Embed | None = None, spans: int = 8) -> dict[str, DataFrame]:
    """The evidence of each question: pages in the order of their path, spans and atoms, and no edges."""
    from memlake.operators.lookups import latest_versions
    from memlake.operators.snapshots import entity_events

    q = analyse(questions, embed)
    top = rank_snapshots(tables["snapshots"], q)
    recent = entity_events(tables["events"], tables["links"], tables["objects"])
    events = tables["events"] if "event_terms" in tables["events"].columns else searchable_events(tables["events"], embed)
    ranked = rank_events(events, q, select_events(top, recent))
    held = expand_objects(top, tables["objects"], latest_versions(tables["objects"], tables["versions"]))
    return {"traversal_path": top.select("qid", "rank", "snapshot_id"), "pages": pages(top), "raw_spans": raw_spans(evidence_spans(ranked, spans)), "atoms": state_atoms(held)}
