"""Registered queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memlake.functions import answers as A
from memlake.functions import temporal as TM
from memlake.functions import text as T
from memlake.functions.ids import stable_id
from memlake.functions.vectors import cosine
from memlake.operators import edges, evaluate, extract, lookups, reconcile, search, snapshots
from memlake.plans import oracle as O
from memlake.sources import scratch
from memlake.sources.turns import conversation_turns, event_turns

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "reconcile_singleton_actions"


def query(sql: str | None = None):
    """Register a query under its function's name.

    Constraint propagation is off for the session: it multiplies the nested expressions of these plans at planning time
    and could only add null checks.
    """

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[tuple, tuple[str, StructType]] = {}


def _shared(spark, sf_dir, name, build) -> DataFrame:
    """An intermediate table that many queries read: written once, so that plans above it begin with a scan, and again where its folder is gone."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept or not scratch.exists(spark, _kept[key][0]):
        path = scratch.folder(spark, name)
        _kept[key] = path, scratch.written(build(), name, path).schema
    path, schema = _kept[key]
    return spark.read.schema(schema).parquet(path)


def release() -> None:
    """Give up all shared intermediate tables."""
    if spark := SparkSession.getActiveSession():
        for path, _ in _kept.values():
            scratch.delete(spark, path)
    _kept.clear()


def ev(spark, sf_dir):
    return _shared(spark, sf_dir, "events", lambda: extract.events(event_turns(spark, sf_dir)))


def atom_rows(spark, sf_dir):
    return _shared(spark, sf_dir, "atoms", lambda: extract.atoms(ev(spark, sf_dir)))


def cand(spark, sf_dir):
    return _shared(spark, sf_dir, "candidates", lambda: extract.candidates(atom_rows(spark, sf_dir)))


def acts(spark, sf_dir):
    return _shared(spark, sf_dir, "actions", lambda: reconcile.reconcile(cand(spark, sf_dir)))


def state(spark, sf_dir):
    a = acts(spark, sf_dir)
    made = [_shared(spark, sf_dir, n, lambda f=f: f(a)) for n, f in (("objects", reconcile.objects), ("versions", reconcile.versions), ("links", reconcile.evidence_links))]
    return ev(spark, sf_dir), *made


def session_rows(spark, sf_dir):
    return _shared(spark, sf_dir, "sessions", lambda: snapshots.session_snapshots(*state(spark, sf_dir), "ev"))


def entity_rows(spark, sf_dir):
    return _shared(spark, sf_dir, "entities", lambda: snapshots.entity_snapshots(*state(spark, sf_dir), "ev"))


#: In the order in which they build on each other.
SHARED = {"events": ev, "atoms": atom_rows, "candidates": cand, "actions": acts, "state": lambda spark, sf_dir: state(spark, sf_dir)[1], "sessions": session_rows, "entities": entity_rows}


def joined(c):
    return F.array_join(c, "|")


# ---------------------------------------------------------------- turns and events


@query(O.q(O.CONV_TURNS, f"SELECT session_id, seq AS turn_index, {O.stable_id('evt', 'corpus_id', 'session_id', '(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1)', 'speaker', 'text')} AS event_id FROM conv_turns"))
def events_stable_ids(spark, sf_dir):
    e = extract.assign_turn_index(conversation_turns(spark, sf_dir))
    return e.select("session_id", F.col("seq").alias("turn_index"), stable_id("evt", "corpus_id", "session_id", "turn_index", "speaker", "text").alias("event_id"))


@query(O.q(O.CONV_TURNS, "SELECT session_id, count(*) AS next_index FROM conv_turns GROUP BY session_id"))
def next_turn_index(spark, sf_dir):
    return lookups.next_turn_index(extract.assign_turn_index(conversation_turns(spark, sf_dir))).select("session_id", "next_index")


@query(O.q(O.EVENTS, "SELECT event_id, raw_span_id, session_id, turn_index, speaker, array_to_string(refs, '|') AS entity_refs, array_to_string(canon_refs, '|') AS canonical_refs FROM events_x"))
def event_records(spark, sf_dir):
    return ev(spark, sf_dir).select("event_id", "raw_span_id", "session_id", "turn_index", "speaker", joined("entity_refs").alias("entity_refs"), joined("canonical_entity_refs").alias("canonical_refs"))


# ---------------------------------------------------------------- text functions


@query(f"SELECT p_partkey, {O.norm('p_name')} AS normalized, {O.canon('p_name')} AS canonical FROM part")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.normalize_text("p_name").alias("normalized"), T.canonicalize_entity("p_name").alias("canonical"))


@query("SELECT page_id, lower(trim(regexp_replace(url, '[^a-zA-Z0-9_]+', '_', 'g'), '_')) AS clean FROM pages")
def sanitize_id(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.sanitize_id("url").alias("clean"))


@query(O.q(O.EVENTS, "SELECT event_id, array_to_string(sem, '|') AS refs FROM events_x"))
def semantic_refs(spark, sf_dir):
    return ev(spark, sf_dir).select("event_id", joined("semantic_refs").alias("refs"))


@query(O.q(f"{O.CONV_TURNS}, {O.entity_ctes('conv_turns', 'text', 'e', True)}", "SELECT session_id, seq, array_to_string(ents, '|') AS entities FROM e"))
def extract_entities(spark, sf_dir):
    return conversation_turns(spark, sf_dir).select("session_id", "seq", joined(T.extract_entities("text")).alias("entities"))


_KEYWORDS = O.hyphens(rf"regexp_extract_all({O.unicode('lower(text)')}, '\b[a-zA-Z][a-zA-Z0-9_-]{{3,}}\b')")


@query(f"WITH w AS (SELECT doc_id, unnest({_KEYWORDS}) AS token FROM documents) SELECT doc_id, token, count(*) AS n FROM w WHERE length(token) > 3 AND token NOT IN {O._in(T.KEYWORD_STOPWORDS)} GROUP BY ALL HAVING count(*) >= 2")
def keyword_repeats(spark, sf_dir):
    w = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[a-zA-Z][a-zA-Z0-9_-]{3,}\b"), 0)).alias("token"))
    return w.where(~F.col("token").isin(T.KEYWORD_STOPWORDS)).groupBy("doc_id", "token").agg(F.count("*").alias("n")).where("n >= 2")


@query(O.q(O.EV_TURNS, f"SELECT (epoch_us(moment) - 1704067200000000) * 1000000 + event_no AS seq, {O.kind(repr('observation'), 'text')} AS memory_kind, {O.status('text')} AS status FROM ev_turns"))
def memory_kind(spark, sf_dir):
    return event_turns(spark, sf_dir).select("seq", T.memory_kind(F.lit("observation"), "text").alias("memory_kind"), T.atom_status("text").alias("status"))


@query(f"SELECT a.p_partkey AS a, b.p_partkey AS b, round({O.jaccard('a.p_name', 'b.p_name')}, 6) AS overlap FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey")
def token_jaccard_pairs(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    a, b = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")), p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return a.join(b, F.col("a") + 1 == F.col("b")).select("a", "b", F.round(T.token_overlap("x", "y"), 6).alias("overlap"))


@query(O.q(f"{O.CONV_TURNS}, t AS (SELECT session_id, seq, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 2))) AS q FROM conv_turns)", "SELECT session_id, seq, array_to_string(q, '|') AS tokens FROM t"))
def query_tokens(spark, sf_dir):
    return conversation_turns(spark, sf_dir).select("session_id", "seq", joined(F.array_sort(T.query_tokens("text"))).alias("tokens"))


@query(O.q(O.CONV_TURNS, "SELECT session_id, seq, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM conv_turns"))
def token_estimate(spark, sf_dir):
    return conversation_turns(spark, sf_dir).select("session_id", "seq", A.estimate_tokens("text").alias("tokens"))


@query(f"SELECT event_id, strftime(ts, '%Y-%m-%d') AS anchor_date, strftime(ts, '%Y-%m') AS anchor_month, CASE event_type WHEN 'click' THEN strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') WHEN 'view' THEN NULL WHEN 'signup' THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS grounded_date, CASE event_type WHEN 'view' THEN CAST(year(ts) - 1 AS INTEGER) END AS grounded_year, CASE event_type WHEN 'signup' THEN strftime(ts - INTERVAL 1 MONTH, '%Y-%m') END AS grounded_month, CASE event_type WHEN 'click' THEN strftime(ts - INTERVAL 1 DAY, '%-d %B %Y') WHEN 'view' THEN CAST(year(ts) - 1 AS VARCHAR) WHEN 'signup' THEN strftime(ts - INTERVAL 1 MONTH, '%B, %Y') ELSE strftime(ts, '%-d %B %Y') END AS formatted FROM events")
def temporal_grounding(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "click", "Done yesterday").when(F.col("event_type") == "view", "It was last year.").when(F.col("event_type") == "signup", "since LAST MONTH").otherwise("nothing")
    stamp = F.date_format("ts", "h:mm a 'on' d MMMM, yyyy")
    e = e.withColumn("g", TM.temporal_grounding(said, stamp))
    return e.select("event_id", "g.anchor_date", "g.anchor_month", "g.grounded_date", "g.grounded_year", "g.grounded_month", TM.format_grounded("g").alias("formatted"))


# ---------------------------------------------------------------- atoms, candidates, reconciliation


@query(O.q(O.ATOMS, "SELECT atom_id, event_id, atom_type, memory_kind, status, confidence, array_to_string(canon_refs, '|') AS canonical FROM atoms_x"))
def heuristic_atoms(spark, sf_dir):
    return atom_rows(spark, sf_dir).select("atom_id", "event_id", "atom_type", "memory_kind", "status", "confidence", joined("canonical_entities").alias("canonical"))


@query(O.q(O.CANDIDATES, f"SELECT {O.stable_id('cand', 'event_id', 'atom_id', 'subject', 'slot', 'nv')} AS candidate_id, object_id, event_id, atom_id, subject, slot, policy, nv AS normalized_value, status FROM cand"))
def state_candidates(spark, sf_dir):
    return cand(spark, sf_dir).select("candidate_id", "object_id", "event_id", "atom_id", "subject", "slot", "policy", "normalized_value", "status")


@query(O.q(O.CANDIDATES, "SELECT subject, slot, count(*) AS n FROM cand GROUP BY subject, slot"))
def subject_slots(spark, sf_dir):
    return cand(spark, sf_dir).groupBy("subject", "slot").agg(F.count("*").alias("n"))


_ACTION_SQL = "SELECT object_id, event_id, atom_id, slot, action, reason FROM acts WHERE policy = '{}'"


@query(O.q(O.ACTIONS, _ACTION_SQL.format("multi"), True))
def reconcile_multi(spark, sf_dir):
    return reconcile.reconcile_multi(cand(spark, sf_dir)).select("object_id", "event_id", "atom_id", "slot", "action", "reason")


@query(O.q(O.ACTIONS, _ACTION_SQL.format("singleton"), True))
def reconcile_singleton_actions(spark, sf_dir):
    return reconcile.reconcile_streaming_fold(cand(spark, sf_dir)).select("object_id", "event_id", "atom_id", "slot", "action", "reason")


@query(O.q(O.ACTIONS, _ACTION_SQL.format("singleton"), True))
def reconcile_array_fold(spark, sf_dir):
    return reconcile.reconcile_singleton(cand(spark, sf_dir)).select("object_id", "event_id", "atom_id", "slot", "action", "reason")


@query(O.q(O.ACTIONS, _ACTION_SQL.format("singleton").replace("reason FROM", "reason, version_id FROM"), True))
def reconcile_streaming_fold(spark, sf_dir):
    return reconcile.reconcile_streaming_fold(cand(spark, sf_dir)).select("object_id", "event_id", "atom_id", "slot", "action", "reason", "version_id")


@query(O.q(O.ACTIONS, "SELECT action, reason, count(*) AS n FROM acts GROUP BY action, reason", True))
def action_histogram(spark, sf_dir):
    return reconcile.action_histogram(acts(spark, sf_dir))


@query(O.q(O.CANDIDATES, "SELECT count(DISTINCT object_id) AS misses, count(*) - count(DISTINCT object_id) AS hits FROM cand"))
def cache_hit_miss(spark, sf_dir):
    return reconcile.cache_counters(cand(spark, sf_dir))


@query(O.q(O.ACTIONS, "SELECT version_id, object_id, operation, status, valid_from, valid_to, previous_version_id, summary FROM vers", True))
def version_windows(spark, sf_dir):
    return reconcile.versions(acts(spark, sf_dir)).select("version_id", "object_id", "operation", "status", "valid_from", "valid_to", "previous_version_id", "summary")


@query(O.q(O.ACTIONS, "SELECT object_id, subject, slot, policy, memory_kind, latest_version_id, created_at_event_id, updated_at_event_id FROM objs", True))
def object_current(spark, sf_dir):
    return reconcile.objects(acts(spark, sf_dir)).select("object_id", "subject", "slot", "policy", "memory_kind", "latest_version_id", "created_at_event_id", "updated_at_event_id")


@query(O.q(O.ACTIONS, "SELECT o.object_id, o.subject, o.slot, v.summary, v.status AS version_status FROM objs o JOIN vers v ON v.version_id = o.latest_version_id", True))
def latest_version_join(spark, sf_dir):
    _, o, v, _ = state(spark, sf_dir)
    return lookups.latest_versions(o, v).select("object_id", "subject", "slot", "summary", "version_status")


@query(O.q(O.ACTIONS, "SELECT subject, slot, version_id, valid_from FROM vers WHERE status = 'active' AND subject = 'user1'", True))
def active_versions_for_subject(spark, sf_dir):
    _, o, v, _ = state(spark, sf_dir)
    return lookups.active_versions(o, v, "user1").select("subject", "slot", "version_id", "valid_from")


@query(O.q(O.ACTIONS, "SELECT link_id, object_id, version_id, event_id, role FROM links", True))
def evidence_links(spark, sf_dir):
    return reconcile.evidence_links(acts(spark, sf_dir)).select("link_id", "object_id", "version_id", "event_id", "role")


@query(O.q(O.ACTIONS, "SELECT object_id, subject, slot FROM objs WHERE EXISTS (SELECT 1 FROM links l WHERE l.object_id = objs.object_id AND l.session_id = 'session-3')", True))
def objects_for_session(spark, sf_dir):
    _, o, _, l = state(spark, sf_dir)
    return lookups.objects_for_session(o, l, "session-3").select("object_id", "subject", "slot")


@query(O.q(O.ACTIONS, "SELECT subject, event_id, rank FROM ent_ev WHERE rank <= 12", True))
def entity_events_top12(spark, sf_dir):
    e, o, _, l = state(spark, sf_dir)
    return snapshots.entity_events(e, l, o).select("subject", "event_id", F.col("rank").cast("long").alias("rank"))


@query(O.q(O.ACTIONS, "SELECT event_id, session_id, rank FROM ent_ev WHERE rank <= 32 AND subject = 'user1'", True))
def entity_timeline(spark, sf_dir):
    e, o, v, l = state(spark, sf_dir)
    o1 = o.where("subject = 'user1'")
    return snapshots.entity_events(e, l, o1, 32).select("event_id", "session_id", F.col("rank").cast("long").alias("rank"))


@query(O.q(f"{O.ACTIONS}, {O.CONV_TURNS}", "SELECT 'subject' AS what, subject AS name FROM objs UNION SELECT 'session', session_id FROM events_x UNION SELECT 'corpus', corpus_id FROM events_x UNION SELECT 'corpus', corpus_id FROM conv_turns", True))
def listings(spark, sf_dir):
    e, o, _, _ = state(spark, sf_dir)
    c = conversation_turns(spark, sf_dir)
    out = lookups.subjects(o).select(F.lit("subject").alias("what"), F.col("subject").alias("name")).union(lookups.sessions(e).select(F.lit("session"), "session_id"))
    return out.union(lookups.corpora(c.select("corpus_id"), e.select("corpus_id")).select(F.lit("corpus"), "corpus_id"))


@query(O.q(O.ACTIONS, "SELECT 'events_written' AS metric, count(*) AS value FROM events_x UNION ALL SELECT 'atoms_written', count(*) FROM atoms_x UNION ALL SELECT 'state_candidates', count(*) FROM acts UNION ALL SELECT 'objects_written', count(*) FROM acts WHERE action <> 'NONE' UNION ALL SELECT 'evidence_links', count(*) FROM links UNION ALL SELECT 'action_' || action, count(*) FROM acts GROUP BY action", True))
def ingest_report(spark, sf_dir):
    e = ev(spark, sf_dir)
    a = acts(spark, sf_dir)
    return evaluate.ingest_report(e, atom_rows(spark, sf_dir), a, reconcile.evidence_links(a))


# ---------------------------------------------------------------- snapshots


@query(O.q(O.SESSIONS, "SELECT snapshot_id, scope_id, summary, synopsis, array_to_string(object_ids, '|') AS object_ids, array_to_string(event_ids, '|') AS event_ids, array_to_string(child_ids, '|') AS child_ids, array_to_string(refs, '|') AS entity_refs, time_range, num_events FROM sess", True))
def session_snapshot_summary(spark, sf_dir):
    s = session_rows(spark, sf_dir)
    return s.select("snapshot_id", "scope_id", "summary", "synopsis", *(joined(c).alias(c) for c in ("object_ids", "event_ids", "child_ids", "entity_refs")), "time_range", "num_events")


@query(O.q(f"{O.ACTIONS}, {O.ENTITIES}", "SELECT snapshot_id, scope_id, summary, synopsis, array_to_string(object_ids, '|') AS object_ids, array_to_string(event_ids, '|') AS event_ids, array_to_string(refs, '|') AS entity_refs, time_range FROM enty", True))
def entity_snapshot(spark, sf_dir):
    s = entity_rows(spark, sf_dir)
    return s.select("snapshot_id", "scope_id", "summary", "synopsis", *(joined(c).alias(c) for c in ("object_ids", "event_ids", "entity_refs")), "time_range")


@query(O.q(f"{O.CONV_TURNS}, l AS (SELECT session_id, list(speaker || ': ' || text ORDER BY seq) AS t FROM conv_turns GROUP BY session_id)", f"SELECT session_id, {O.summarize('t', 760)} AS summary FROM l"))
def session_texts(spark, sf_dir):
    t = conversation_turns(spark, sf_dir).withColumn("line", F.concat_ws(": ", "speaker", "text"))
    rows = snapshots._gather(snapshots._top(t, ["session_id"], ["seq"], snapshots.SUMMARY), ["session_id"], ["seq"], "line", "lines")
    return rows.select("session_id", T.summarize_texts("lines", 760).alias("summary"))


@query(O.q(f"{O.SESSIONS}, {O.ENTITIES}, {O.ROOT}", "SELECT snapshot_id, synopsis, summary, array_to_string(event_ids, '|') AS event_ids, array_to_string(child_ids, '|') AS child_ids, array_to_string(refs, '|') AS entity_refs, time_range, num_events, num_sessions, num_entities FROM root", True))
def root_snapshot(spark, sf_dir):
    r = snapshots.root_snapshot(ev(spark, sf_dir), session_rows(spark, sf_dir), entity_rows(spark, sf_dir), "ev")
    return r.select("snapshot_id", "synopsis", "summary", *(joined(c).alias(c) for c in ("event_ids", "child_ids", "entity_refs")), "time_range", "num_events", "num_sessions", "num_entities")


# ---------------------------------------------------------------- vectors and search


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"SELECT a.vec_id AS qid, b.vec_id, round({_COS}, 4) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10")
def cosine_topk_batch(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return search.top_similar(e, q, 10).select("qid", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i), v AS (SELECT label, list(m ORDER BY i) AS embedding FROM c GROUP BY label) SELECT a.label AS a, b.label AS b, round(" + _COS + ", 4) AS similarity FROM v a JOIN v b ON a.label < b.label")
def label_centroid_sim(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    c = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v"))
    b = c.toDF("b", "w")
    return c.toDF("a", "v").join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine("v", "w"), 4).alias("similarity"))


_QUESTIONS = [("q1", "Where does User12 live?"), ("q2", "How many cities did User3 visit for stress relief in January 2024?"), ("q3", "Which job failed with Code2?")]


def _questions(spark):
    return spark.createDataFrame(_QUESTIONS, "qid string, question string")


def mock_embedding(c):
    """A stand-in for an embedding model: counts of a few words, and the number of words."""
    low = F.lower(F.coalesce(T.as_column(c), F.lit("")))
    counts = [(F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in O.MOCK_WORDS]
    return F.array(*counts, F.size(T.tokens(T.collapse(low))).cast("double"))


def _searched(spark, sf_dir):
    """Analysed questions, their top snapshots, and the events ready for search."""
    q = search.analyse(_questions(spark), mock_embedding)
    top = _shared(spark, sf_dir, "top", lambda: search.rank_snapshots(searchable_pages(spark, sf_dir), q))
    return q, top, searchable(spark, sf_dir)


def searchable(spark, sf_dir):
    return _shared(spark, sf_dir, "searchable", lambda: search.searchable_events(ev(spark, sf_dir), mock_embedding))


def searchable_pages(spark, sf_dir):
    def build():
        s = session_rows(spark, sf_dir).drop("num_events", "num_objects").unionByName(entity_rows(spark, sf_dir).drop("num_events", "num_objects"))
        return search.searchable_snapshots(s, mock_embedding)

    return _shared(spark, sf_dir, "pages", build)


SHARED |= {"searchable": searchable, "pages": searchable_pages}


@query(O.q(f"{O.SESSIONS}, {O.ENTITIES}, {O.questions(_QUESTIONS)}, {O.TOP6}", "SELECT qid, snapshot_id, scope_id, score, rank FROM top6", True))
def snapshot_top6(spark, sf_dir):
    return _searched(spark, sf_dir)[1].select("qid", "snapshot_id", "scope_id", "score", F.col("rank").cast("long").alias("rank"))


@query(O.q(f"{O.SESSIONS}, {O.ENTITIES}, {O.questions(_QUESTIONS)}, {O.TOP6}, {O.RANKED}", "SELECT qid, event_id, day, score, rank FROM spans", True))
def hybrid_event_rank(spark, sf_dir):
    q, top, events = _searched(spark, sf_dir)
    _, o, _, l = state(spark, sf_dir)
    ranked = search.rank_events(events, q, search.select_events(top, snapshots.entity_events(ev(spark, sf_dir), l, o)))
    return search.evidence_spans(ranked).select("qid", "event_id", "day", "score", F.col("rank").cast("long").alias("rank"))


@query(O.q(f"{O.SESSIONS}, {O.ENTITIES}, {O.questions(_QUESTIONS)}, {O.TOP6}, listed AS (SELECT qid, rank, unnest(event_ids) AS id, generate_subscripts(event_ids, 1) AS pos FROM top6), firsts AS (SELECT qid, id, min(rank * 1000 + pos) AS place FROM listed GROUP BY ALL)", "SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY place) AS position FROM firsts", True))
def ordered_union_ids(spark, sf_dir):
    return search.ordered_ids(_searched(spark, sf_dir)[1], "event_ids")


@query(O.q(O.answer_lines("text", 160), "SELECT session_id, line, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, seq) AS position FROM first_of WHERE nth = 1 QUALIFY position <= CASE WHEN inference THEN 8 ELSE 6 END"))
def answer_lines(spark, sf_dir):
    t = conversation_turns(spark, sf_dir).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("lines"))
    t = t.withColumn("question", F.get("lines", F.lit(0)))
    view = A.answer_view("question", F.array().cast("array<struct<title:string,synopsis:string,summary:string>>"), F.col("lines"), F.array().cast("array<struct<timestamp:string,speaker:string,text:string>>"))
    return t.select("session_id", F.posexplode(view["facts"]).alias("at", "line")).select("session_id", "line", (F.col("at") + 1).cast("long").alias("position"))


@query(O.q(O.ACTIONS, "SELECT 'session' AS kind, session_id AS name FROM events_x UNION SELECT 'subject', subject FROM acts", True))
def touched_scopes(spark, sf_dir):
    return evaluate.touched(ev(spark, sf_dir), acts(spark, sf_dir))


@query("WITH r AS (SELECT user_id AS sample, event_type AS metric, count(*) AS value FROM events GROUP BY ALL) SELECT metric, sum(value)::BIGINT AS total, round(avg(value), 2) AS average, count(*) AS samples FROM r GROUP BY metric")
def ingest_totals(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    return evaluate.report_totals(e)


# ---------------------------------------------------------------- edges


@query(O.q(O.EVENTS, f"SELECT {O.stable_id('edge', 'raw_span_id', 'speaker', 'dst', repr('mentions'))} AS edge_id, speaker AS src, dst, 0.5::DOUBLE AS confidence FROM (SELECT raw_span_id, speaker, unnest(canon_refs) AS dst FROM events_x)"))
def mention_edges(spark, sf_dir):
    e = ev(spark, sf_dir)
    return edges.graph_edges(e, atom_rows(spark, sf_dir)).where("relation = 'mentions'").select("edge_id", "src", "dst", "confidence")


@query(O.q(O.EDGES, "SELECT edge_id, src, relation, dst, confidence FROM edges WHERE relation IN ('co_occurs_with', 'contradicts', 'supports')"))
def cooccurrence_edges(spark, sf_dir):
    e = ev(spark, sf_dir)
    return edges.graph_edges(e, atom_rows(spark, sf_dir)).where("relation in ('co_occurs_with', 'contradicts', 'supports')").select("edge_id", "src", "relation", "dst", "confidence")


# ---------------------------------------------------------------- evaluation


_TOK = "list_filter(string_split(trim(regexp_replace(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\s+', ' ', 'g')), ' '), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))"
_PAIRS = f"p AS (SELECT b.item_id, {_TOK.format('b.text')} AS g, {_TOK.format('c.text')} AS p FROM benchmark b JOIN conversations c ON c.conv_id = b.item_id AND c.turn = 0), o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(g, lambda x: x = t)), len(list_filter(p, lambda x: x = t))))), 0)::DOUBLE AS o FROM p)"


@query(f"WITH {_PAIRS} SELECT item_id, CASE WHEN g = p THEN 1.0 ELSE 0.0 END::DOUBLE AS em, round(CASE WHEN o = 0 THEN 0 ELSE 2 * (o / len(p)) * (o / len(g)) / (o / len(p) + o / len(g)) END, 6)::DOUBLE AS f1, round(CASE WHEN len(p) = 0 THEN 0 ELSE o / len(p) * CASE WHEN len(p) > len(g) THEN 1 ELSE exp(1 - len(g)::DOUBLE / greatest(1, len(p))) END END, 6)::DOUBLE AS bleu1 FROM o")
def answer_metrics(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("item_id"), F.col("text").alias("predicted"))
    s = evaluate.score(read(spark, sf_dir, "benchmark").join(c, "item_id"), "text")
    return s.select("item_id", "em", F.round("f1", 6).alias("f1"), F.round("bleu1", 6).alias("bleu1"))


_EVAL = """r AS (SELECT CAST(event_id % 5 + 1 AS VARCHAR) AS category, event_type = 'error' AS skipped, value AS f1, CASE WHEN event_type = 'view' THEN value END AS judge FROM events)"""
_EVAL_COLS = "count(*) FILTER (WHERE NOT skipped) AS count, count(*) AS total, count(*) FILTER (WHERE skipped) AS skipped_count, round(coalesce(avg(f1) FILTER (WHERE NOT skipped), 0), 2) AS f1, round(avg(judge), 2) AS judge, count(judge) AS judge_count"


@query(f"WITH {_EVAL} SELECT 'category' AS level, category, {_EVAL_COLS} FROM r GROUP BY category UNION ALL SELECT 'non_adversarial', NULL, {_EVAL_COLS} FROM r WHERE category <> '5' UNION ALL SELECT 'overall', NULL, {_EVAL_COLS} FROM r")
def eval_summary_grouping_sets(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    r = e.select((F.col("event_id") % 5 + 1).cast("string").alias("category"), (F.col("event_type") == "error").alias("skipped"), F.col("value").alias("f1"), F.lit(0.0).alias("em"), F.lit(0.0).alias("bleu1"), F.lit(0.0).alias("elapsed_ms"), F.when(F.col("event_type") == "view", F.col("value")).alias("judge"))
    return evaluate.summary(r).select("level", "category", "count", "total", "skipped_count", F.round("f1", 2).alias("f1"), F.round("judge", 2).alias("judge"), "judge_count")


@query("SELECT event_type AS key, round(avg(value), 2) AS mean, count(*) AS n FROM events GROUP BY event_type")
def stage_timing_means(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.create_map("event_type", "value").alias("timings"))
    return evaluate.map_means(e, "timings").select("key", F.round("mean", 2).alias("mean"), "n")


@query("WITH r AS (SELECT user_id % 3 AS run, avg(value) AS m FROM events GROUP BY 1) SELECT round(avg(m), 4) AS judge_mean, round(stddev_pop(m), 4) AS judge_std, count(*) AS runs FROM r")
def judge_mean_std(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("run"), F.col("value").alias("judge"))
    return evaluate.judge_runs(e).select(F.round("judge_mean", 4).alias("judge_mean"), F.round("judge_std", 4).alias("judge_std"), "runs")


@query("SELECT coalesce(toxic, 0) AS toxic, quality, count(*) AS n FROM labels GROUP BY 1, 2")
def category_counts(spark, sf_dir):
    return read(spark, sf_dir, "labels").groupBy(F.coalesce("toxic", F.lit(0)).alias("toxic"), "quality").agg(F.count("*").alias("n"))


from memlake.plans import catalogue_more  # noqa: E402, F401 - registers further queries
