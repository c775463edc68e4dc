"""Further registered queries: joins in time, event-time windows, lineage, reads in order, and the small functions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import answers as A
from memlake.functions import temporal as TM
from memlake.functions import text as T
from memlake.functions.vectors import batched_embedding
from memlake.operators import edges, lineage, lookups, reconcile, retrieval, search, sketches, snapshots, temporal_joins, time_windows
from memlake.plans import oracle as O
from memlake.plans.catalogue import _QUESTIONS, SHARED, _TOK, _searched, acts, atom_rows, cand, entity_rows, ev, joined, query, read, searchable, session_rows, state
from memlake.sources import scratch
from memlake.sources.turns import conversation_turns

# ---------------------------------------------------------------- joins in time

_LAST = "(SELECT user_id, ts, max(event_id) AS purchase_id, arg_max(value, event_id) AS spent FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)"


@query(f"SELECT v.event_id, p.purchase_id, p.spent FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN {_LAST} p ON v.user_id = p.user_id AND v.ts >= p.ts")
def asof_last_purchase(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("spent"))
    viewed = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return temporal_joins.as_of(viewed, bought, ["user_id"], "ts", ["purchase_id", "spent"], "purchase_id").select("event_id", "purchase_id", "spent")


_AT = "strptime({}, '%-I:%M %p on %-d %B, %Y')"


@query(
    O.q(
        f"{O.ACTIONS}, home AS (SELECT subject, {_AT.format('valid_from')} AS at, arg_max(summary, ord) AS home FROM vers WHERE slot = 'location' AND operation <> 'TENTATIVE' GROUP BY 1, 2), "
        f"moments AS (SELECT event_id, {O.canon('speaker')} AS subject, {_AT.format('timestamp')} AS at FROM events_x)",
        "SELECT m.event_id, m.subject, h.home FROM moments m ASOF LEFT JOIN home h ON m.subject = h.subject AND m.at >= h.at",
        True,
    )
)
def state_at_events(spark, sf_dir):
    """The location that is known of each event's speaker at the event's own time, whatever was learned later."""
    e, _, _, _ = state(spark, sf_dir)
    v = reconcile.versions(acts(spark, sf_dir).where("slot = 'location'")).where("operation != 'TENTATIVE'").join(state(spark, sf_dir)[1].select("object_id", "subject"), "object_id")
    right = v.select("subject", TM.parse_anchor("valid_from").alias("at"), F.col("summary").alias("home"), "seq")
    left = e.select("event_id", T.canonicalize_entity("speaker").alias("subject"), TM.parse_anchor("timestamp").alias("at"))
    return temporal_joins.as_of(left, right, ["subject"], "at", ["home"], "seq").select("event_id", "subject", "home")


@query("WITH i AS (SELECT user_id, event_id AS purchase_id, value, ts AS a, ts + to_hours(floor(value)::BIGINT) AS b FROM events WHERE event_type = 'purchase') SELECT v.event_id, count(*) AS windows, max(purchase_id) AS newest FROM events v JOIN i ON v.user_id = i.user_id AND v.ts >= a AND v.ts < b WHERE v.event_type = 'view' GROUP BY v.event_id")
def interval_purchase_windows(spark, sf_dir):
    """Views that fall in the windows that purchases open, which may overlap: as many hours as the purchase's value."""
    e = read(spark, sf_dir, "events")
    closing = F.timestamp_micros(temporal_joins.micros(F.col("ts")) + F.floor("value").cast("long") * 3_600_000_000)
    opened = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("opens"), closing.alias("closes"))
    viewed = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    met = temporal_joins.interval_join(viewed, opened, ["user_id"], "ts", "opens", "closes")
    return met.groupBy("event_id").agg(F.count("*").alias("windows"), F.max("purchase_id").alias("newest"))


# ---------------------------------------------------------------- pruned ranking


_indexes: dict[tuple, retrieval.EventIndex] = {}


def event_index(spark, sf_dir):
    """The index of the searchable events, made once, and again where its tables are gone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes or not all(scratch.exists(spark, x) for x in _indexes[key].events.inputFiles()[:1]):
        _indexes[key] = retrieval.index_events(searchable(spark, sf_dir))
    return _indexes[key]


SHARED["event_index"] = lambda spark, sf_dir: event_index(spark, sf_dir).events


@query(O.q(f"{O.SESSIONS}, {O.ENTITIES}, {O.questions(_QUESTIONS)}, {O.TOP6}, {O.RANKED}", "SELECT qid, event_id, day, score, rank FROM spans", True))
def pruned_event_rank(spark, sf_dir):
    """hybrid_event_rank without scoring all events for all questions."""
    q, top, _ = _searched(spark, sf_dir)
    e, o, _, l = state(spark, sf_dir)
    chosen = search.select_events(top, snapshots.entity_events(e, l, o))
    spans, _ = retrieval.ranked_spans(event_index(spark, sf_dir), q, chosen)
    return spans.select("qid", "event_id", "day", "score", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- event-time windows

_FLAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _stamped(df):
    return df.withColumns({c: F.date_format(c, _FLAT) for c in ("window_start", "window_end")})


def _sql_stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


@query(f"SELECT event_type, {_sql_stamp('w')} AS window_start, {_sql_stamp('w + INTERVAL 6 HOURS')} AS window_end, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT *, time_bucket(INTERVAL 6 HOURS, ts) AS w FROM events) GROUP BY event_type, w")
def tumbling_windows(spark, sf_dir):
    return _stamped(time_windows.tumbling(read(spark, sf_dir, "events"), "ts", "6 hours", ["event_type"], F.count("*").alias("n"), F.count_distinct("user_id").alias("users")))


@query(f"SELECT event_type, {_sql_stamp('w')} AS window_start, {_sql_stamp('w + INTERVAL 1 HOUR')} AS window_end, count(*) AS n, max(value) AS most FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS w FROM events) GROUP BY event_type, w")
def sliding_windows(spark, sf_dir):
    return _stamped(time_windows.sliding(read(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", ["event_type"], F.count("*").alias("n"), F.max("value").alias("most")))


@query(f"WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, {_sql_stamp('min(ts)')} AS window_start, {_sql_stamp('max(ts) + INTERVAL 12 HOURS')} AS window_end, count(*) AS n FROM g GROUP BY user_id, s")
def session_windows(spark, sf_dir):
    return _stamped(time_windows.sessions(read(spark, sf_dir, "events"), "ts", "12 hours", ["user_id"], F.count("*").alias("n")))


# ---------------------------------------------------------------- lineage and neighbourhoods


@query(O.q(f"{O.ACTIONS}, chain AS (SELECT version_id, version_id AS root, 0 AS depth FROM vers WHERE previous_version_id IS NULL UNION ALL SELECT v.version_id, c.root, c.depth + 1 FROM chain c JOIN (SELECT DISTINCT version_id, previous_version_id FROM vers) v ON v.previous_version_id = c.version_id)", "SELECT DISTINCT version_id, root, depth::BIGINT AS depth FROM chain", True))
def version_lineage(spark, sf_dir):
    """The first version of each version's chain of updates, and how many updates lie between."""
    return lineage.chains(state(spark, sf_dir)[2], "version_id", "previous_version_id")


@query(O.q(f"{O.EVENTS}, e AS (SELECT DISTINCT speaker AS a, dst AS b FROM (SELECT speaker, unnest(canon_refs) AS dst FROM events_x)), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), h0 AS (SELECT 'User1' AS node), h1 AS (SELECT DISTINCT b AS node FROM both_ JOIN h0 ON a = node), h2 AS (SELECT DISTINCT b AS node FROM both_ JOIN h1 ON a = node)", "SELECT node, min(hops)::INTEGER AS hops FROM (SELECT node, 0 AS hops FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node"))
def neighbours_of_speaker(spark, sf_dir):
    """Who and what lies within two mentions of one speaker."""
    e = ev(spark, sf_dir)
    found = edges.graph_edges(e, atom_rows(spark, sf_dir)).where("relation = 'mentions'")
    return lineage.neighbours(found, spark.createDataFrame([("User1",)], "node string"), 2)


@query()
def sketched_users(spark, sf_dir):
    """Distinct users and quantiles of values by event type, merged from sketches of single days."""
    e = read(spark, sf_dir, "events")
    days = sketches.of_rows(e, ["event_type", F.to_date("ts").alias("day")], {"users": "user_id"}, {"values": F.floor("value").cast("long")})
    return sketches.merged(days, ["event_type"], ["users"], ["values"])


# ---------------------------------------------------------------- reads in order


@query(O.q(O.EVENTS, "SELECT session_id, event_id, turn_index, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) AS position FROM events_x QUALIFY position <= 5"))
def session_heads(spark, sf_dir):
    return lookups.first_events(ev(spark, sf_dir), 5).select("session_id", "event_id", "turn_index", F.col("position").cast("long").alias("position"))


@query(O.q(O.ACTIONS, "SELECT subject, slot, object_id, row_number() OVER (PARTITION BY subject ORDER BY slot, object_id) AS position FROM objs", True))
def subject_objects(spark, sf_dir):
    return lookups.placed(state(spark, sf_dir)[1], ["corpus_id", "subject"], ["slot", "object_id"]).select("subject", "slot", "object_id", "position")


@query(O.q(O.ACTIONS, "SELECT object_id, version_id, status, row_number() OVER (PARTITION BY object_id ORDER BY coalesce(valid_from, ''), version_id) AS position FROM vers", True))
def object_versions(spark, sf_dir):
    v = state(spark, sf_dir)[2].withColumn("_from", F.coalesce("valid_from", F.lit("")))
    return lookups.placed(v, ["object_id"], ["_from", "version_id"]).select("object_id", "version_id", "status", "position")


@query(O.q(O.ACTIONS, "SELECT event_id, object_id, link_id, row_number() OVER (PARTITION BY event_id ORDER BY object_id, link_id) AS position FROM links", True))
def event_links(spark, sf_dir):
    return lookups.placed(state(spark, sf_dir)[3], ["event_id"], ["object_id", "link_id"]).select("event_id", "object_id", "link_id", "position")


@query(O.q(O.ATOMS, "SELECT event_id, atom_id, atom_type, row_number() OVER (PARTITION BY event_id ORDER BY atom_id) AS position FROM atoms_x"))
def event_atoms(spark, sf_dir):
    return lookups.placed(atom_rows(spark, sf_dir), ["event_id"], ["atom_id"]).select("event_id", "atom_id", "atom_type", "position")


@query(O.q(f"{O.SESSIONS}, {O.ENTITIES}", "SELECT 'session' AS snapshot_kind, scope_id, snapshot_id FROM sess UNION ALL SELECT 'entity', scope_id, snapshot_id FROM enty", True))
def snapshot_listing(spark, sf_dir):
    return session_rows(spark, sf_dir).select("snapshot_kind", "scope_id", "snapshot_id").union(entity_rows(spark, sf_dir).select("snapshot_kind", "scope_id", "snapshot_id"))


_EXPANDED = """tops AS (SELECT t.qid, t.rank, t.kind, t.scope_id, coalesce(s.object_ids, e.object_ids) AS ids FROM top6 t LEFT JOIN sess s ON t.kind = 'session' AND s.scope_id = t.scope_id LEFT JOIN enty e ON t.kind = 'entity' AND e.scope_id = t.scope_id),
 each_id AS (SELECT qid, rank, unnest(ids) AS object_id, generate_subscripts(ids, 1) AS pos FROM tops), at_id AS (SELECT qid, object_id, min(rank * 1000 + pos) AS place FROM each_id GROUP BY ALL),
 first_ids AS (SELECT qid, object_id, row_number() OVER (PARTITION BY qid ORDER BY place, object_id) AS n FROM at_id QUALIFY n <= 24), have AS (SELECT qid, count(*) AS have FROM first_ids GROUP BY qid),
 scope AS (SELECT qid, scope_id AS subject, min(rank) AS r FROM tops WHERE kind = 'entity' GROUP BY ALL),
 more_ids AS (SELECT s.qid, o.object_id, row_number() OVER (PARTITION BY s.qid ORDER BY r, slot, o.object_id) AS n FROM scope s JOIN objs o USING (subject) WHERE NOT EXISTS (SELECT 1 FROM first_ids f WHERE f.qid = s.qid AND f.object_id = o.object_id) QUALIFY n <= 25),
 every AS (SELECT qid, object_id, 0 AS tier, n FROM first_ids UNION ALL SELECT m.qid, object_id, 1, n FROM more_ids m LEFT JOIN have h USING (qid) WHERE n <= greatest(1, 12 - coalesce(have, 0)))"""


@query(O.q(f"{O.SESSIONS}, {O.ENTITIES}, {O.questions(_QUESTIONS)}, {O.TOP6}, {_EXPANDED}", "SELECT qid, e.object_id, v.summary, row_number() OVER (PARTITION BY qid ORDER BY tier, n) AS position FROM every e JOIN objs o USING (object_id) JOIN vers v ON v.version_id = o.latest_version_id", True))
def expanded_objects(spark, sf_dir):
    _, o, v, _ = state(spark, sf_dir)
    got = search.expand_objects(_searched(spark, sf_dir)[1], o, lookups.latest_versions(o, v))
    return got.select("qid", "object_id", "summary", F.col("position").cast("long").alias("position"))


@query(O.q(O.EVENTS, "SELECT speaker, count(DISTINCT session_id) AS sessions, count(*) AS turns FROM events_x GROUP BY speaker"))
def speaker_sessions(spark, sf_dir):
    return ev(spark, sf_dir).groupBy("speaker").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("turns"))


# ---------------------------------------------------------------- small functions on whole tables


@query(O.q(O.CONV_TURNS, f"SELECT session_id, seq, {O.any_of('lower(text)', ['when', 'date', 'day', 'month', 'year', 'time'])} AS temporal, {O.any_of(chr(39) + ' ' + chr(39) + ' || lower(trim(text)) || ' + chr(39) + ' ' + chr(39), TM.INFERENCE_PATTERNS)} AS inference FROM conv_turns"))
def question_kinds(spark, sf_dir):
    return conversation_turns(spark, sf_dir).select("session_id", "seq", TM.is_temporal_query("text").alias("temporal"), TM.is_inference_query("text").alias("inference"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN strftime(ts - INTERVAL 1 DAY, '%-d %B %Y') WHEN 'view' THEN CAST(year(ts) - 1 AS VARCHAR) WHEN 'signup' THEN 'UNKNOWN' WHEN 'error' THEN 'at noon' ELSE strftime(ts, '%-d %B %Y') END AS answer FROM events")
def temporal_answers(spark, sf_dir):
    """Relative answers replaced by what the span that says so means at its time."""
    kind = F.col("event_type")
    said = F.when(kind == "click", "Done yesterday").when(kind == "view", "It was last year.").otherwise("nothing")
    answer = F.when(kind == "click", "Yesterday").when(kind == "view", "last year").when(kind == "signup", "UNKNOWN").when(kind == "error", "at noon").otherwise("today")
    spans = F.array(F.struct(said.alias("text"), F.date_format("ts", "h:mm a 'on' d MMMM, yyyy").alias("timestamp")))
    return read(spark, sf_dir, "events").select("event_id", TM.canonical_temporal_answer(F.lit("When was it?"), answer, spans).alias("answer"))


_WORDS = f"string_split({O.canon('p_name')}, ' ')"


@query(f"WITH c AS (SELECT p_partkey, {O.norm('p_name')} AS n, {O.canon('p_name')} AS c, list_filter({_WORDS}, lambda x: x <> '') AS w FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_concat([n, c, replace(c, ' ', '')], CASE WHEN len(w) >= 2 THEN [w[-1], w[1] || ' ' || w[2]] ELSE [] END), lambda x: x <> ''))), '|') AS aliases FROM c")
def part_aliases(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", joined(T.aliases("p_name")).alias("aliases"))


_ALIASES = "list_filter(list_concat([{0}n, {0}c, replace({0}c, ' ', '')], CASE WHEN len({0}w) >= 2 THEN [{0}w[-1], {0}w[1] || ' ' || {0}w[2]] ELSE [] END), lambda x: x <> '')"


@query(f"WITH c AS (SELECT p_partkey, {O.norm('p_name')} AS n, {O.canon('p_name')} AS c, list_filter({_WORDS}, lambda x: x <> '') AS w FROM part) SELECT a.p_partkey AS a, round(CASE WHEN a.c = '' OR b.c = '' THEN 0.0 WHEN a.c = b.c THEN 1.0 WHEN list_contains({_ALIASES.format('b.')}, a.c) OR list_contains({_ALIASES.format('a.')}, b.c) THEN 0.85 ELSE len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(list_distinct(a.w)), len(list_distinct(b.w))) END, 6) AS overlap FROM c a JOIN c b ON a.p_partkey + 1 = b.p_partkey")
def entity_overlaps(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    a, b = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")), p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return a.join(b, F.col("a") + 1 == F.col("b")).select("a", F.round(T.entity_overlap("x", "y"), 6).alias("overlap"))


@query("WITH s AS (SELECT conv_id, turn, unnest([coalesce(role, ''), 'D' || turn // 2, 'D' || turn // 2]) AS id, unnest([0, 1, 2]) AS k FROM conversations), f AS (SELECT conv_id, id, min(turn * 10 + k) AS place FROM s WHERE trim(id) <> '' GROUP BY ALL) SELECT conv_id, string_agg(id, '|' ORDER BY place) AS ids FROM f GROUP BY conv_id")
def dialogue_ids(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    listed = F.concat(F.lit("D"), F.expr("turn div 2"))
    spans = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("role").alias("dia_id"), F.array(listed, listed).alias("dia_ids")).alias("s")))), lambda x: x["s"])
    return c.groupBy("conv_id").agg(joined(A.dia_ids(spans)).alias("ids"))


@query("SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'multi_hop' WHEN 2 THEN 'temporal' WHEN 3 THEN 'open_domain' WHEN 4 THEN 'single_hop' WHEN 5 THEN 'adversarial' ELSE '0' END AS label, event_id % 6 IN (1, 2, 3, 4) AS scored FROM events")
def category_labels(spark, sf_dir):
    code = (F.col("event_id") % 6).cast("string")
    return read(spark, sf_dir, "events").select("event_id", A.category_label(code).alias("label"), code.isin(*A.NON_ADVERSARIAL).alias("scored"))


@query(O.q(O.CONV_TURNS, f"SELECT session_id, seq, array_to_string({_TOK.format('text')}, ' ') IN {O._in(A.ABSTENTIONS)} AS abstains FROM conv_turns"))
def abstentions(spark, sf_dir):
    return conversation_turns(spark, sf_dir).select("session_id", "seq", A.is_abstention("text").alias("abstains"))


@query(O.q(O.CONV_TURNS, "SELECT session_id, seq, CAST(length(text) AS DOUBLE) AS length FROM conv_turns"))
def batched_embeddings(spark, sf_dir):
    """A model that is asked for many texts at once; a stand-in gives their lengths."""
    embed = batched_embedding(lambda texts: [[float(len(t))] for t in texts], 32)
    return conversation_turns(spark, sf_dir).withColumn("v", embed(F.col("text"))).select("session_id", "seq", F.col("v")[0].alias("length"))


@query(O.q(O.ACTIONS, "SELECT version_id AS atom_id, event_id AS span_id, slot AS atom_type, summary AS content, status FROM vers JOIN (SELECT latest_version_id FROM objs) ON version_id = latest_version_id", True))
def state_atoms(spark, sf_dir):
    _, o, v, _ = state(spark, sf_dir)
    rows = lookups.latest_versions(o, v).withColumns({"qid": F.lit("all"), "position": F.lit(1)})
    return search.state_atoms(rows).select("atom_id", "span_id", "atom_type", "content", "status")


@query(O.q(O.CANDIDATES, "SELECT object_id, count(*) AS candidates, count(DISTINCT nv) AS values FROM cand GROUP BY object_id"))
def candidates_by_object(spark, sf_dir):
    return cand(spark, sf_dir).groupBy("object_id").agg(F.count("*").alias("candidates"), F.count_distinct("normalized_value").alias("values"))
