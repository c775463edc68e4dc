"""The store's commits, folded views, layout and stateful ingest, each against the plain batch path."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from memlake.api import MemoryService
from memlake.functions.vectors import batched_embedding
from memlake.operators import extract, reconcile, snapshots
from memlake.sources.manifest import Manifest, Manifests
from memlake.sources.store import StaleTurns, Store
from memlake.sources.turns import event_turns
from memlake.streaming import stateful
from memlake.streaming.stateful import append_stateful


def rows(df, *drop):
    return sorted(map(str, df.select(sorted(set(df.columns) - {"seq", "batch", *drop})).collect()))


@pytest.fixture(scope="module")
def few(spark, sf_dir, tmp_path_factory):
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    path = f"{tmp_path_factory.mktemp('turns')}/t"
    event_turns(spark, sf_dir).orderBy("seq").limit(160).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def whole(spark, few, tmp_path_factory):
    s = Store(spark, f"{tmp_path_factory.mktemp('whole')}/s")
    s.append(few)
    return s


def cuts(turns, n):
    seqs = [r.seq for r in turns.select("seq").orderBy("seq").collect()]
    at = [seqs[len(seqs) * i // n] for i in range(n)] + [seqs[-1] + 1]
    return [turns.where((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(at, at[1:], strict=False)]


@pytest.mark.parametrize("n", [3])
def test_folded_views_equal_a_full_build(spark, few, whole, tmp_path, n):
    """Views read after every batch, so that each is folded forward n - 1 times, against views built over one batch."""
    s = Store(spark, f"{tmp_path}/s")
    for part in cuts(few, n):
        s.append(part)
        s.view("entities"), s.view("sessions")
    for name in ("objects", "versions", "links", "sessions", "entities", "root"):
        assert rows(s.view(name)) == rows(whole.view(name)), name
    m = s.manifests.read()
    assert len(m.tables["versions"]) == n
    # A part holds what its batch changed, not all.
    sizes = [spark.read.parquet(p.path).count() for p in m.tables["objects"]]
    assert s.view("objects").count() <= sum(sizes) and sizes[-1] < s.view("objects").count()
    # Against the plain batch path over the whole log.
    actions = s._ordered(0, m)
    assert rows(reconcile.versions(actions)) == rows(s.view("versions")) and rows(reconcile.objects(actions)) == rows(s.view("objects"))
    made = snapshots.session_snapshots(s.table("events"), reconcile.objects(actions), reconcile.versions(actions), reconcile.evidence_links(s.table("actions")))
    assert rows(made) == rows(s.view("sessions"), "snapshot_terms")
    part = s.root(full_root=False).first()
    assert part.num_sessions <= s.root().first().num_sessions
    got = s.approximate().first()
    exact = s.table("events").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("s"), F.countDistinct("session_id").alias("k")).first()
    assert got.n == exact.n and abs(got.speakers - exact.s) <= 1 and abs(got.sessions - exact.k) <= 1
    assert abs(got.objects - s.view("objects").count()) <= 0.05 * got.objects + 1 and len(got.lengths) == 3


def test_compacted_tables_and_point_reads(spark, few, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    for part in cuts(few, 3):
        s.append(part)
        s.view("versions")
    before = {n: rows(s.view(n)) for n in ("objects", "versions", "links")} | {n: rows(s.table(n)) for n in ("events", "atoms", "actions")}
    assert set(s.compact(least=3, bucket_bytes=20_000)) >= {"events", "actions", "versions", "sketches"}
    assert before == {n: rows(s.view(n)) for n in ("objects", "versions", "links")} | {n: rows(s.table(n)) for n in ("events", "atoms", "actions")}
    session = s.table("events").first().session_id
    read = s.point("events", corpus_id="ev", session_id=session)
    assert rows(read) == rows(s.table("events").where(F.col("session_id") == session)) and read.count() > 0

    def opened(df):
        df.collect()
        return sum(int(m.value()) for m in scans(df._jdf.queryExecution().executedPlan()))

    def scans(plan):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            yield from scans(plan.executedPlan())
            return
        if plan.nodeName().startswith("Scan"):
            yield plan.metrics().get("numFiles").get()
        for i in range(plan.children().size()):
            yield from scans(plan.children().apply(i))

    assert opened(read) < opened(s.table("events").where(F.col("session_id") == session))
    assert s.vacuum() > 0 and rows(s.view("versions")) == before["versions"]
    assert s.append(few.limit(3).withColumn("session_id", F.lit("new"))) and s.view("objects").count() >= len(before["objects"])


def test_two_writers(spark, few, tmp_path):
    """Both see the same version, one is first, the other reconciles again over what the first wrote."""
    parts = cuts(few, 2)
    s = [Store(spark, f"{tmp_path}/s") for _ in range(2)]
    both, put = threading.Barrier(2), Manifests.put
    waited = set()

    def slow(self, m):
        if m.next_commit and threading.get_ident() not in waited and threading.current_thread() is not threading.main_thread():
            waited.add(threading.get_ident())
            both.wait(120)
        return put(self, m)

    Manifests.put = slow
    try:
        threads = [threading.Thread(target=lambda i=i: s[i].append(parts[i], 10 + i)) for i in range(2)]
        [t.start() for t in threads]
        [t.join(300) for t in threads]
    finally:
        Manifests.put = put
    assert s[0].batches() == [10, 11] and s[0].table("events").count() == few.count()
    turns = s[0].table("events").groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct("turn_index").alias("d"), F.max("turn_index").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in turns)
    assert rows(reconcile.versions(s[0]._ordered(0, s[0].manifests.read()))) == rows(s[0].view("versions"))
    assert s[0].view("versions").where("operation = 'ADD'").groupBy("object_id").count().where("count > 1").isEmpty()
    assert not s[1].append(parts[0], 10)
    prepared = s[0].prepare(parts[0])
    s[1].append(parts[0])
    with pytest.raises(StaleTurns):
        s[0].append_prepared(prepared)


def test_manifests(spark, tmp_path):
    m = Manifests(spark, f"{tmp_path}/m")
    assert m.read() == Manifest()
    a = Manifest(version=1, next_commit=1)
    for b in (3, 1, 2, 9):
        a.add_batch(b)
    assert a.batches == [[1, 3], [9, 9]] and a.has(2) and not a.has(4)
    assert m.put(a) and not m.put(a) and m.read() == a


def test_stateful_ingest_equals_batches_and_restarts(spark, few, whole, tmp_path):
    for i, part in enumerate(cuts(few, 3)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # Each run is a restart: it goes on from the checkpoint's state.
        read = spark.readStream.schema(few.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        queries = append_stateful(read, f"{tmp_path}/out", f"{tmp_path}/ck", once=True)
        assert all(q.exception() is None for q in queries), i
    events, actions = spark.read.parquet(f"{tmp_path}/out/events"), spark.read.parquet(f"{tmp_path}/out/actions")
    same = lambda df: df.select("event_id", "turn_index", "session_id")
    assert rows(same(events)) == rows(same(whole.table("events")))
    named = ("object_id", "event_id", "atom_id", "slot", "action", "reason", "version_id", "previous_version_id")
    assert rows(actions.select(*named)) == rows(whole.table("actions").select(*named))
    # The state is keyed: what a micro-batch reads of earlier rows is the state of its own keys.
    plan = str(stateful.reconcile_stream(extract.candidates(extract.atoms(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/out/events"))))._jdf.queryExecution().analyzed())
    assert plan.count("TransformWithState") >= 1 and "Join" not in plan


def test_one_hot_key_of_versions_is_linear(spark):
    """200,000 versions of one object; the frame that looks ahead took minutes for a fifth of that."""
    import time

    n = 200_000
    acts = spark.range(n).selectExpr("'o' object_id", "concat('v', id) version_id", "'c' corpus_id", "concat('e', id) event_id", "'a' atom_id", "if(id % 5 = 0, 'TENTATIVE', 'SUPERSEDE') action", "'x' value", "'x' normalized_value", "'s' subject", "'l' slot", "1.0D confidence", "string(id) valid_from", "cast(null as string) previous_version_id", "'r' reason", "id seq", "0 atom_pos", "0 slot_pos")
    began = time.time()
    got = {r.status: (r.n, r.v) for r in reconcile.versions(acts).groupBy("status").agg(F.count("*").alias("n"), F.count("valid_to").alias("v")).collect()}
    assert got == {"tentative": (n // 5, 0), "superseded": (n * 4 // 5 - 1, n * 4 // 5 - 1), "active": (1, 0)} and time.time() - began < 30


def test_service_over_a_store(spark, whole, tmp_path):
    s = MemoryService(spark, whole.path)
    session = whole.table("events").first().session_id
    turns = [r.turn_index for r in s.events("ev", session).collect()]
    assert turns == sorted(turns) and s.events("ev", session, 2).count() == min(2, len(turns))
    assert s.root("ev").first().num_events == whole.table("events").count() == s.approximate().first().n
    assert s.root("ev", full_root=False).first().num_sessions == whole.view("sessions").count()  # one append made all
    s.write_report(f"{tmp_path}/report")
    assert {r.metric for r in spark.read.json(f"{tmp_path}/report/counters").collect()} >= {"events_written", "action_ADD"}
    assert spark.read.json(f"{tmp_path}/report/touched").where("kind = 'session'").count() == whole.view("sessions").count()
    assert s.compact() == []  # too few parts


def test_numbered_embeddings(spark):
    backwards = batched_embedding(lambda texts: [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))], 3)
    short = batched_embedding(lambda texts: [[1.0]], 3)
    df = spark.createDataFrame([(t,) for t in ("a", "bb", "", "ccc", "dddd")], "t string").coalesce(1)
    got = {r.t: (r.v, r.w) for r in df.select("t", backwards(F.col("t")).alias("v"), short(F.col("t")).alias("w")).collect()}
    assert got == {t: ([float(len(t))], [1.0]) if t else (None, None) for t in ("a", "bb", "", "ccc", "dddd")}
