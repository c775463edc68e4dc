"""Joins in time, event-time windows with late rows, lineage, neighbourhoods, sketches and pruned ranking, against plain statements."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from memlake.functions import temporal
from memlake.operators import extract, lineage, retrieval, search, sketches, snapshots, temporal_joins, time_windows
from memlake.plans import catalogue
from memlake.plans.catalogue_more import sketched_users

START = datetime(2024, 1, 1)


def moments(n, seed, days=30):
    r = random.Random(seed)
    return [(i, r.choice(["hot"] * 6 + ["a", "b", "c", None]), START + timedelta(seconds=r.randrange(days * 86400)) if r.random() > 0.05 else None, r.randrange(100)) for i in range(n)]


def test_as_of(spark):
    left, right = moments(400, 1), moments(300, 2)
    right += [(1000 + i, "hot", right[5][2] or START, i) for i in range(5)] + [(2000, "a", START - timedelta(days=400), None)]
    l = spark.createDataFrame([(i, k, t, "x") for i, k, t, _ in left], "id long, k string, t timestamp, note string").repartition(3)
    r = spark.createDataFrame(right, "rid long, k string, t timestamp, v long").repartition(3)
    got = {x.id: (x.rid, x.v) for x in temporal_joins.as_of(l, r, ["k"], "t", ["rid", "v"], "rid").collect()}
    want = {}
    for i, k, t, _ in left:
        held = [x for x in right if k is not None and t is not None and x[1] == k and x[2] is not None and x[2] <= t]
        best = max(held, key=lambda x: (x[2], x[0]), default=None)
        want[i] = (best[0], best[3]) if best else (None, None)
    assert got == want
    assert temporal_joins.as_of(l.where("false"), r, ["k"], "t", ["rid"], "rid").count() == 0
    assert {x.rid for x in temporal_joins.as_of(l, r.where("false"), ["k"], "t", ["rid"], "rid").collect()} == {None}


@pytest.mark.parametrize("unit", [60_000_000, 1_000_000, 86_400_000_000])
def test_interval_join(spark, unit):
    """Overlapping, empty, reversed, open, tiny and very long intervals."""
    r = random.Random(3)
    points = moments(300, 4)
    spans = []
    for i in range(200):
        a = START + timedelta(seconds=r.randrange(-86400, 30 * 86400), microseconds=r.randrange(10**6))
        size = r.choice([0, -5, 1, 61, 4000, 90_000, 10**6, 10**8, None])
        spans.append((i, r.choice(["hot", "a", "b"]), a if i % 29 else None, a + timedelta(seconds=size) if size is not None else None))
    p = spark.createDataFrame([(i, k, t) for i, k, t, _ in points], "id long, k string, t timestamp")
    s = spark.createDataFrame(spans, "sid long, k string, a timestamp, b timestamp")
    met = temporal_joins.interval_join(p, s, ["k"], "t", "a", "b", unit_micros=unit)
    got = sorted((x.id, x.sid) for x in met.collect())
    want = sorted((i, sid) for i, k, t, _ in points for sid, q, a, b in spans if k == q and t and a and a <= t and (b is None or t < b))
    assert got == want and len(want) > 300
    assert "NestedLoop" not in met._jdf.queryExecution().toString() and "Cartesian" not in met._jdf.queryExecution().toString()
    assert temporal_joins.interval_join(p.where("false"), s, ["k"], "t", "a", "b").count() == 0


def test_late_rows_of_a_stream(spark, tmp_path):
    """A row within the watermark counts, one beyond it is dropped, and windows come out once they are closed."""
    at = lambda m: START + timedelta(minutes=m)
    batches = [[(1, at(1)), (1, at(4)), (2, at(7))], [(1, at(31))], [(1, at(24)), (2, at(2))], [(1, at(90))]]
    schema = "k int, ts timestamp"
    rows = []
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        read = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = time_windows.tumbling(read, "ts", "10 minutes", ["k"], F.count("*").alias("n"), late="10 minutes")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        rows.append(i)
    got = sorted((r.k, int((r.window_start - START).total_seconds() // 60), r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # The second batch closes windows up to minute 21: (2, at(2)) comes too late, (1, at(24)) doesn't.
    assert got == [(1, 0, 2), (1, 20, 1), (1, 30, 1), (2, 0, 1)]
    table = spark.createDataFrame([x for b in batches for x in b], schema)
    held = {(r.k, int((r.window_start - START).total_seconds() // 60)): r.n for r in time_windows.tumbling(table, "ts", "10 minutes", ["k"], F.count("*").alias("n")).collect()}
    assert held[2, 0] == 2 and held[1, 90] == 1
    gone = time_windows.sessions(table, "ts", "5 minutes", ["k"], F.count("*").alias("n")).collect()
    assert sorted((r.k, r.n) for r in gone) == [(1, 1), (1, 1), (1, 1), (1, 2), (2, 2)]


def test_chains(spark):
    r = random.Random(5)
    parent = {f"v{i}": f"v{i - 1}" if i % 700 else None for i in range(2000)} | {"x": "gone", "y": "x", None: "y"}
    parent |= {f"t{i}": f"t{r.randrange(i)}" if i else None for i in range(300)}
    df = spark.createDataFrame(list(parent.items()) + [("y", "x")], "k string, p string")
    got = {x.k: (x.root, x.depth) for x in lineage.chains(df, "k", "p").collect()}

    def walk(k):
        n = 0
        while parent.get(k) in parent and parent[k] is not None:
            k, n = parent[k], n + 1
        return k, n

    assert got == {k: walk(k) for k in parent if k is not None}
    with pytest.raises(ValueError):
        lineage.chains(spark.createDataFrame([("a", "b"), ("b", "a")], "k string, p string"), "k", "p")
    assert lineage.chains(df.where("false"), "k", "p").count() == 0


def test_neighbours(spark):
    r = random.Random(6)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(70)] + [(None, 3), (4, None), (5, 5)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    seeds = spark.createDataFrame([(1,), (2,), (None,), (999,)], "node long")
    near = {}
    for a, b in pairs:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want, edge = {1: 0, 2: 0, 999: 0}, {1, 2, 999}
    for h in range(1, 4):
        edge = {y for x in edge for y in near.get(x, ()) if y not in want}
        want |= dict.fromkeys(edge, h)
    assert {x.node: x.hops for x in lineage.neighbours(e, seeds, 3).collect()} == want


def test_sketches_are_close(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    exact = {x.event_type: x for x in e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.expr("percentile(floor(value), array(0.1, 0.5, 0.9))").alias("q"), F.expr("collect_list(floor(value))").alias("all")).collect()}
    for x in sketched_users(spark, sf_dir).collect():
        true = exact[x.event_type]
        assert x.n == true.n and abs(x.users - true.users) <= 0.05 * true.users + 1
        for q, v in zip((0.1, 0.5, 0.9), x["values"], strict=True):
            assert sum(a < v for a in true.all) / x.n <= q + 0.03 and sum(a <= v for a in true.all) / x.n >= q - 0.03
    many = spark.range(200_000).select(F.lit("c").alias("k"), F.col("id"), (F.col("id") % 8).alias("part"))
    parts = sketches.of_rows(many, ["k", "part"], {"ids": "id"}, {"at": "id"})
    got = sketches.merged(parts, ["k"], ["ids"], ["at"]).first()
    assert abs(got.ids - 200_000) <= 0.05 * 200_000 and all(abs(v / 200_000 - q) <= 0.03 for q, v in zip((0.1, 0.5, 0.9), got["at"], strict=True))


def test_pruned_ranking_scores_little(spark, sf_dir):
    """The same spans as scoring everything, from a part of the events; also with far more questions and other vectors."""
    q, top, events = catalogue._searched(spark, sf_dir)
    e, o, _, l = catalogue.state(spark, sf_dir)
    chosen = search.select_events(top, snapshots.entity_events(e, l, o))
    asked = [(f"s{i}", t) for i, t in enumerate(["Where does User3 live?", "What happened on 5 January 2024?", "Brand2", "", "zzz qqq", "How many jobs failed in January?", "Did User7 prefer Brand4 on 3 January 2024?"])]
    more = search.analyse(spark.createDataFrame(asked, "qid string, question string"), catalogue.mock_embedding)
    for questions, selected in ((q, chosen), (more, None)):
        index = retrieval.index_events(events, 8)
        spans, share = retrieval.ranked_spans(index, questions, selected)
        cols = ("qid", "rank", "event_id", "score", "day")
        want = search.evidence_spans(search.rank_events(events, questions, selected))
        assert sorted(map(tuple, spans.select(*cols).collect()), key=str) == sorted(map(tuple, want.select(*cols).collect()), key=str)
        shares = {r.qid: r.scored / r.events for r in share.collect()}
        assert all(s <= 1 for s in shares.values())


def test_pruned_ranking_shuffles_little(spark, sf_dir, monkeypatch):
    """Neither postings nor scored events are shuffled to meet the questions, scored rows carry only what ranks them, and spans still have all columns; a direction is one pivot."""
    q, _, events = catalogue._searched(spark, sf_dir)
    index = retrieval.index_events(events)
    assert len({tuple(p) for p in index.pivots}) == len(index.pivots)
    plans, columns, keep = {}, {}, retrieval.written

    def written(df, tag):
        plans[tag], columns[tag] = df._jdf.queryExecution().sparkPlan().toString(), df.columns
        return keep(df, tag)

    monkeypatch.setattr(retrieval, "written", written)
    spans, _ = retrieval.ranked_spans(index, q)
    assert "BroadcastHashJoin [term" in plans["listed"] and "BroadcastHashJoin [qid" in plans["first"]
    assert not {"text", "surface", "line_refs"} & set(columns["first"])
    assert set(spans.columns) == set(search.evidence_spans(search.rank_events(events, q)).columns)


def test_chains_write_only_what_moved(spark, monkeypatch):
    """One long chain among many rows without one: a round doesn't write those again."""
    rows = spark.createDataFrame([(f"s{i}", None) for i in range(300)] + [(f"c{i}", f"c{i - 1}" if i else None) for i in range(40)], "v string, p string")
    sizes, keep = [], lineage.written

    def written(df, tag):
        sizes.append(df.count())
        return keep(df, tag)

    monkeypatch.setattr(lineage, "written", written)
    got = {r.v: (r.root, r.depth) for r in lineage.chains(rows, "v", "p").collect()}
    assert got == {f"s{i}": (f"s{i}", 0) for i in range(300)} | {f"c{i}": ("c0", i) for i in range(40)}
    assert sizes[0] == 340 and all(n < 40 for n in sizes[1:])


def test_a_stamp_is_parsed_once(spark):
    """All fields of a grounding read one parsed stamp, and atoms that aren't kept leave the others as they are."""
    turns = spark.createDataFrame([("c", "s", "Al", "I went yesterday.", "1:56 pm on 8 May, 2023", "{}", 1)], "corpus_id string, session_id string, speaker string, text string, timestamp string, metadata string, seq long")
    g = turns.select(temporal.temporal_grounding("text", "timestamp").alias("g"))
    assert g._jdf.queryExecution().optimizedPlan().toString().count("MMMM d, y") == 1
    assert (g.first().g.anchor_date, g.first().g.grounded_date) == ("2023-05-08", "2023-05-07")
    assert [(a.atom_pos, a.atom_type) for a in extract.atoms(extract.events(turns)).collect()] == [(0, "observation")]
