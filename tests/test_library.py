"""The library's queries against their SQL, hand-traced cases, batch splits, replays and streams."""

from __future__ import annotations

import json
import math
import random
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.api import MemoryService
from memlake.cli import build_parser
from memlake.functions import answers as A
from memlake.functions import temporal as TM
from memlake.functions import text as T
from memlake.functions import vectors
from memlake.functions.vectors import batched_embedding
from memlake.operators import extract, reconcile, search, snapshots
from memlake.plans import catalogue
from memlake.sources.store import Store
from memlake.sources.turns import dialogue_questions, dialogue_turns, event_turns, normalize_json_turns, payload_turns, read_samples
from memlake.streaming.append import append_stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    table = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in table.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(plain(v) for v in r) for r in table.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in got.select(*names).collect()), key=repr) == want


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, T.canonicalize_entity("t"), t="  The_Big (old) Café of   Paris! ") == "big caf paris"
    assert one(spark, T.extract_entities("t"), t='Alice Smith met Bob; "red door" near the harbor harbor. What?') == ["red door", "alice smith", "bob", "harbor"]
    assert one(spark, T.semantic_references("t"), t="we love kung fu and dancing to relax") == ["kung fu", "martial arts", "dancing", "stress relief"]
    assert one(spark, T.semantic_references("t"), t="dancing.") == []
    assert one(spark, T.summarize_texts("a", 10), a=["  hello ", "", "wide   world"]) == "hello w..."
    assert one(spark, T.query_terms("t"), t="What roadtrips did we take?") == ["road trip", "roadtrip", "roadtrips", "travel", "trip", "trips"]
    assert one(spark, T.aliases("t"), t="The New York City") == ["city", "new york", "new york city", "newyorkcity", "the new york city"]
    assert one(spark, T.entity_overlap("a", "b"), a="New York City", b="city") == 0.85
    assert one(spark, T.memory_kind(F.lit("goal"), "t"), t="anything") == "plan"


def test_temporal_functions(spark):
    for stamp, want in {"1:56 pm on 8 May, 2023": "2023-05-08 13:56:00", "8 May 2023": "2023-05-08 00:00:00", "May 8, 2023": "2023-05-08 00:00:00", "2025-01-10T10:00:00": None}.items():
        got = one(spark, TM.parse_anchor("t"), t=stamp)
        assert (got and str(got)) == want
    g = one(spark, TM.temporal_grounding("t", "s"), t="we met last month", s="8 January, 2023")
    assert (g.grounded_month, g.precision, g.anchor_date) == ("2022-12", "month", "2023-01-08")
    h = one(spark, TM.temporal_hints("t"), t="What happened on 3rd May 2021, or june?")
    assert (h.year, h.month, h.day) == (2021, 5, 3)
    assert one(spark, TM.is_temporal_query("t"), t="any updates?") is True


def test_answers(spark):
    pairs = [("", "Unknown", 1, 1, 1), ("The cat sat", "a cat sat!", 1, 1, 1), ("red red blue", "red green", 0, 0.4, 0.5 * math.exp(-0.5)), ("x", "", 0, 0, 0)]
    for gold, said, em, f1, bleu in pairs:
        assert one(spark, A.exact_match("g", "p"), g=gold, p=said) == em
        assert one(spark, A.f1("g", "p"), g=gold, p=said) == pytest.approx(f1)
        assert one(spark, A.bleu1("g", "p"), g=gold, p=said) == pytest.approx(bleu)
    assert A.category_codes(["temporal", "4"]) == ["2", "4"]


def turns(spark, rows):
    schema = "corpus_id string, session_id string, speaker string, text string, timestamp string, metadata string, seq long"
    return spark.createDataFrame([("c", s, p, t, d, "{}", i) for i, (s, p, t, d) in enumerate(rows)], schema)


TRACED = [("session-1", "Caroline", "I live in Boston and work at Acme.", "2025-01-01"), ("session-2", "Daniel", "Caroline now lives in Seattle.", "2025-01-02"), ("session-1", "Caroline", "I now live in Seattle and still work at Acme.", "2025-01-03")]


def test_traced_reconciliation(spark):
    c = extract.candidates(extract.atoms(extract.events(turns(spark, TRACED))))
    assert c.count() == 5
    count = lambda a: {r.action: r["count"] for r in a.groupBy("action").count().collect()}
    assert count(reconcile.reconcile(c)) == {"ADD": 2, "SUPERSEDE": 3}
    with_model = reconcile.reconcile(c, model=lambda current, candidate: "NONE")
    assert count(with_model) == {"ADD": 2, "SUPERSEDE": 1, "NONE": 2}
    v = {r.status: r.valid_to for r in reconcile.versions(with_model).where("operation = 'ADD' and value like '%Boston%' and summary like '%location%'").collect()}
    assert v == {"superseded": "2025-01-02"}


def test_fold_forms_agree_and_invariants(spark, sf_dir):
    c = extract.candidates(extract.atoms(extract.events(event_turns(spark, sf_dir)))).persist()
    key = lambda df: sorted((r.object_id, r.seq, r.slot_pos, r.action, r.reason) for r in df.collect())
    assert key(reconcile.reconcile_singleton(c)) == key(reconcile.reconcile_streaming_fold(c))
    # Each case of the decision table, in both forms.
    values = ["red hat", "red hat", "big red hat", "red hat", "blue shoe", "blue shoe now", "red", "", "blue thing shoe x", "a shoe blue red now"]
    rows = [("c", "s", f"e{i}", f"a{i}", "o" if i % 2 else "p", values[i * j % 10], ("active", "uncertain")[i * j % 7 == 3], i, 0, 0, "singleton") for j in (1, 3, 7) for i in range(40)]
    table = spark.createDataFrame([(*r[:7], n, *r[8:]) for n, r in enumerate(rows)], "corpus_id string, session_id string, event_id string, atom_id string, object_id string, normalized_value string, status string, seq long, atom_pos int, slot_pos int, policy string")
    assert key(reconcile.reconcile_singleton(table)) == key(reconcile.reconcile_streaming_fold(table))
    assert {r.reason for r in reconcile.reconcile_singleton(table).select("reason").distinct().collect()} >= {"new_object", "same_normalized_value", "candidate_more_specific", "existing_more_specific", "candidate_not_active", "singleton_slot_low_overlap", "default_supersede"}
    a = reconcile.reconcile(c).persist()
    n = c.count()
    assert a.count() == n == reconcile.evidence_links(a).count()
    o, v = reconcile.objects(a), reconcile.versions(a)
    assert o.join(v, o.latest_version_id == v.version_id).where(v.status == "active").count() == o.count() == c.select("object_id").distinct().count()


def test_array_fold_of_a_long_key(spark, monkeypatch):
    """The same decisions as the streaming fold over runs and blocks of any size, and a long key takes about as long as as many rows of short ones."""
    value = F.element_at(F.split(F.lit("red hat,big red hat,blue shoe,blue shoe now,red,a shoe blue red now,green"), ","), (F.pmod(F.xxhash64("id"), F.lit(7)) + 1).cast("int"))
    columns = (F.concat(F.lit("e"), "id").alias("event_id"), value.alias("normalized_value"), F.when(F.col("id") % 11 == 0, "uncertain").otherwise("active").alias("status"), F.col("id").alias("seq"), F.lit(0).alias("atom_pos"), F.lit(0).alias("slot_pos"), F.lit("singleton").alias("policy"))
    rows = lambda n, keys: spark.range(n).select((F.col("id") % keys).cast("string").alias("object_id"), *columns)
    key = lambda df: sorted((r.object_id, r.seq, r.action, r.reason) for r in df.collect())
    want = key(reconcile.reconcile_streaming_fold(rows(100, 3)))
    for sizes in ((1, 1), (2, 6), (16, 512)):
        monkeypatch.setattr(reconcile, "FOLD", sizes)
        assert key(reconcile.reconcile_singleton(rows(100, 3))) == want
    took = []
    for keys in (2000, 2000, 1):
        began = time.time()
        assert reconcile.reconcile_singleton(rows(20_000, keys)).select("action").distinct().count() > 3
        took.append(time.time() - began)
    assert took[2] < 5 * took[1] + 3


def test_top_similar_is_the_cosine(spark):
    """The first k by cosine() of all pairs, also of odd vectors and ties, without a join that passes every pair."""
    r = random.Random(8)
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 2.0], [nan, 1.0, 2.0, 3.0], [inf, 1.0, 0.0, 0.0], [1e-200] * 4, [1e200] * 4, [1.0, 2.0], [1.0] * 5, [-0.0] * 4, [1e-160, 1e-170, 0.0, 1e-165]]
    plain = [[r.choice([-1.0, 0.5, 2.0, r.random()]) for _ in range(4)] for _ in range(60)]
    v = spark.createDataFrame(list(enumerate([*odd, *plain, *plain[:20], *odd])), "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id % 2 = 0 or vec_id < 12").select(F.concat(F.lit("q"), "vec_id").alias("qid"), "embedding")
    every = v.join(q.select("qid", F.col("embedding").alias("q")), F.lit(True)).select("qid", "vec_id", F.round(vectors.cosine("q", "embedding"), 6).alias("score"))
    for k in (1, 7):
        got = search.top_similar(v, q, k)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        want = every.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
        rows = lambda df: sorted(map(str, df.select("qid", "rank", "vec_id", "score").collect()))
        assert rows(got) == rows(want)


def test_batches_streams_and_replays(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    t = event_turns(spark, sf_dir).orderBy("seq").limit(240).persist()
    bounds = [r.seq for r in t.select("seq").orderBy("seq").collect()]
    whole, split = Store(spark, f"{tmp_path}/whole"), Store(spark, f"{tmp_path}/split")
    whole.append(t)
    assert split.append(t.where(F.col("seq") < bounds[100])) and split.append(t.where(F.col("seq") >= bounds[100]))
    assert not split.append(t, 1)
    rows = lambda df, *drop: sorted(map(str, df.drop("seq", "batch", *drop).collect()))
    for get in (lambda s: s.table("events"), lambda s: s.objects(), lambda s: s.versions(), lambda s: s.links()):
        assert rows(get(whole)) == rows(get(split))
    t.repartition(1).write.parquet(f"{tmp_path}/in")
    streamed = Store(spark, f"{tmp_path}/streamed")
    for _ in range(2):  # the second run finds nothing new
        append_stream(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in"), streamed, f"{tmp_path}/ck", once=True).awaitTermination()
    assert rows(streamed.versions()) == rows(whole.versions())


def test_service(spark, tmp_path):
    payload = {"title": "demo", "turns": [{"session_id": "session-1", "speaker": "Caroline", "text": "I want to visit Oslo for stress relief today."}, {"role": "user", "content": "  My job: I work at Acme. "}, {"text": "  "}, "noise"]}
    (tmp_path / "demo.json").write_text(json.dumps(payload))
    s = MemoryService(spark, f"{tmp_path}/store")
    assert s.append_json("demo", f"file://{tmp_path}/demo.json")
    with pytest.raises(ValueError):
        s.append_turns(None, "other")
    assert [r.corpus_id for r in s.corpora().collect()] == ["demo"]
    e = {r.speaker: r for r in s.store.table("events").collect()}
    assert set(e) == {"Caroline", "user"} and e["user"].text == "My job: I work at Acme."
    assert "Oslo" in s.root("demo").first().summary and s.state("demo", "session-1").count() == 1
    found = s.search("Where does Caroline want to go?", spans=1)
    assert found["raw_spans"].first().speaker == "Caroline" and found["pages"].count() > 0
    assert build_parser().parse_args(["--store", "x", "get-timeline", "caroline"]).entity == "caroline"


def test_sources(spark):
    df = spark.createDataFrame([('{"conversation": [{"text": "a"}, 3], "messages": []}',), ('[{"text": "b"}]',), ('{"x": 1}',)], "p string").select(payload_turns("p").alias("t"))
    assert [r.t and len(r.t) for r in df.collect()] == [1, 1, None]
    item = spark.createDataFrame([('{"speaker": "", "role": "bot", "content": " hi ", "dia_id": "D1"}', 4)], "item string, seq long")
    r = normalize_json_turns(item, "c").first()
    assert (r.session_id, r.speaker, r.text, json.loads(r.metadata)) == ("session-1", "bot", "hi", {"dia_id": "D1"})
    sample = {"session_10": [{"speaker": "A", "text": "late"}], "session_2": [{"speaker": "B", "text": "early", "dia_id": "D2"}], "session_2_date_time": "8 May, 2023"}
    samples = spark.createDataFrame([("My Sample!", json.dumps(sample), json.dumps([{"question": "q", "answer": 7, "category": 2}]))], "sample_id string, conversation string, qa string")
    assert [(r.corpus_id, r.text, r.timestamp) for r in dialogue_turns(samples).orderBy("seq").collect()] == [("my_sample", "early", "8 May, 2023"), ("my_sample", "late", None)]
    assert [(r.qa_id, r.answer) for r in dialogue_questions(samples).collect()] == [("My Sample!-qa-1", "7")]


def test_whole_tables_with_accented_texts(spark, tmp_path):
    texts = ["Élodie Martin visite Zürich; Martin aime le café", "über Über UBER weiß Weise weise weise", "señor mañana mañana \"año nuevo\" Iechä Carolineü", "harbor harbor the the", "niñoword word word wordñ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    kept = [(i, t) for i, t in enumerate(texts) if t]
    counts = [(i, k, n) for i, t in kept for k, n in Counter(re.findall(r"\b[a-zA-Z][a-zA-Z0-9_-]{3,}\b", t.lower())).items() if n >= 2 and k not in T.KEYWORD_STOPWORDS]
    assert {"martin", "weise", "harbor", "word"} == {k for _, k, _ in counts}
    assert sorted((r.doc_id, r.token, r.n) for r in run("keyword_repeats")) == sorted(counts)
    want = {i: "|".join(sorted({w for w in re.sub(r"[^a-z0-9\s]", " ", t.lower()).split() if len(w) > 2})) for i, t in kept}
    assert {r.seq: r.tokens for r in run("query_tokens")} == want
    found = {r.seq: r.entities for r in run("extract_entities")}
    assert found == {i: "|".join(plain_entities(t)) for i, t in kept} and found[2] == "o nuevo"


def plain_entities(text):
    """T.extract_entities in plain Python."""

    def canonical(x):
        x = re.sub(r"\([^)]*\)", " ", x.strip().lower().replace("_", " "))
        return " ".join(w for w in re.sub(r"[^a-z0-9\s-]", " ", x).split() if w not in T.ENTITY_STOPWORDS)

    phrases = re.findall(r"\b(?:[A-Z][a-zA-Z0-9_-]{1,}(?:\s+[A-Z][a-zA-Z0-9_-]{1,}){1,3})\b", text)
    held = {w for p in phrases for w in canonical(p).split()}
    single = [w for w in re.findall(r"\b[A-Z][a-zA-Z0-9_-]{2,}\b", text) if canonical(w) not in held]
    n = Counter(w for w in re.findall(r"\b[a-zA-Z][a-zA-Z0-9_-]{3,}\b", text.lower()) if w not in T.KEYWORD_STOPWORDS)
    every = map(canonical, [*re.findall(r'"([^"]{2,80})"', text), *phrases, *single, *(w for w, c in n.items() if c >= 2)])
    noise = {*T.NOISE_WORDS, *T.KEYWORD_STOPWORDS}
    return list(dict.fromkeys(x for x in every if x and not all(w in noise for w in re.split(r"[^a-z0-9]+", x) if w)))[:8]


def plain_view(question, lines, section, limit, most):
    """Lines of a section in plain Python."""
    cut = lambda x, n: x if len(x := " ".join((x or "").split())) <= n else x[: n - 3].rstrip() + "..."
    tokens = lambda x: {w for w in re.sub(r"[^a-z0-9\s]", " ", x.lower()).split() if len(w) > 2}
    temporal = any(w in question.lower() for w in ("when", "date", "day", "month", "year", "time"))
    inference = any(w in f" {question.lower().strip()} " for w in TM.INFERENCE_PATTERNS)
    scored = []
    for i, line in enumerate(lines):
        if not (line := cut(line, most)):
            continue
        low, held = line.lower(), plain_entities(line)
        score = 1.5 * len(tokens(question) & tokens(line)) + 2.5 * sum(e in held or e in low for e in plain_entities(question))
        if temporal:
            score += 2 * bool(re.search(r"\b(19|20)\d{2}\b", line)) + 1.5 * any(m in low for m in A.MONTH_NAMES) + ("[" in line and "]" in line)
        if inference:
            score += {"facts": 1.5, "page_summaries": 1.0}.get(section, 0) + any(m in low for m in A.INFERENCE_MARKERS)
        scored.append((-score - 0.75 * (section == "raw_evidence"), i, line))
    out = {}
    for _, _, line in sorted(scored):
        out.setdefault(line.lower(), line)
    return list(out.values())[:limit]


def test_answer_view(spark):
    question = "When did Alice Smith visit the harbor, would she like it?"
    pages = [("p", "Alice Smith and the harbor", ""), ("q", "", "a plan to support"), (None, None, None), ("r", "in May 2021 [x]", "no")]
    facts = ["Alice likes boats", "alice   likes BOATS", "", None, "goal: visit the harbor in 2020", *(f"fact {i} of May" for i in range(12)), "x " * 200]
    spans = [("8 May, 2023", "Bob", "Alice Smith was at the harbor"), ("", "Bob", "nothing"), (None, "Eve", " "), ("2020", None, "harbor harbor")]
    df = spark.createDataFrame([(question, pages, facts, spans), ("Who?", [], [], None)], "question string, p array<struct<title:string,synopsis:string,summary:string>>, f array<string>, s array<struct<timestamp:string,speaker:string,text:string>>")
    view = A.answer_view("question", "p", "f", "s")
    full, none = df.select(view.alias("v"), A.render_view("question", view).alias("t")).collect()
    said = [f"{t}: {y or z}" for t, y, z in pages if y or z]
    raw = [f"[{a}] {b}: {c}" if a else f"{b}: {c}" for a, b, c in spans if c.strip()]
    assert full.v.page_summaries == plain_view(question, said, "page_summaries", 4, 180)
    assert full.v.facts == plain_view(question, [f for f in facts if f], "facts", 8, 160)
    assert full.v.raw_evidence == plain_view(question, raw, "raw_evidence", 8, 200)
    lines = full.t.split("\n")
    assert lines[:4] == [f"Question: {question}", "", "Evidence:", "[Direct Evidence]"] and lines[4] == f"- {full.v.raw_evidence[0]}"
    assert [x for x in lines if x.startswith("[")] == ["[Direct Evidence]", "[Facts]", "[Context]"] and not full.t.endswith("\n")
    assert none.t == "Question: Who?\n\nEvidence:\n[Evidence]\n- No relevant evidence."


def test_models_prepared_turns_and_reports(spark, tmp_path):
    embed_many = lambda texts: 1 / 0 if len(texts) > 1 and "bad" in texts else [[float(len(t))] if t != "bad" else 1 / 0 for t in texts]
    embed = batched_embedding(embed_many, 3)
    texts = ["a", None, " ", "bbb", "bad", "cc", "dddd"]
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", embed(F.col("t")).alias("v")).collect()}
    assert got == {"a": [1.0], None: None, " ": None, "bbb": [3.0], "bad": None, "cc": [2.0], "dddd": [4.0]}
    replies = lambda c: F.when(c.contains("Boston"), F.lit('Sure: {broken {"atoms": [{"type": " Goal ", "content": "visit Oslo", "entities": ["Oslo"]}, {"type": "", "content": "x"}, {"type": "observation", "content": "I live in Boston and work at Acme.", "confidence": 0.9}]} done'))
    s = MemoryService(spark, f"{tmp_path}/store", embed=embed, replies=replies)
    s.prepare_turns(turns(spark, TRACED), f"{tmp_path}/prepared")
    assert s.append_prepared(f"{tmp_path}/prepared")
    plain = Store(spark, f"{tmp_path}/plain")
    plain.append(turns(spark, TRACED))
    atoms = {(r.atom_type, r.content, r.confidence) for r in s.store.table("atoms").collect()} - {(r.atom_type, r.content, r.confidence) for r in plain.table("atoms").collect()}
    assert atoms == {("goal", "visit Oslo", 0.6), ("observation", "I live in Boston and work at Acme.", 0.9)}
    assert {len(r.embedding) for r in s.store.table("events").collect()} == {1} and s.store.snapshots().where("embedding is null").count() == 0
    counters, touched = plain.report()
    assert {r.metric: r.value for r in counters.collect()} == {"events_written": 3, "atoms_written": 3, "state_candidates": 5, "objects_written": 5, "evidence_links": 5, "action_ADD": 2, "action_SUPERSEDE": 3}
    assert {(r.kind, r["name"]) for r in touched.collect()} == {("session", "session-1"), ("session", "session-2"), ("subject", "caroline")}
    v = s.answer_views("Where does Caroline live?").first()
    assert v.text.startswith("Question: Where does Caroline live?") and any("Seattle" in x for x in v.view.raw_evidence)
    assert {"page_id", "level", "child_ids"} <= set(s.search("Where does Caroline live?")["pages"].columns)


def test_small_functions(spark, tmp_path):
    pairs = [("New York City", "city of new york"), ("Acme", "Acme"), ("abc", "abd"), ("", "x"), ("harbour front", "harbor front"), (None, "a")]
    got = [r.s for r in spark.createDataFrame(pairs, "a string, b string").select(T.fuzzy_similarity()("a", "b").alias("s")).collect()]
    assert got[1:4] == [1.0, 0.0, 0.0] and got[5] == 0.0 and got[0] == 1.0 and 0.9 < got[4] < 1
    for text, want in {"no": None, 'x {"a": {"b": 1}} y': '{"a": {"b": 1}}', "{1} {}": "{}", "{bad": None}.items():
        assert one(spark, T.first_json_object("t"), t=text) == want
    (tmp_path / "s.json").write_text(json.dumps([{"sample_id": "a b", "conversation": {"session_1": [{"speaker": "A", "text": "hi"}]}, "qa": []}, 3]))
    assert [r.corpus_id for r in dialogue_turns(read_samples(spark, f"file://{tmp_path}/s.json")).collect()] == ["a_b"]
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="no list of samples"):
        read_samples(spark, f"file://{tmp_path}/bad.json").collect()


def test_snapshot_references_cover_all_texts(spark):
    rows = [("s", "A", "nothing here", None)] * 800 + [("s", "A", "We met Zed Quill.", None)]
    e = extract.events(turns(spark, rows))
    a = reconcile.reconcile(extract.candidates(extract.atoms(e)))
    got = snapshots.session_snapshots(e, reconcile.objects(a), reconcile.versions(a), reconcile.evidence_links(a)).first()
    assert "zed quill" in got.entity_refs and got.num_events == 801


def test_one_long_key(spark):
    values = ["red hat", "blue shoe", "red hat tall"]
    c = spark.range(100_000).selectExpr("'c' corpus_id", "'s' session_id", "concat('e', id) event_id", "'a' atom_id", "'o' object_id", f"element_at(array({', '.join(map(repr, values))}), cast(id % 3 as int) + 1) normalized_value", "'active' status", "id seq", "0 atom_pos", "0 slot_pos", "'singleton' policy")
    got = {r.action: r["count"] for r in reconcile.reconcile_streaming_fold(c).groupBy("action").count().collect()}
    assert got == {"ADD": 1, "NONE": 33_333, "SUPERSEDE": 66_666}  # the shorter value after the longer one adds nothing
