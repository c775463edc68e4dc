"""The pipeline against a brute-force version on a small table."""

from __future__ import annotations

import hashlib
import re

import pytest

P = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from memlake.llm import langid, secret_scan  # noqa: E402
from tests.llm.test_operators import components, plain_spans, slow_fingerprint  # noqa: E402


def test_pipeline(spark, sf_dir):
    import sentencepiece

    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    kept = [(r.doc_id, r.text) for r in docs if r.text and re.search(r"[^\W\d_]", r.text)]
    fps = [slow_fingerprint(t) for _, t in kept]
    comp = components(len(kept), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    kept = [x for i, x in enumerate(kept) if comp[i] == i]
    kept = [(k, t) for k, t in kept if not any(i in t for i in items)]
    lib, want = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), {}
    for key, text in kept:
        spans = sorted((m.start(), i, m.end(), r.kind) for i, r in enumerate(secret_scan.RULES) for m in [type("M", (), {"start": lambda s, a=a: a, "end": lambda s, b=b: b})() for a, b in r.spans(text, text.lower())])
        out, at = "", 0
        for lo, _, hi, kind in spans:
            out += text[at : max(at, lo)] + (f"[{kind}]" if lo >= at else "")
            at = max(at, hi)
        ids = lib.encode(out + text[at:])
        want[key] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        assert plain_spans(text)[0] == [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
    assert got == want


def test_pipeline_odd_rows(spark, tmp_path, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, blob string"
    rows = [(1, None, "en", "s", 0, "b"), (2, "", None, "s", 0, "b"), (3, "12345 !!", "en", None, None, "b"), (4, "The same words stand here twice over", "en", "s", 36, "b"), (4, "The same words stand here twice over", "en", "s", 36, "b"), (None, "A line without any id at all", "en", "s", 1, "b"), (5, 'The password = "abcdefgh12345" is here', "en", "s", 3, "b")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")]
    left = {(r.doc_id, r.text, r.n_chars) for r in docs.collect()}
    assert [(t, n) for k, t, n in left if k == 5] == [('The [assign]" is here', 21)]
    assert {k for k, _, _ in left} == {4, None, 5}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
    assert langid.UNDETERMINED == "und"


def test_rows_of_one_id_and_of_none(spark, tmp_path):
    item = "which river flows past the old mill before it meets the northern sea near the harbour of stone and salt"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c = "a first text about gardens and their walls", "some other words on ships that sail at night", "the third one tells of bread and of ovens"
    rows = [(1, a), (5, a), (5, b), (7, b), (None, c), (None, c), (9, "a row that stands twice"), (9, "a row that stands twice"), (None, b)]
    near = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.keep_one_of_near_copies(spark, near, str(tmp_path)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (5, b), (None, c), (9, "a row that stands twice")], key=str)
    leaks = spark.createDataFrame([(None, f"{a} {item} {b}"), (None, a), (3, f"{b} {item}"), (3, c), (4, None)], "doc_id long, text string")
    kept = corpus_pipeline.drop_benchmark_leaks(spark, leaks, str(tmp_path)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, a), (3, c), (4, None)], key=str)
