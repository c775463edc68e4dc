"""Ranked search, toxicity and the Merkle manifest against plain statements of their results, on odd rows too."""

from __future__ import annotations

import hashlib
import math
import re
import weakref
import zlib
from collections import Counter

import numpy as np
import pytest

from memlake.llm import lexical, merkle, toxicity
from tests.llm.test_operators import TEXTS, odd  # noqa: F401

# ---------------------------------------------------------------- 11

TERM = re.compile(lexical.PATTERN)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    """Rows (item, rank, doc, score) by scoring every document for every item."""
    counts = [(key, Counter(plain_terms(t))) for key, t in docs]
    length = [sum(c.values()) for _, c in counts]
    big_n, big_l = sum(n > 0 for n in length), sum(length)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in set(items):
        scored = []
        for (key, c), n in zip(counts, length, strict=True):
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * (25 + 75 * n * big_n // big_l))) for w in plain_terms(text) if w in c)
            if s > 0:
                scored.append((-s, key is None, key or 0, key))
        out += [(item, r, key, -s) for r, (s, _, _, key) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_terms():
    for t in [*TEXTS, "Ab1-cD_e f\x7fg\x80h É", "".join(map(chr, range(300)))]:
        assert [w.decode() for w in lexical.terms((t or "").encode())] == plain_terms(t)


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 999_999, 2**31 - 1] + list(range(0, 300_000, 977)))
    data, at = lexical.varints(values)
    assert lexical.unpack(data.tobytes()).tolist() == values.tolist() and lexical.unpack(data[at[2] : at[5]].tobytes()).tolist() == values[2:5].tolist()


def test_search_of_odd_rows(spark, odd):  # noqa: F811
    items = [(1, "hello world one two"), (1, "same text twice twice"), (2, None), (3, "--- "), (4, "word1 word2 token7 token19999 x"), (4, "word1 word2 token7 token19999 x"), (None, "naïve äpfel Äpfel trail"), (6, "nothing of this")]
    questions = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, term string, shard int")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = plain_search(docs, items)
    assert found(lexical.search(lexical.build(odd), questions)) == want and len(want) > 10
    assert found(lexical.search(lexical.build(odd), questions, k=2)) == plain_search(docs, items, 2)
    assert lexical.search(lexical.build(odd), questions.where("false")).count() == 0
    assert lexical.search(lexical.build(odd.where("false")), questions).count() == 0


@pytest.mark.parametrize("shard_rows", [7, 400])
def test_search_against_all_documents(spark, monkeypatch, shard_rows):
    """Words of all frequencies, equal documents, several shards a task, groups of questions."""
    rng = np.random.default_rng(31)
    words = [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    draw = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    docs = [(int(i), draw(int(rng.integers(1, 120)))) for i in rng.permutation(900)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]
    items = [(i, draw(int(rng.integers(1, 30)))) for i in range(30)] + [(99, docs[3][1])]
    monkeypatch.setattr(lexical, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(lexical, "GROUP", 8)
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert index.rows.where("term is null").count() >= 3 and (shard_rows > 7 or index.rows.where("term is null").count() > 100)
    assert found(lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))) == plain_search(docs, items)


def test_blocks_stay_packed():
    """Blocks below the threshold aren't unpacked: a rare word decides, and only the common word's blocks around it are opened."""
    n = 5000
    made = lexical.Builder(n, 3 * n)
    for i in range(n):
        made.add(i, b"the the the" if i % 700 else b"rare rare the")
    import pyarrow as pa

    a = pa.list_(pa.int32())
    rows = made.batch(0, pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("firsts", a), ("ends", a), ("maxima", a), ("starts", a), ("postings", pa.binary()), ("documents", pa.list_(pa.int64()))])).to_pylist()[1:]
    lists = {r["term"]: lexical.Postings(*(r[c] for c in ("df", "firsts", "ends", "maxima", "starts", "postings"))) for r in rows}
    weight = lambda p: math.floor(1000 * math.log((2 * n + 2) / (2 * p.df + 1)))
    got = lexical.best([(p, max(1, weight(p))) for p in lists.values()], n, 3)
    assert [d for _, d in got] == [0, 700, 1400]
    assert 0 < (~lists["the"].closed).sum() <= 8 < len(lists["the"].ends)


# ---------------------------------------------------------------- 12


def test_instances_are_sentences():
    for text in [*(t or "" for t in TEXTS if t is None or len(t) < 1000), "A b. C d!? e\nf\n\n--- . İx ß 3rd"]:
        made = toxicity.instances(text)
        want = [(m.start(), m.end()) for m in re.finditer(f"[^{re.escape(toxicity._ENDS)}]*[{re.escape(toxicity._ENDS)}]?", text) if any(c.isalnum() for c in m.group())]
        assert list(zip(made.begin.tolist(), made.end.tolist(), strict=True)) == want
        words = [len(w) for a, b in want for w in re.findall(r"[^\W_]+", text[a:b]) if all(c.isalnum() for c in w)]
        assert len(made.feature) >= len(words)
    a, b = (toxicity.instances(t).feature[0] for t in ("zzz Word", "word"))
    assert toxicity.instances("zzz Word").feature[1] == b != a


def test_noisy_or_and_gradient():
    model = toxicity.Model(np.random.default_rng(4).standard_normal(1 << toxicity.BITS), -1.0)
    text = "One two. Three four five! six\nseven"
    made = toxicity.instances(text)
    z = [model.bias + sum(model.weights[f] for f, s in zip(made.feature, made.sentence, strict=True) if s == i) for i in range(4)]
    p = [1 / (1 + math.exp(-x)) for x in z]
    assert abs(model.score(text) - (1 - np.prod([1 - x for x in p]))) < 1e-9
    assert [(a, b) for a, b, _ in model.spans(text)] == [(int(made.begin[i]), int(made.end[i])) for i in range(4) if p[i] >= 0.5]
    z = np.array([-3.0, 0.5, 2.0, -30.0])
    for label in (0, 1):
        _, by = toxicity.loss_gradient(z, label)
        for i in range(4):
            step = np.eye(4)[i] * 1e-6
            assert abs((toxicity.loss_gradient(z + step, label)[0] - toxicity.loss_gradient(z - step, label)[0]) / 2e-6 - by[i]) < 1e-5
    assert np.isfinite(toxicity.loss_gradient(np.full(3, -800.0), 1)[1]).all()


def planted(n, seed):
    """Documents of many sentences; toxic ones hold one sentence with a bad word of some ending."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    rows = []
    for i in range(n):
        said = [" ".join(word() for _ in range(rng.integers(3, 12))) + "." for _ in range(rng.integers(1, 30))]
        bad = i % 3 == 0
        at = int(rng.integers(len(said)))
        if bad:
            said[at] = f"{word()} zqx{word()} {word()}."
        rows.append((i, " ".join(said), int(bad), sum(len(s) + 1 for s in said[:at])))
    return rows


def test_toxicity_learns_from_documents_and_finds_sentences(spark):
    rows = planted(900, 5)
    docs = spark.createDataFrame([(i, t, "clash", 0.0) for i, t, _, _ in rows], "doc_id long, text string, k string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y, _ in rows] + [(None, 1, 1), (5, None, 1), (7, 3, 1)], "doc_id long, toxic int, t int")
    model = toxicity.train_on_labels(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(rows[i][2]) for i in held]) >= 0.97
    spans = {}
    for r in toxicity.offending(docs, model).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    right = [any(a <= rows[i][3] < b for a, b in spans.get(i, [])) for i in held if rows[i][2]]
    assert np.mean(right) >= 0.95
    assert np.mean([len(spans.get(i, [])) for i in held if not rows[i][2]]) <= 0.05
    assert toxicity.train_on_labels(docs, labels.where("false")).score(rows[0][1]) < 0.5


def test_toxicity_held_out(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train_on_labels(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).selectExpr("(score >= 0.5) = (toxic = 1) as ok").collect()
    assert np.mean([r.ok for r in got]) >= 0.8


def test_toxicity_of_odd_rows(odd):  # noqa: F811
    model = toxicity.Model(np.random.default_rng(4).standard_normal(1 << toxicity.BITS), -1.0)
    rows = toxicity.score(odd, model).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    assert toxicity.score(odd, model).count() == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if not any(c.isalnum() for c in r.text or ""))
    assert all(abs(r.score - model.score(r.text)) < 1e-12 for r in rows)
    assert toxicity.score(odd.where("false"), model).count() == 0 and toxicity.offending(odd.where("false"), model).count() == 0


# ---------------------------------------------------------------- 13


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Root, and of each leaf its (left, right) siblings level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for nodes in levels[:-1]:
            a = i - i % 3
            path.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 3])))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def plain_leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
        trees[s] = plain_tree([plain_leaf(r, r["text"]) for r in groups[s]])
    if not names:
        return []
    root, tops = plain_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            node = plain_leaf(r, r["text"].replace("\n", "") if changed and r["text"] is not None else r["text"])
            for left, right in [*path, *top]:
                node = H(left, node, right)
            out.append((r["doc_id"], plain_leaf(r, r["text"]), trees[s][0], root, H(*(a + b for a, b in [*path, *top])), node, node == root))
    return out


def made(df):
    return [tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 80, 81, 82, 243, 300])
@pytest.mark.parametrize("part", [1, 2, 5])
def test_traversal(n, part):
    leaves = [H(str(i)) for i in range(n)]
    root, paths = plain_tree(leaves)
    levels = merkle.levels_of(n, n)
    assert list(merkle.traverse(leaves, levels, part)) == paths
    assert all(merkle.fold(x, p) == root for x, p in zip(leaves, paths, strict=True))
    stack = merkle.Stack(levels)
    for x in leaves:
        stack.add(x)
    assert stack.close() == root


def test_subtrees_are_bounded(monkeypatch):
    """Beside its leaves a traversal holds two subtrees for each part of its height, whatever the block's size."""
    alive, make = weakref.WeakSet(), merkle.Subtree.__init__

    def counted(self, *args):
        make(self, *args)
        alive.add(self)

    monkeypatch.setattr(merkle.Subtree, "__init__", counted)
    held = [(len(alive), sum(len(t.nodes) for t in alive)) for _ in merkle.traverse([H(str(i)) for i in range(3**7)], 7)]
    assert max(n for n, _ in held) <= 2 * 4 and max(n for _, n in held) <= 2 * 4 * (9 + 3)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height):
    """Trees of one and of many blocks, more sources than a block's leaves, null and empty sources, repeats, ties, clashing columns."""
    rows = [(i * 7 % 101, ["b", "a", None, "", "é", "a b", *(f"s{j}" for j in range(12))][min(i % 23, 17) if i > 40 else 0], None if i % 11 == 0 else "en", None if i % 13 == 0 else i, None if i % 9 == 0 else "" if i % 17 == 0 else f"line {i}\nmore\n" * (i % 4 + 1), 1, "n") for i in range(140)]
    rows += [rows[5], rows[5], (rows[5][0], "b", "de", 1, "other\n", 1, "n"), (None, "b", "en", 3, "x\ny", 1, "n"), (None, None, None, None, None, 1, "n"), (3, "long", "en", 1, "word\n" * 60_000, 1, "n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, pos int, grp string").repartition(3)
    want = plain_manifest([r.asDict() for r in df.collect()])
    got = made(merkle.manifest(df, height))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r[-1] for r in got} == {True, False}
    assert merkle.manifest(df.where("false"), height).count() == 0


def test_manifest_of_one_document(spark):
    df = spark.createDataFrame([(2, "t\n", "en", "s", 1)], "doc_id int, text string, lang string, source string, n_chars long")
    (row,) = made(merkle.manifest(df))
    assert row[1] == row[2] == row[3] and row[4] == H() and row == plain_manifest([df.first().asDict()])[0]
