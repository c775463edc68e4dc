"""Toxicity of whole texts by multiple-instance learning: sentences are instances, documents alone have labels.

A sentence's score is logistic in its hashed words and beginnings of words; a document is toxic with the noisy-or of its
sentences, 1 - prod(1 - p). With A the sum of softplus(z) over its sentences that is 1 - exp(-A), and the log loss of the
document's label has the gradient sigmoid(z) by each sentence, times 1 where the label is 0 and -1 / (exp(A) - 1) where
it is 1: so sentences are never labelled, and those that explain a toxic document take the blame. Weights are learned by
FTRL-proximal with an L1 penalty, which leaves words that explain nothing at zero, so that long texts gather no noise.
offending() locates the sentences that score at least a half by themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm._shared import byte_slices, class_sample, crc_mod

BITS = 20
PREFIXES = (3, 4, 5)
_ENDS = ".!?\n\r…。！？"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a letter or digit, and its lower-case form where that is one code point."""
    word, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        word[i] = c.isalnum()
        low = c.lower()
        if low != c and len(low) == 1:
            lower[i] = ord(low)
    return word, lower


def _powers(n: int, by: np.uint64) -> np.ndarray:
    out = np.full(n, by, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Instances:
    """Sentences that hold a word: their bounds in code points, and a (sentence, feature) pair for each feature of each word."""

    begin: np.ndarray
    end: np.ndarray
    sentence: np.ndarray
    feature: np.ndarray


def instances(text: str) -> Instances:
    """A sentence ends with a run of full stops, marks or line ends; a text without them is one sentence."""
    is_word, lower = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = is_word[points]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Instances(none, none, none, none.astype(np.int32))
    # Words as differences of one running sum, so that words of any length are hashed at once.
    ends = np.isin(points, np.frombuffer(_ENDS.encode("utf-32-le"), np.uint32))
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lower[points].astype(np.uint64) + np.uint64(1)) * _powers(len(points), _STEP), dtype=np.uint64)])
    shift, size = _powers(len(points), _BACK)[starts], stops - starts
    number = np.cumsum(ends)  # how many ends lie up to each place
    which, sentence = np.unique(number[starts], return_inverse=True)
    after = np.append(np.flatnonzero(ends) + 1, len(points))
    begin, end = np.concatenate([[0], after])[which], after[which]

    def hashed(rows, stop, kind):
        h = (running[stop] - running[starts[rows]]) * shift[rows]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * kind)
        return (h >> np.uint64(64 - BITS)).astype(np.int32)

    found, of = [hashed(slice(None), stops, 0)], [sentence]
    for k in PREFIXES:
        rows = np.flatnonzero(size >= k)
        found.append(hashed(rows, starts[rows] + k, k)), of.append(sentence[rows])
    return Instances(begin, end, np.concatenate(of), np.concatenate(found))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, made: Instances) -> np.ndarray:
        """The logit of each sentence."""
        return self.bias + np.bincount(made.sentence, weights=self.weights[made.feature], minlength=len(made.begin))

    def score(self, text: str | None) -> float:
        """The noisy-or of the whole text's sentences; 0 without a word."""
        made = instances(text or "")
        return float(-np.expm1(-np.logaddexp(0, self.sentences(made)).sum())) if len(made.begin) else 0.0

    def spans(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that are toxic by themselves; code points, end exclusive."""
        made = instances(text or "")
        p = _sigmoid(self.sentences(made)) if len(made.begin) else np.zeros(0)
        return [(int(made.begin[i]), int(made.end[i]), float(p[i])) for i in np.flatnonzero(p >= least)]


def loss_gradient(z: np.ndarray, label: int) -> tuple[float, np.ndarray]:
    """Log loss of a document with sentence logits z, and its gradient by each of them."""
    total = float(np.logaddexp(0, z).sum())
    if label:
        miss = max(-np.expm1(-total), 1e-12)
        return float(-np.log(miss)), -np.exp(-total) / miss * _sigmoid(z)
    return total, _sigmoid(z)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 2.0, start: float = -5.0, clip: float = 3.0, seed: int = 11) -> Model:
    """FTRL-proximal over (label, sentence, feature); the bias begins at start, so that long clean texts cost little. Without both classes the model gives the class there is."""
    weights = np.zeros(1 << BITS)
    labels = {r[0] for r in rows}
    if len(labels) < 2:
        return Model(weights, 20.0 if labels == {1} else -60.0)
    z, n, bias, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), start, 0.0
    kept = []
    for label, sentence, feature in rows:
        if len(feature):
            at, inverse = np.unique(feature, return_inverse=True)
            kept.append((label, int(sentence.max()) + 1, sentence, at, inverse.astype(np.int32)))
    for epoch in range(epochs):
        for i in np.random.default_rng(seed + epoch).permutation(len(kept)):
            label, count, sentence, at, inverse = kept[i]
            w = np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha))
            _, by = loss_gradient(bias + np.bincount(sentence, weights=w[inverse], minlength=count), label)
            by = np.clip(by, -clip, clip)
            g = np.bincount(inverse, weights=by[sentence], minlength=len(at))
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            bias_n += by.sum() ** 2
            bias -= 0.1 * by.sum() / np.sqrt(1 + bias_n)
    weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha))
    return Model(weights, float(bias))


def _pieces(df: DataFrame, text: str, *others):
    return df.select(*others, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 3000, most_bytes: int = 200_000, **options) -> Model:
    """Fit on the whole texts, of at most most_bytes each, of about per_class rows of each label, drawn by a hash of key: the documented bounds of what reaches the driver.

    The draw is made on labels alone; its distinct keys, whose number per_class bounds, are sent to all tasks, so that the
    documents are not shuffled. Rows with a null key or label are left out; a repeated key counts once, with its least label and
    text. Extra columns of any name are not read; empty tables give a model that calls nothing toxic.
    """
    drawn = class_sample(labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")), "y", "k", per_class)
    keys = drawn.groupBy("k").agg(F.min("y").alias("y"))
    rows = _pieces(documents, text, F.col(key).alias("k")).where(F.octet_length("t") <= most_bytes)
    once = rows.join(F.broadcast(keys), "k").groupBy("k", "y").agg(F.min("t").alias("t"))

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(2), rows=256):
                cut = batch.slice(a, b - a)
                made = [instances(t) for t in cut.column(2).to_pylist()]
                lists = [pa.array([m.sentence.astype(np.int32) for m in made], pa.list_(pa.int32())), pa.array([m.feature for m in made], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), *lists], names=["k", "y", "s", "f"])

    kind = documents.schema[key].dataType.simpleString()
    found = once.mapInArrow(run, f"k {kind}, y int, s array<int>, f array<int>").toArrow().sort_by("k")
    lists = (found.column(c).combine_chunks() for c in ("s", "f"))
    return fit([(y, s.values.to_numpy(), f.values.to_numpy()) for y, s, f in zip(found.column("y").to_pylist(), *lists, strict=True)], **options)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row's whole text; texts that are null, empty or without a word score 0.

    Null keys and repeated rows are kept, an empty table gives no rows, other columns aren't read. One pass without a
    shuffle; batches are cut by bytes, and a long text's memory is a small multiple of its own size.
    """

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(1), rows=256):
                cut = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array([model.score(t) for t in cut.column(1).to_pylist()], pa.float64())], names=["k", "score"])

    kind = df.schema[key].dataType.simpleString()
    return _pieces(df, text, F.col(key).alias("k")).mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", key)


def offending(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, start, end, probability): the sentences of every whole text that are toxic by themselves, in code points, end exclusive; no row for texts without one."""

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(1), rows=256):
                cut = batch.slice(a, b - a)
                found = [(i, *s) for i, t in enumerate(cut.column(1).to_pylist()) for s in model.spans(t, least)]
                at, start, end, p = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([cut.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(p, pa.float64())], names=["k", "start", "end", "probability"])

    kind = df.schema[key].dataType.simpleString()
    return _pieces(df, text, F.col(key).alias("k")).mapInArrow(run, f"k {kind}, start long, end long, probability double").withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    return F.coalesce(crc_mod(key, 5) == 0, F.lit(False))


def train_on_labels(documents: DataFrame, labels: DataFrame, **options) -> Model:
    """Learn from the labelled rows that aren't held out."""
    return train(documents, labels.where(~held_out()), **options)
