"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character bigrams and trigrams of the lower-cased text, weighted by their share of the text
times their inverse document frequency, which is counted over all learnable documents. Weights are learned by follow-the-regularised-leader (FTRL-proximal) with
L1 and L2 penalties, which leaves most of them zero; a temperature fitted on rows kept out of training calibrates the
probabilities. A text's score is linear in its n-grams, so whole texts of any length stream through in pieces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm._shared import byte_slices, class_sample, crc_mod

UNDETERMINED = "und"
BITS = 16
_ORDERS = (2, 3)
_PIECE = 1_000_000


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter; characters that are numbers, such as Roman numerals and fractions, are none."""
    return any(map(str.isalpha, text or ""))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def ngrams(points: np.ndarray, n: int) -> np.ndarray:
    """Hashed n-grams that begin at each character but the last n - 1; runs of characters are hashed whatever text they lie in."""
    h = np.full(len(points) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h = (h ^ points[j : len(points) - n + 1 + j]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return h & np.uint32((1 << BITS) - 1)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text and their shares of its n-grams."""
    p = _points(text)
    total = np.zeros(1 << BITS, np.int64)
    for n in _ORDERS:
        total += np.bincount(ngrams(p, n), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(1, total.sum())).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # feature x language: weight times idf times scale
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of whole texts, gathered piece by piece."""
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        points = [_points(t) for t in texts]
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(points[b]) <= _PIECE):
                size += len(points[b])
                b += 1
            flat, lens = np.concatenate(points[a:b]), np.array([len(p) for p in points[a:b]])
            starts = np.cumsum(lens) - lens
            for order in _ORDERS:
                for lo in range(0, len(flat), _PIECE):  # one long text alone may exceed the piece
                    cut = flat[lo : lo + _PIECE + order - 1]
                    if len(cut) < order:
                        continue
                    rows = self.table[ngrams(cut, order)]
                    # n-grams that reach into the next text count for none
                    ends = starts + lens - order + 1
                    inside = (starts < lo + len(rows)) & (ends > lo)
                    for i in np.flatnonzero(inside & (ends > starts)):
                        s, e = max(starts[i], lo) - lo, min(ends[i], lo + len(rows)) - lo
                        sums[a + i] += rows[s:e].sum(0)
                        n[a + i] += e - s
            a = b
        return self.bias + sums / np.maximum(n, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([has_letter(t) for t in texts], bool)
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if known.any() and self.languages:
            at = np.flatnonzero(known)
            p = softmax(self.logits([texts[i] for i in at]) / self.temperature)
            for i, k, s in zip(at.tolist(), p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                names[i], score[i] = self.languages[k], s
        return names, np.clip(score, 0, 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many whole texts hold each feature, and the number of texts; tasks' sums are added by feature."""

    def run(batches):
        total, n, seen = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
        for batch in batches:
            for a, b in byte_slices(batch.column(0)):
                for t in batch.column(0).slice(a, b - a).to_pylist():
                    p = _points(t)
                    held = [ngrams(p, order) for order in _ORDERS]
                    for h in held:
                        seen[h] = True
                    total += seen
                    for h in held:
                        seen[h] = False
            n += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[total[at], n])], names=["feature", "n"])

    out, n = np.zeros(1 << BITS, np.int64), 0
    rows = df.where(F.length(text) > 0).select(F.col(text).cast("string").alias("t"))
    for r in rows.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # at most a row for each feature
        if r["feature"] < 0:
            n = r["n"]
        else:
            out[r["feature"]] = r["n"]
    return out, n


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], frequencies: tuple[np.ndarray, int] | None = None, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, scale: float = 30.0, seed: int = 7) -> Model:
    """FTRL-proximal over (language, features, shares); a fifth of the rows sets the temperature alone. frequencies: of document_frequencies(); else the rows' own."""
    languages = sorted({r[0] for r in rows})
    k, size = len(languages), 1 << BITS
    if not rows:
        return Model([], np.zeros((size, 0), np.float32), np.zeros(0), 1.0)
    df, total = frequencies or (np.bincount(np.concatenate([r[1] for r in rows]), minlength=size), len(rows))
    idf = np.log((1 + total) / (1 + df)) + 1
    order = np.random.default_rng(seed).permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    z, n = np.zeros((size, k)), np.zeros((size, k))
    bias_z, bias_n = np.zeros(k), np.zeros(k)
    target = {v: i for i, v in enumerate(languages)}

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(seed + epoch).permutation(used):
            lang, f, share = rows[i]
            x = (share * idf[f] * scale)[:, None]
            w, b = weights(z[f], n[f]), weights(bias_z, bias_n)
            g = softmax((x * w).sum(0, keepdims=True) + b)[0]
            g[target[lang]] -= 1
            gx = x * g
            z[f] += gx - (np.sqrt(n[f] + gx * gx) - np.sqrt(n[f])) / alpha * w
            n[f] += gx * gx
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    w, b = weights(z, n), weights(bias_z, bias_n)
    temperature = 1.0
    if len(held):
        logits = np.array([(rows[i][2] * idf[rows[i][1]] * scale) @ w[rows[i][1]] + b for i in held])
        y = np.array([target[rows[i][0]] for i in held])
        grid = np.geomspace(0.05, 10, 60)
        sure = (len(y) + 1) / (len(y) + 2)  # else rows that are all told apart would ask for temperature 0

        def loss_at(t):
            p = np.log(softmax(logits / t) + 1e-12)
            own = p[np.arange(len(y)), y]
            return -(sure * own + (1 - sure) * (p.sum(1) - own) / max(1, k - 1)).mean()

        loss = [loss_at(t) for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(languages, (w * idf[:, None] * scale).astype(np.float32), b, temperature)


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_class: int = 400, most_rows: int = 80_000, **options) -> Model:
    """Fit on about per_class labelled rows of each language, drawn by a hash of key over all labelled rows, and on about most_rows in all: the documented bounds of what reaches the driver.

    All languages are learned, from fewer rows each where there are more than most_rows / per_class of them; the model takes
    2 ** BITS numbers for each. Of rows with one key the one of least language and text counts.
    """

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                cut = batch.slice(a, b - a)
                found = [counts(t) for t in cut.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float32()))], names=["lang", "f", "s"])

    labelled = df.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"), F.col(label).alias("lang"))
    drawn = class_sample(labelled, "lang", "k", per_class, most_rows).groupBy("k").agg(F.min(F.struct("lang", "text")).alias("r"))
    rows = drawn.select("r.lang", "r.text").mapInArrow(run, "lang string, f array<int>, s array<float>").toArrow()
    features, shares = rows.column("f").combine_chunks(), rows.column("s").combine_chunks()
    found = [(lang, f.values.to_numpy(), s.values.to_numpy()) for lang, f, s in zip(rows.column("lang").to_pylist(), features, shares, strict=True)]
    return fit(sorted(found, key=lambda r: (r[0], len(r[1]), r[1][:4].tolist(), float(r[2][0]))), document_frequencies(labelled), **options)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row's whole text.

    Null texts and texts without a letter are undetermined (`und`, score 0), as is every text where no row
    could be learned from. Null keys and repeated rows are kept; an empty table gives no rows; no other column is
    read. One pass without a shuffle.
    """

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(1), rows=256):
                cut = batch.slice(a, b - a)
                names, score = model.predict(cut.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(names, pa.string()), pa.array(score)], names=["k", "lang_pred", "score"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    return F.coalesce(crc_mod(key, 4) == 2, F.lit(False))


def train_on_documents(documents: DataFrame, **options) -> Model:
    """Learn from the rows that aren't held out."""
    return train(documents.where(~held_out()), **options)
