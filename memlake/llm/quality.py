"""Quality of whole texts by a byte-level convolutional network in numpy.

Bytes are embedded, cut into chunks that overlap by a filter's width so that every window of the text lies in one,
convolved with learned filters, rectified and max-pooled in each chunk. A document's features are the mean and the
maximum of its chunks' pools; a logistic layer combines them into one probability. Training is by Adam on the log loss,
with gradients through the pooled positions alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm._shared import byte_slices, class_sample, crc_mod

EMBED, WIDTH, STRIDE, FILTERS, CHUNK = 6, 8, 2, 24, 256
_BATCH = 1 << 20


def windows(data: bytes) -> np.ndarray:
    """The text's bytes as 1..256 (0 pads), cut into chunks of CHUNK windows' starts; a row for each chunk."""
    body = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    n = max(1, -(-len(body) // CHUNK))
    padded = np.zeros(n * CHUNK + WIDTH, np.int16)
    padded[: len(body)] = body
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH)[::CHUNK][:n]


@dataclass
class Network:
    embed: np.ndarray  # 257 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    head: np.ndarray  # 2 * FILTERS
    offset: np.ndarray  # 1

    @classmethod
    def start(cls, seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        return cls(f(257, EMBED, by=0.5), f(WIDTH * EMBED, FILTERS, by=0.3), np.zeros(FILTERS, np.float32), f(2 * FILTERS, by=0.1), np.zeros(1, np.float32))

    def pool(self, chunks: np.ndarray, places: bool = False):
        """Maximum of each filter in each chunk, rectified; with places, where it lies."""
        per = CHUNK // STRIDE
        e = np.ascontiguousarray(self.embed[chunks].reshape(len(chunks), -1))
        step = e.itemsize * EMBED * STRIDE
        view = np.lib.stride_tricks.as_strided(e, (len(e), per, WIDTH * EMBED), (e.strides[0], step, e.itemsize))
        out = (view.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(e), per, FILTERS)
        if not places:
            return np.maximum(out.max(1) + self.bias, 0)
        at = out.argmax(1)
        return np.maximum(np.take_along_axis(out, at[:, None], 1)[:, 0] + self.bias, 0), at

    def features(self, texts: list[bytes]) -> np.ndarray:
        cut = [windows(t) for t in texts]
        n = np.array([len(c) for c in cut])
        starts = np.cumsum(n) - n
        flat = np.concatenate(cut)
        pooled = np.concatenate([self.pool(flat[a : a + _BATCH // CHUNK]) for a in range(0, len(flat), _BATCH // CHUNK)])
        return np.concatenate([np.add.reduceat(pooled, starts) / n[:, None], np.maximum.reduceat(pooled, starts)], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = (self.features(texts) @ self.head + self.offset[0]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def _parts(self):
        return [self.embed, self.filters, self.bias, self.head, self.offset]


def loss_gradients(net: Network, cut: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted mean log loss (with the head's penalty) of documents, each of them windows() of a text, and its gradients by the network's parts."""
    n = np.array([len(c) for c in cut])
    starts, doc = np.cumsum(n) - n, np.repeat(np.arange(len(cut)), n)
    chunks = np.concatenate(cut)
    made = [net.pool(chunks[i : i + 4096], True) for i in range(0, len(chunks), 4096)]
    pooled, at = np.concatenate([p for p, _ in made]), np.concatenate([p for _, p in made])
    mean, top = np.add.reduceat(pooled, starts) / n[:, None], np.maximum.reduceat(pooled, starts)
    x = np.concatenate([mean, top], 1)
    z = np.clip(x @ net.head + net.offset, -60, 60)
    p = 1 / (1 + np.exp(-z))
    loss = float((weight * (np.logaddexp(0, z) - y * z)).mean() + 5e-5 * (net.head**2).sum())
    d = ((p - y) * weight / len(cut)).astype(np.float32)
    dx = d[:, None] * net.head
    dpool = dx[doc, :FILTERS] / n[doc, None]
    best = pooled == top[doc]
    dpool += np.where(best, dx[doc, FILTERS:] / np.maximum(np.add.reduceat(best, starts, dtype=np.float32)[doc], 1), 0)
    dpool *= pooled > 0
    # through the pooled windows
    c, f = np.nonzero(dpool)
    begin, g = at[c, f] * STRIDE, dpool[c, f]
    codes = chunks[c[:, None], begin[:, None] + np.arange(WIDTH)]
    dfilters, dembed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    for k in range(FILTERS):
        mine = f == k
        if mine.any():
            dfilters[:, k] = (net.embed[codes[mine]].reshape(int(mine.sum()), -1) * g[mine, None]).sum(0)
    back = (net.filters.T[f] * g[:, None]).reshape(len(f) * WIDTH, EMBED)
    for k in range(EMBED):
        dembed[:, k] = np.bincount(codes.ravel(), weights=back[:, k], minlength=257)
    return loss, [dembed, dfilters, dpool.sum(0), x.T @ d + 1e-4 * net.head, np.array([d.sum()], np.float32)]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, rate: float = 0.01, group: int = 16, seed: int = 5) -> Network:
    """Adam with balanced class weights; without both classes the network gives that class's share alone."""
    net = Network.start()
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.head[:] = 0
        net.offset[:] = 0 if not len(y) else 4 if y[0] else -4
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    cut = [windows(t) for t in texts]
    parts = net._parts()
    m, v, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    for epoch in range(epochs):
        order = np.random.default_rng(seed + epoch).permutation(len(y))
        for a in range(0, len(order), group):
            rows = order[a : a + group]
            _, grads = loss_gradients(net, [cut[i] for i in rows], y[rows], weight[rows])
            t += 1
            for i, (part, grad) in enumerate(zip(parts, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                part -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 700, most_bytes: int = 200_000, **options) -> Network:
    """Fit on the whole texts, of at most most_bytes each, of about per_class rows of each label, drawn by a hash of key: the documented bounds of what reaches the driver.

    The draw is made on labels alone; its distinct keys, whose number per_class bounds, are sent to all tasks, so that the
    documents are not shuffled. Rows with a null label are left out; a repeated key counts once, with its least label and text.
    """
    drawn = class_sample(labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")), "y", "k", per_class)
    keys = drawn.groupBy("k").agg(F.min("y").alias("y"))
    rows = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t")).where(F.octet_length("t") <= most_bytes)
    found = rows.join(F.broadcast(keys), "k").groupBy("k", "y").agg(F.min("t").alias("t")).toArrow()
    order = sorted(range(found.num_rows), key=lambda i: found.column("k")[i].as_py())
    texts, y = found.column("t").to_pylist(), np.array(found.column("y").to_pylist())
    return fit([texts[i] for i in order], y[order] if len(y) else y, **options)


def score(df: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row's whole text; null counts as empty, and empty texts have the score of a chunk of padding.

    Null keys and repeated rows are kept, an empty table gives no rows, other columns aren't read. One pass
    without a shuffle; memory is bounded by cutting batches and chunks.
    """

    def run(batches):
        for batch in batches:
            for a, b in byte_slices(batch.column(1), rows=64):
                cut = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(net.score([t or b"" for t in cut.column(1).to_pylist()]))], names=["k", "score"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", key)


def held_out(key: str = "doc_id"):
    return F.coalesce(crc_mod(key, 3) == 1, F.lit(False))


def train_on_labels(documents: DataFrame, labels: DataFrame, **options) -> Network:
    """Learn from the labelled rows that aren't held out."""
    return train(documents, labels.where(~held_out()), **options)
