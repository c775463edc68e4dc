"""Benchmark decontamination by latent semantic retrieval.

Terms are the benchmark's own words; all other words of the corpus are one unknown term that only lengthens vectors.
Passages are windows of two adjoining blocks of words, over every whole document. A distributed randomised SVD of the
passages' TF-IDF matrix A gives the latent space: each task sketches its rows, the sketches A'(A O) are summed by term,
and a Nystrom step on the small matrices yields singular vectors. Vocabulary, frequencies and space are the whole benchmark's,
so what is found of an item depends on no other item's length and on no grouping of items.

Passages close by cosine to a window of a benchmark item are candidates. A candidate that holds few of the item's words is
dropped; the text around the others is searched for the item: for its longest common subsequence, and, where that is too
short, for the item's pieces one by one, wherever each stands, so that parts may be swapped. The item's rarest words, its
answer, must be there too. A copy with more than 1 - `subsequence` of its words replaced, or a quote of less than the
share `subsequence` of an item, is not reported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memlake.llm._shared import byte_slices, drop_written, written

_WORD = re.compile(r"\w+")
BLOCK = 8


@dataclass(frozen=True)
class Settings:
    rank: int = 64
    #: Least cosine of a passage and an item's window; less, by the root, for an item of fewer words than a passage. A passage that holds the share s of a
    #: window's words has a cosine of about its root, and less where it lies up to two words beside the window: 0.68 for s = 0.6.
    cosine: float = 0.6
    #: Least share of a passage's words (of the item's, where it is shorter) that are the item's words.
    own: float = 0.4
    #: Share of an item's words that must be found in order, or piece by piece, around a passage.
    subsequence: float = 0.5
    #: Words that must be found so in any case, or all of an item with fewer.
    words: int = 8
    #: Share of the answer's words that the text must hold. Answers are a few words, of which a copy with 40 % of its words replaced seldom keeps half.
    answer: float = 0.3
    #: Items searched for in one pass over the corpus, fewer where they are long or the vocabulary is large; results don't depend on it.
    items: int = 500


#: Most distinct words of the items that share a space: the driver holds a row of the space's rank for each, 150 MB at this bound.
MOST_TERMS = 250_000


@dataclass
class Latent:
    idf: np.ndarray
    vectors: np.ndarray  # term x rank, IDF included
    singular: np.ndarray = field(default_factory=lambda: np.zeros(0))


#: Latin-1 texts are cut by a table, which gives the pattern's words faster.
_LATIN = bytes(i if _WORD.match(chr(i)) else 32 for i in range(256))


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(low)


def lcs(a: list[int], b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _blocks(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents of lens words one after another: where each block begins, and the number of each document's blocks."""
    n = -(-lens // BLOCK)
    first = np.repeat(np.cumsum(lens) - lens, n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return first + within * BLOCK, n


class _Passages:
    """Passages of a batch of documents: window i is block i with the next of its document, or block i alone at the end."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray):
        keep = lens > 0
        self.docs, self.ids = np.flatnonzero(keep), ids
        self.begin, n = _blocks(lens[keep])
        self.doc = np.repeat(np.arange(len(n)), n)
        self.last = np.zeros(len(self.begin), bool)
        self.last[np.cumsum(n) - 1] = True
        self.size = np.diff(np.r_[self.begin, len(ids)])
        #: A row for each block; 0, the unknown term, pads.
        self.rows = np.zeros((len(self.begin), BLOCK), np.intp)
        self.rows[np.arange(BLOCK) < self.size[:, None]] = ids

    def pair(self, blocks: np.ndarray) -> np.ndarray:
        """Sums of each window's blocks."""
        out = blocks.copy()
        inner = np.flatnonzero(~self.last)
        out[inner] += blocks[inner + 1]
        return out

    def spread(self, windows: np.ndarray) -> np.ndarray:
        """Sums of the windows that hold each block."""
        out = windows.copy()
        inner = np.flatnonzero(~self.last)
        out[inner + 1] += windows[inner]
        return out

    def norm(self, idf: np.ndarray) -> np.ndarray:
        """Lengths of the windows' TF-IDF rows, each word counted by itself."""
        square = (idf * idf)[self.rows].sum(1) - (BLOCK - self.size) * float(idf[0]) ** 2
        return np.sqrt(np.maximum(self.pair(square), 1e-12)).astype(np.float32)

    def project(self, table: np.ndarray) -> np.ndarray:
        """Sums over each window's words of rows of table, whose row 0 must be zeros."""
        out, one = table[self.rows[:, 0]], np.empty((len(self.rows), table.shape[1]), table.dtype)
        for j in range(1, BLOCK):
            out += np.take(table, self.rows[:, j], axis=0, out=one, mode="clip")
        return self.pair(out)

    def gather(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transpose of project: terms, and for each the sum of its blocks' rows of blocks."""
        terms, local = np.unique(self.rows.T, return_inverse=True)
        local, columns = local.ravel(), np.ascontiguousarray(blocks.T, np.float64)
        out = np.array([np.bincount(local, np.tile(weights, BLOCK), len(terms)) for weights in columns]).T
        return terms[terms > 0], out[terms > 0]


def id_type(terms: int) -> np.dtype:
    """The type of ids below terms."""
    return np.dtype(np.uint16 if terms <= 1 << 16 else np.uint32)


def _slices(batch, kind: np.dtype, size: int = 40_000):
    """Pieces of a batch of (key, ids binary) of about size words, as flat ids and lengths; small ones, whose rows of floats stay in the cache."""
    keys, data = batch.column("k"), batch.column("ids")
    lens = np.diff(np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]) // kind.itemsize
    a = 0
    while a < len(lens):
        b = max(a + 1, int(np.searchsorted(np.cumsum(lens[a:]), size, side="right")) + a)
        raw = b"".join(data.slice(a, b - a).to_pylist())
        yield keys.slice(a, b - a), np.frombuffer(raw, kind), lens[a:b].astype(np.int64)
        a = b


def tokenise(df: DataFrame, vocabulary: dict[str, int], key: str, text: str) -> tuple[DataFrame, np.ndarray, int]:
    """The documents' words as term ids, written once; block frequencies of all terms over the whole corpus; the number of blocks."""
    size = len(vocabulary) + 1
    ids_as = id_type(size + 1)

    def run(batches):
        get, df_, total = vocabulary.get, np.zeros(size, np.int64), 0
        for batch in batches:
            out = []
            for a, b in byte_slices(batch.column(1)):
                found = [np.fromiter(map(get, words(t), repeat(0)), ids_as) for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, lens = np.concatenate(found), np.array([len(x) for x in found])
                begin, _ = _blocks(lens)
                if len(ids):
                    total += len(begin)
                    # a row for each block, its words sorted: of equal neighbours one counts; `size` pads
                    rows = np.full((len(begin), BLOCK), size, ids_as)
                    n = np.diff(np.r_[begin, len(ids)])
                    rows[np.arange(BLOCK) < n[:, None]] = ids
                    rows.sort(axis=1)
                    once = np.c_[np.ones(len(rows), bool), rows[:, 1:] != rows[:, :-1]]
                    df_ += np.bincount(rows[once], minlength=size + 1)[:size]
                out += [x.tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.int64())], names=["k", "ids", "term", "n"])
        terms = np.r_[np.flatnonzero(df_), -1].astype(np.int32)
        n = np.r_[df_[df_ > 0], total]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(terms), none), pa.nulls(len(terms), pa.binary()), pa.array(terms), pa.array(n)], names=["k", "ids", "term", "n"])

    kind = df.schema[key].dataType
    none = to_arrow_type(kind)
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    tokens = written(rows.mapInArrow(run, f"k {kind.simpleString()}, ids binary, term int, n long"), "terms")
    counts = np.zeros(size + 1, np.int64)  # the last: blocks
    for r in tokens.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most a row for each benchmark word
        counts[r["term"]] = r["n"]
    return tokens.where("term is null").select("k", "ids"), counts[:-1], int(counts[-1])


def latent_space(tokens: DataFrame, counts: np.ndarray, blocks: int, rank: int, seed: int = 11) -> Latent:
    """Randomised SVD of all passages: sketches are summed by term, whose number the benchmark bounds. An unknown word weighs as the mean word of the benchmark does."""
    size, kind = len(counts), id_type(len(counts) + 1)
    idf = np.log((1 + blocks) / (1 + counts)).astype(np.float32) + 1
    idf[0] = idf[1:].mean() if size > 1 else 1
    k = min(rank + 8, size)
    omega = np.random.default_rng(seed).standard_normal((size, k)).astype(np.float32)
    omega[0] = 0
    table = omega * idf[:, None]

    def run(batches):
        z = np.zeros((size, k))
        for batch in batches:
            for _, ids, lens in _slices(batch, kind):
                p = _Passages(ids, lens)
                if len(p.begin):
                    terms, sums = p.gather(p.spread(p.project(table) / (p.norm(idf) ** 2)[:, None]))
                    z[terms] += sums * idf[terms, None]
        seen = np.flatnonzero(np.abs(z).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(z[seen, i]) for i in range(k))], names=["term", *(f"z{i}" for i in range(k))])

    sketch = tokens.mapInArrow(run, "term int, " + ", ".join(f"z{i} double" for i in range(k)))
    z, summed = np.zeros((size, k)), sketch.groupBy("term").agg(*(F.sum(f"z{i}").alias(f"z{i}") for i in range(k))).toArrow()
    z[summed.column("term").to_numpy()] = np.array([summed.column(f"z{i}").to_numpy() for i in range(k)]).T.reshape(-1, k)
    small = omega.T.astype(np.float64) @ z
    shift = 1e-9 * max(1.0, float(np.abs(small).max()))
    values, vectors = np.linalg.eigh((small + small.T) / 2 + shift * np.eye(k))
    good = values > shift
    u, s, _ = np.linalg.svd(z @ vectors[:, good] / np.sqrt(values[good]), full_matrices=False)
    u, s = u[:, :rank], s[:rank]
    return Latent(idf, (u * idf[:, None]).astype(np.float32), s)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _queries(items: list[list[int]], latent: Latent, step: int = 4, over: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Latent unit vectors of the items' windows at every step-th word, and each one's item. Windows reach over an item's ends by up to `over` words, as passages do; but they hold half a passage's words of it, or all."""
    rows, of = [], []
    for i, ids in enumerate(items):
        for a in range(-min(over, max(0, len(ids) - BLOCK)), max(1, len(ids) - 2 * BLOCK + step + over), step):
            part = ids[max(0, a) : a + 2 * BLOCK]
            if len(part) >= min(BLOCK, len(ids)):
                rows.append(latent.vectors[part].sum(0)), of.append(i)
    return _unit(np.array(rows, np.float32)), np.array(of)


class _Items:
    """A block of items, as tables over the vocabulary."""

    def __init__(self, ids_of: list[list[int]], latent: Latent, settings: Settings):
        self.ids_of, self.settings, self.kind = ids_of, settings, id_type(len(latent.idf) + 1)
        self.queries, owner = _queries(ids_of, latent)
        self.first = np.searchsorted(owner, np.arange(len(ids_of)))
        self.words = np.array([len(x) for x in ids_of])
        self.cosine = (settings.cosine * np.sqrt(np.minimum(1.0, self.words / (2 * BLOCK)))).astype(np.float32)
        self.need = np.maximum(settings.subsequence * self.words, np.minimum(settings.words, self.words))
        self.own = np.ceil(settings.own * np.minimum(2 * BLOCK, self.words)).astype(np.uint8)
        distinct = [sorted(set(x)) for x in ids_of]
        #: Of each item and term: the term's place among the item's distinct words, from 1; 0 for others.
        width = 1 + max(map(len, distinct))
        self.place = np.zeros((len(ids_of), len(latent.idf)), np.min_scalar_type(width))
        self.times, self.answer = np.zeros((len(ids_of), width), np.int32), np.zeros((len(ids_of), width), bool)
        for i, (ids, words) in enumerate(zip(ids_of, distinct, strict=True)):
            self.place[i, words] = np.arange(1, len(words) + 1)
            for x in ids:
                self.times[i, self.place[i, x]] += 1
            rare = sorted(words, key=lambda x: (-latent.idf[x], x))
            self.answer[i, self.place[i, rare[: max(1, len(rare) // 3)]]] = True
        #: Of each term and item: 1 where the term is the item's. A window's sum is at most its words, 2 * BLOCK.
        self.member = np.ascontiguousarray((self.place > 0).T, np.uint8)
        self.share = lru_cache(maxsize=1 << 16)(self._share)

    def candidates(self, vectors: np.ndarray):
        """Windows, items and cosines of the pairs that are close enough; each pair once."""
        step = max(1, (1 << 21) // len(self.queries))
        bounds = list(pairwise([*self.first.tolist(), len(self.queries)]))
        for a in range(0, len(vectors), step):
            cosines = self.queries @ vectors[a : a + step].T
            best = np.empty((len(bounds), cosines.shape[1]), cosines.dtype)
            for i, (lo, hi) in enumerate(bounds):
                cosines[lo:hi].max(0, out=best[i])
            o, w = np.divmod(np.flatnonzero(best >= self.cosine[:, None]), best.shape[1])
            yield w + a, o, best[o, w]

    def enough_words(self, p: _Passages) -> np.ndarray:
        """Ascending numbers, window * items + item, of the pairs in which a window holds enough of the item's words. They cost less than the cosines, and few windows are in any."""
        n, found = len(self.own), []
        step = max(1, (1 << 22) // len(p.begin))
        for a in range(0, n, step):
            w, o = np.nonzero(p.project(self.member[:, a : a + step]) >= self.own[a : a + step])
            found.append(w * n + o + a)
        return np.sort(np.concatenate(found))

    def holds_item(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, o: np.ndarray) -> np.ndarray:
        """Whether each stretch of text holds, in any order, as much of its item and of the item's answer as it must: no less than share() finds."""
        out = np.zeros(len(o), bool)
        step = max(1, (1 << 20) // max(int((hi - lo).max(initial=1)), self.times.shape[1]))
        for a in range(0, len(o), step):
            l, h, i = lo[a : a + step], hi[a : a + step], o[a : a + step]
            at = l[:, None] + np.arange(int((h - l).max()))
            terms = np.where(at < h[:, None], np.take(ids, at, mode="clip"), 0).astype(np.intp)
            place = np.take(self.place, terms + (i * self.place.shape[1])[:, None])
            have = np.zeros((len(i), self.times.shape[1]), bool)
            have[np.arange(len(i))[:, None], place] = True
            have[:, 0] = False
            enough = (have * self.times[i]).sum(1) >= self.need[i]
            out[a : a + step] = enough & ((have & self.answer[i]).sum(1) >= self.settings.answer * self.answer[i].sum(1))
        return out

    def _share(self, o: int, stretch: bytes) -> float:
        """Share of an item's words that stand in order in a stretch of text, or, where that is too little, of its pieces' words near each other; 0 where both are."""
        item, text = self.ids_of[o], np.frombuffer(stretch, self.kind)
        at = np.flatnonzero(self.place[o, text])  # other words are in no common subsequence
        own = text[at]
        found = lcs(item, own)
        if found < self.need[o]:
            found = sum(max(lcs(piece, own[(at >= t) & (at < t + 4 * BLOCK)]) for t in range(0, max(1, len(text) - 2 * BLOCK), BLOCK)) for piece in pieces(item))
        return found / len(item) if found >= self.need[o] else 0.0


def pieces(item: list[int]) -> list[list[int]]:
    """An item in pieces of a passage's length; a last one of less than half of it belongs to the one before."""
    cuts = list(range(0, len(item), 2 * BLOCK))
    if len(cuts) > 1 and len(item) - cuts[-1] < BLOCK:
        cuts.pop()
    return [item[a:b] for a, b in zip(cuts, [*cuts[1:], len(item)], strict=True)]


def search(tokens: DataFrame, items: list[tuple[int, list[int]]], latent: Latent, settings: Settings) -> DataFrame:
    """(k, item_id, overlap, cosine): documents that hold an item, with the largest share of its words found and the best cosine of the passages that led to it."""
    ids_of, kind = [ids for _, ids in items], id_type(len(latent.idf) + 1)

    def run(batches):
        block = _Items(ids_of, latent, settings)
        for batch in batches:
            for keys, ids, lens in _slices(batch, kind):
                p = _Passages(ids, lens)
                if not len(p.begin):
                    continue
                starts = (np.cumsum(lens) - lens)[p.docs]
                ends = starts + lens[p.docs]
                best: dict[tuple[int, int], tuple[float, float]] = {}
                enough = block.enough_words(p)
                some = np.unique(enough // len(items))
                for w, o, s in block.candidates(_unit(p.project(latent.vectors)[some])):
                    w = some[w]
                    sure = np.isin(w * len(items) + o, enough)
                    w, o, s = w[sure], o[sure], s[sure]
                    around = block.words[o] + BLOCK
                    lo, hi = np.maximum(starts[p.doc[w]], p.begin[w] - around), np.minimum(ends[p.doc[w]], p.begin[w] + 2 * BLOCK + around)
                    sure = np.flatnonzero(block.holds_item(ids, lo, hi, o))
                    for d, i, a, b, c in zip(p.doc[w[sure]].tolist(), o[sure].tolist(), lo[sure].tolist(), hi[sure].tolist(), s[sure].tolist(), strict=True):
                        if share := block.share(i, ids[a:b].tobytes()):
                            had = best.get((d, i), (0.0, 0.0))
                            best[d, i] = max(share, had[0]), max(c, had[1])
                if best:
                    out = [(keys[int(p.docs[d])].as_py(), items[i][0], *found) for (d, i), found in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (keys.type, pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["k", "item_id", "overlap", "cosine"])

    return tokens.mapInArrow(run, f"k {tokens.schema['k'].dataType.simpleString()}, item_id long, overlap double, cosine double")


def _passes(items: list[tuple[int, list[int]]], most: int, words: int = 100_000):
    """Runs of at most `most` items and about as many words: what a task holds of the items at once."""
    part, size = [], 0
    for item in items:
        if part and (len(part) == most or size + len(item[1]) > words):
            yield part
            part, size = [], 0
        part.append(item)
        size += len(item[1])
    yield part


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, item_id, overlap, cosine): a row for each document and each benchmark item that it holds; clean documents have none.

    Items without words (null or empty texts) are held by nothing, and an item of fewer words than a passage is sought
    whole; of items that are alike in number and text one is sought. Null and empty documents are clean; documents of any length are
    searched whole, in slices of bounded size; documents with a null key are reported under a null key; repeated rows each give
    their rows; an empty table or benchmark gives none; other columns aren't read.

    The benchmark streams through the driver in the order of its items. Items share a vocabulary and a space as long as they have at
    most MOST_TERMS distinct words; those that follow are the next part, which has its own (an item of more words alone is a part by itself). A part's
    items are searched for in blocks of `items`, one pass over the tokenised corpus each. The corpus is never collected.
    """
    schema = f"k {df.schema[key].dataType.simpleString()}, item_id long, overlap double, cosine double"
    listed = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    found = [hits for part in _parts(listed) for hits in _found(df, part, key, text, settings)]
    return (reduce(DataFrame.union, found) if found else df.sparkSession.createDataFrame([], schema)).withColumnRenamed("k", key)


def _parts(listed: DataFrame, most: int | None = None):
    """Runs of items (number, words) with at most `most` distinct words, MOST_TERMS by default, from rows that are streamed partition by partition."""
    part, held = [], set()
    for r in listed.orderBy("i", "t").toLocalIterator():
        split = words(r["t"])
        if not split:
            continue
        if part and len(held) + len(set(split) - held) > (most or MOST_TERMS):
            yield part
            part, held = [], set()
        part.append((r["i"], split))
        held.update(split)
    if part:
        yield part


def _found(df: DataFrame, split: list[tuple[int, list[str]]], key: str, text: str, settings: Settings) -> list[DataFrame]:
    """What contaminated() gives of the items of one part, a table for each pass."""
    vocabulary = {w: n + 1 for n, w in enumerate(sorted({w for _, ws in split for w in ws}))}
    items = [(i, [vocabulary[w] for w in ws]) for i, ws in split]
    tokens, counts, blocks = tokenise(df, vocabulary, key, text)
    latent = latent_space(tokens, counts, blocks, settings.rank)
    passes = _passes(items, min(settings.items, max(1, (1 << 24) // len(vocabulary))))
    found = [written(search(tokens, part, latent, settings), "hits") for part in passes]
    drop_written(tokens)
    return found
