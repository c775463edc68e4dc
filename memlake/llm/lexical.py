"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

The index is partitioned by documents, so a common term's postings are dealt over all shards. A shard is made by
the task that reads its documents, and is a row for each of its terms: blocks of BLOCK postings as varints of gaps and
impacts, with each block's first and last document and its greatest impact outside the compressed bytes. Impacts rest on
the collection's counts, which a first pass takes from all documents; a term's weight comes from its document
frequency in all shards at search time.

A search joins the questions' terms to the index, so only their postings are read further. A task takes a shard's
lists and runs each question over them: the pivot is the first document at which the lists' bounds reach the
threshold; shallow moves sum the greatest impacts of the blocks that hold it; blocks whose sum stays below are passed without
decompression. The threshold is the score of the k-th best so far, also of the shards that the task saw before. What
is left, at most k rows for each question and shard, is ranked by a window. Questions form groups of at most about
GROUP, which bounds what a task holds; nothing is collected or broadcast beyond Spark's own choice by size.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memlake.llm._shared import byte_slices, written

#: Terms are maximal runs of these; of letters only A to Z are lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK, SHARD_BYTES, SHARD_ROWS, GROUP = 64, 16 << 20, 50_000, 500
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def terms_column(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(PATTERN), 0)


# ---------------------------------------------------------------- shards


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, seven bits each, and where each value begins (and the last ends)."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for j in range(int(size.max(initial=0))):
        rows = size > j
        out[at[:-1][rows] + j] = (values[rows] >> (7 * j)) & 127 | np.where(size[rows] > j + 1, 128, 0)
    return out, at


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    ends = np.flatnonzero(last)
    begin = np.concatenate([[0], ends[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - np.repeat(begin, ends - begin + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, begin)


class _Numbers(defaultdict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Builder:
    """Gathers documents and gives a shard's rows."""

    def __init__(self, documents: int, total: int):
        self.documents, self.total = documents, total
        self.clear()

    def clear(self) -> None:
        self.numbers, self.keys, self.ids, self.bytes = _Numbers(), [], [], 0

    def add(self, key, text: bytes) -> None:
        words = terms(text)
        self.keys.append(key), self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.bytes += len(text)

    def batch(self, shard: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row for each term in order, behind one that lists the documents."""
        order = sorted(range(len(self.keys)), key=lambda i: (self.keys[i] is None, self.keys[i] if self.keys[i] is not None else 0))
        keys, ids, n = [self.keys[i] for i in order], [self.ids[i] for i in order], len(order)
        names = list(self.numbers)
        by_name = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        length = np.array([len(x) for x in ids], np.int64)
        cells, tf = np.unique(rank[np.concatenate(ids)] * n + np.repeat(np.arange(n), length) if names else np.zeros(0, np.int64), return_counts=True)
        term, doc = cells // n, cells % n
        weight = 100 - 75 + 75 * length * self.documents // max(1, self.total)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * weight[doc])
        df = np.bincount(term, minlength=len(names))
        place = np.arange(len(term)) - np.repeat(np.cumsum(df) - df, df)
        head = place % BLOCK == 0
        begin = np.flatnonzero(head)
        stop = np.append(begin[1:], len(term))
        gap = np.where(head, doc, np.diff(doc, prepend=0))
        data, at = varints(np.column_stack([gap, impact]).ravel())
        blocks = np.concatenate([[0], np.cumsum(-(-df // BLOCK))])
        first_byte = at[2 * np.concatenate([[0], np.cumsum(df)])]
        starts = at[2 * begin] - np.repeat(first_byte[:-1], np.diff(blocks))
        maxima = np.maximum.reduceat(impact, begin) if len(begin) else impact
        lists = lambda v: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], blocks]), pa.int32()), pa.array(v, pa.int32()))
        postings = pa.Array.from_buffers(pa.binary(), len(names) + 1, [None, pa.py_buffer(np.concatenate([[0], first_byte]).astype(np.int32)), pa.py_buffer(data)])
        documents = pa.array([keys] + [None] * len(names), schema.field("documents").type)
        words = pa.array([None] + [names[i].decode() for i in by_name], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(names) + 1, shard)), words, pa.array(np.concatenate([[0], df]), pa.int32()), lists(doc[begin]), lists(doc[stop - 1]), lists(maxima), lists(starts), postings, documents], schema=schema)


@dataclass
class Index:
    """rows: (shard, term, df, firsts, ends, maxima, starts, postings, documents), a written table; a shard's row without a term lists its documents."""

    rows: DataFrame
    documents: int


def build(df: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index the whole texts of all rows; null texts and texts without a term are in no list.

    Rows without a key and rows that repeat one are documents of their own. Two passes without a shuffle. A
    shard ends with SHARD_BYTES of text, or SHARD_ROWS rows, so memory is bounded by that or by one longer text. Other columns
    aren't read.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    n = F.regexp_count("t", F.lit(PATTERN)).cast("long")
    documents, total = rows.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    kind = df.schema[key].dataType
    array = pa.list_(pa.int32())
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("firsts", array), ("ends", array), ("maxima", array), ("starts", array), ("postings", pa.binary()), ("documents", pa.list_(to_arrow_type(kind)))])

    def run(batches):
        made, number = Builder(documents, total), count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for a, b in byte_slices(batch.column(1)):
                cut = batch.slice(a, b - a)
                for k, t in zip(cut.column(0).to_pylist(), cut.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    made.add(k, t)
                    if made.bytes >= SHARD_BYTES or len(made.keys) >= SHARD_ROWS:
                        yield made.batch(next(number), schema)
                        made.clear()
        if made.keys:
            yield made.batch(next(number), schema)

    ddl = f"shard long, term string, df int, firsts array<int>, ends array<int>, maxima array<int>, starts array<int>, postings binary, documents array<{kind.simpleString()}>"
    return Index(written(rows.mapInArrow(run, ddl), "index"), documents)


# ---------------------------------------------------------------- Block-Max WAND


class Postings:
    """A term's list in a shard; a block is unpacked when a question first needs it, for all questions."""

    def __init__(self, df: int, firsts, ends, maxima, starts, data: bytes):
        self.df, self.data, self.starts = df, data, [*starts, len(data)]
        self.firsts, self.ends, self.maxima = (np.array(x, np.int64) for x in (firsts, ends, maxima))
        # Closed blocks stand as repeats of their last document, which keeps the order.
        self.docs, self.impacts = np.repeat(self.ends, BLOCK)[:df], np.zeros(df, np.int64)
        self.closed, self.top = np.ones(len(starts), bool), max(maxima)
        if len(starts) == 1:
            self.open(np.zeros(1, np.int64))

    def open(self, blocks: np.ndarray) -> None:
        """Unpack those of the blocks that are closed."""
        for b in blocks[self.closed[blocks]].tolist():
            values = unpack(self.data[self.starts[b] : self.starts[b + 1]])
            a = b * BLOCK
            self.docs[a : a + BLOCK], self.impacts[a : a + BLOCK] = np.cumsum(values[::2]), values[1::2]
            self.closed[b] = False

    def shallow(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each document the block that ends at or behind it and the greatest impact that the list can give it, without unpacking."""
        at = np.minimum(np.searchsorted(self.ends, docs), len(self.ends) - 1)
        return at, np.where((self.firsts[at] <= docs) & (docs <= self.ends[at]), self.maxima[at], 0)

    def exact(self, docs: np.ndarray) -> np.ndarray:
        """The list's impact for each document, from its unpacked blocks."""
        place = np.minimum(np.searchsorted(self.docs, docs), self.df - 1)
        return np.where(self.docs[place] == docs, self.impacts[place], 0)


def best(lists: list[tuple[Postings, int]], documents: int, k: int, floor: int = 1) -> list[tuple[int, int]]:
    """(score, document) of the k best of a shard with a score of at least floor; of equal scores the earlier documents.

    Lists are taken by their bounds, greatest first. The lists at the end whose bounds together stay below the threshold
    can't make a pivot by themselves, so pivots are documents of the lists before them; and of those only documents
    where the greatest impacts of the blocks around them reach the threshold, so blocks without one stay packed. Each
    list behind is then first moved shallowly, then exactly at the pivots that are left. All pivots of the shard
    move at once; the best ones of the first lists are scored before the rest, which sets the threshold.
    """
    lists = sorted(lists, key=lambda x: -x[1] * x[0].top)
    rest = np.cumsum([w * p.top for p, w in lists][::-1])[::-1]
    bound, change = np.zeros(documents, np.int64), np.zeros(documents + 1, np.int64)
    for p, w in lists:
        if len(p.ends) == 1:
            bound[p.docs] += p.impacts * w
        else:
            change[p.firsts] += p.maxima * w
            change[p.ends + 1] -= p.maxima * w
    bound += np.cumsum(change[:-1])
    least, partial, done = max(1, floor), np.zeros(documents, np.int64), 0

    def take(p, w, possible):
        before = np.concatenate([[0], np.cumsum(possible)])
        p.open(np.flatnonzero(before[p.ends + 1] > before[p.firsts]))
        partial[p.docs] += p.impacts * w  # of packed blocks nothing

    def scored(docs, sums, after):
        """Full scores of the pivots that can reach the threshold."""
        moved = [p.shallow(docs) for p, _ in lists[after:]]
        more = np.array([m * w for (_, m), (_, w) in zip(moved, lists[after:], strict=True)]).reshape(len(lists) - after, len(docs))
        left = np.arange(len(docs))
        open_sum = more.sum(0)
        for j, (p, w) in enumerate(lists[after:]):
            left = left[sums[left] + open_sum[left] >= least]
            if not len(left):
                break
            p.open(np.unique(moved[j][0][left[more[j, left] > 0]]))
            sums[left] += p.exact(docs[left]) * w
            open_sum[left] -= more[j, left]
        left = left[sums[left] >= least]
        return docs[left], sums[left]

    possible = bound >= least
    while done < len(lists) and np.count_nonzero(partial) < k:
        take(*lists[done], possible)
        done += 1
    docs = np.flatnonzero(partial)
    if len(docs) >= k:
        docs = docs[np.argpartition(-partial[docs], min(4 * k, len(docs)) - 1)[: 4 * k]]
        first = scored(docs, partial[docs], done)[1]
        if len(first) >= k:
            least = max(least, int(np.sort(first)[-k]))
    possible = bound >= least
    while done < len(lists) and rest[done] >= least:
        take(*lists[done], possible)
        done += 1
    docs = np.flatnonzero(possible & (partial > 0))
    docs, scores = scored(docs, partial[docs], done)
    order = np.lexsort((docs, -scores))[:k]
    return list(zip(scores[order].tolist(), docs[order].tolist(), strict=True))


# ---------------------------------------------------------------- search


def search(index: Index, questions: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, rank, doc_id, score): each question's k best documents with a score above 0, of equal scores those with the smaller key, null last.

    Questions without a term, and null texts, find nothing. Repeated questions (equal in key and text) count once; those
    that share a key but not the text are ranked apart. Other columns aren't read; empty tables give no rows.
    """
    asked = questions.select(F.col(key).alias("q"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).distinct()
    asked = written(asked.withColumn("item", F.monotonically_increasing_id()), "questions")
    groups = -(-max(1, asked.count()) // GROUP)
    words = asked.select("item", F.pmod(F.xxhash64("item"), F.lit(groups)).alias("group"), F.explode(terms_column(F.col("t"))).alias("term")).groupBy("group", "item", "term").agg(F.count("*").alias("repeats"))
    words = written(words, "words")
    names = words.select("term").distinct()
    hits = index.rows.join(names, "term")
    weight = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2.0 * F.col("n") + 1))).cast("long")
    weights = hits.groupBy("term").agg(F.sum("df").alias("n")).select("term", weight.alias("w")).where("w > 0")
    holders = words.groupBy("group", "term").agg(F.collect_list(F.struct("item", "repeats")).alias("holders")).join(weights, "term")
    lists = ["df", "firsts", "ends", "maxima", "starts", "postings"]
    rows = hits.join(holders, "term").select("group", "shard", "term", "w", "holders", *lists, F.lit(None).cast(index.rows.schema["documents"].dataType).alias("documents"))
    heads = index.rows.where("term is null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "shard", "documents")
    rows = rows.unionByName(heads, allowMissingColumns=True).repartition("group", "shard").sortWithinPartitions("group", "shard", "term")
    kind = index.rows.schema["documents"].dataType.elementType
    out_kind = to_arrow_type(kind)

    def run(batches):
        floors: dict[int, list[int]] = {}  # of each question the best scores of earlier shards

        def found(documents, held):
            of = defaultdict(list)
            for w, holders, postings in held:
                for h in holders:
                    of[h["item"]].append((postings, w * h["repeats"]))
            rows = []
            for item, parts in of.items():
                seen = floors.setdefault(item, [])
                for score, doc in best(parts, len(documents), k, seen[0] if len(seen) == k else 1):
                    rows.append((item, documents[doc], score))
                    (heapq.heappush if len(seen) < k else heapq.heappushpop)(seen, score)
            items, docs, scores = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(docs, out_kind), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

        documents, held = None, []
        for batch in batches:
            shown = batch.column("documents").is_valid().to_pylist()
            for i, head in enumerate(shown):
                cell = lambda name: batch.column(name)[i].as_py()  # noqa: B023, E731
                if head:
                    if held:
                        yield found(documents, held)
                    documents, held = cell("documents"), []
                else:
                    held.append((cell("w"), cell("holders"), Postings(*(cell(c) for c in lists))))
        if held:
            yield found(documents, held)

    scored = rows.mapInArrow(run, f"item long, doc_id {kind.simpleString()}, score long")
    best_first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = scored.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return top.join(asked.select("item", "q"), "item").select(F.col("q").alias(key), "rank", "doc_id", "score")
