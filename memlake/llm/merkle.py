"""Merkle manifest of a dataset: a ternary tree over each source's documents, and one over the sources' roots.

Leaves are ranked within their source by a range sort whose partitions' counts give offsets, so that a source of any size
is dealt over many tasks. Positions fall in aligned blocks of 3 ** HEIGHT leaves. Of each block a task first makes the root
with a stack of one partial run for each level; block roots are the leaves of the next tree up, until one node is left,
so upper trees are distributed as the lowest one is. A second pass over a block is a fractal traversal: at each of a few
heights an existing subtree holds the nodes beside the current path, and the desired one, next to the right, grows
by one leaf a step, so that it is whole when the path enters it. Each leaf's path is emitted at once and the upper
proof, which came with the block, is appended.

Nulls stand as `-` in a leaf; a null source is a source of its own, before all others; rows without a doc_id come before
those with one and are never tampered with. Rows of one source that share a doc_id are ordered by their leaves; repeated
rows are leaves of their own with the same digest, at neighbouring places. Empty and long texts are hashed whole by
Spark. Other columns aren't read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from memlake.llm._shared import written

FAN = 3
HEIGHT, PART = 6, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l:string,r:string>>"
_PATH_TYPE = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def digest(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row: SHA-256 of its fields, each a byte count, a colon and the value, or a dash; text: another text in place of its own."""

    def field(name):
        value = text if name == "text" and text is not None else F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(field(n) for n in FIELDS)).cast("binary"), 256)


# ---------------------------------------------------------------- one block


class Stack:
    """Makes nodes from leaves that come in order, with one partial run of nodes for each level; keep(level, index, node) sees all nodes."""

    def __init__(self, levels: int, keep=None):
        self.runs, self.done, self.keep = [[] for _ in range(levels + 1)], [0] * (levels + 1), keep

    def _put(self, level: int, node: str) -> None:
        if self.keep:
            self.keep(level, self.done[level], node)
        self.done[level] += 1
        self.runs[level].append(node)
        if level + 1 < len(self.runs) and len(self.runs[level]) == FAN:
            self._up(level)

    def _up(self, level: int) -> None:
        node = digest(self.runs[level])
        self.runs[level] = []
        self._put(level + 1, node)

    def add(self, node: str) -> None:
        self._put(0, node)

    def close(self) -> str:
        """The root, where the last runs of levels may be short."""
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                self._up(level)
        return self.runs[-1][0]


def levels_of(leaves: int, of: int, height: int = HEIGHT) -> int:
    """Levels above the leaves of a block: all where its tree has more blocks, else until one node is left."""
    if of > FAN**height:
        return height
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // FAN), n + 1
    return n


class Subtree:
    """The nodes of levels low up to high - 1 under node `root` of level high; grows leaf by leaf."""

    def __init__(self, low: int, high: int, root: int, leaves: int):
        self.root, self.nodes = root, {}
        self.begin = self.next = root * FAN**high
        self.stop = min((root + 1) * FAN**high, leaves)
        self.first = [root * FAN ** (high - level) for level in range(high + 1)]
        self.stack = Stack(high, lambda level, i, node: self.nodes.__setitem__((level, self.first[level] + i), node) if low <= level < high else None)

    def grow(self, leaf_at, steps: int) -> None:
        for _ in range(min(steps, self.stop - self.next)):
            self.stack.add(leaf_at(self.next))
            self.next += 1
        if self.next >= self.stop and self.stack:
            if self.next > self.begin:
                self.stack.close()
            self.stack = None  # which refers to the subtree


def traverse(leaves: list[str], levels: int, part: int = PART):
    """The authentication path of each leaf in turn: for each level (left siblings, right siblings), joined.

    Beside the leaves, memory holds for each part of the height one existing and one desired subtree of FAN ** part
    leaves' worth of nodes and a stack. A step feeds one leaf to each desired subtree.
    """
    n, at = len(leaves), leaves.__getitem__
    bounds = [(low, min(low + part, levels)) for low in range(0, levels, part)]
    exist = []
    for low, high in bounds:
        tree = Subtree(low, high, 0, n)
        tree.grow(at, n)
        exist.append(tree)
    desired = [Subtree(low, high, 1, n) for low, high in bounds]
    sizes = [n]
    for _ in range(levels):
        sizes.append(-(-sizes[-1] // FAN))
    for i in range(n):
        path, place = [], i
        for (low, high), tree in zip(bounds, exist, strict=True):
            for level in range(low, high):
                run = place - place % FAN
                nodes = tree.nodes
                path.append(("".join(nodes[level, j] for j in range(run, place)), "".join(nodes[level, j] for j in range(place + 1, min(run + FAN, sizes[level])))))
                place //= FAN
        yield path
        for k, (low, high) in enumerate(bounds):
            desired[k].grow(at, 1)
            if (i + 1) % FAN**high == 0:
                exist[k], desired[k] = desired[k], Subtree(low, high, desired[k].root + 1, n)


def fold(node: str, path) -> str:
    for left, right in path:
        node = digest((left, node, right))
    return node


# ---------------------------------------------------------------- ranks, block roots, proofs


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with pos, the place of a row in its group by order, and n, the group's size.

    Rows are range-partitioned by (group, order) and written, which fixes the partitions; a partition's rows of a group are
    numbered as they stream, and counts by (partition, group), few however long a group is, give the offsets.
    """
    names = [*df.columns, "_part", "_i"]
    at = df.columns.index(group)

    def run(batches):
        key, i = None, 0
        for batch in batches:
            parts, places = [], []
            for k in batch.column(at).to_pylist():
                i = i + 1 if k == key else 0
                key = k
                places.append(i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "_i"])

    sort = [F.col(group), *(F.col(c).asc_nulls_first() for c in order)]
    rows = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id())
    rows = written(rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _i long").select(names), "ranked")
    counts = written(rows.groupBy(group, "_part").agg(F.count("*").alias("_c")), "counts")
    w = Window.partitionBy(group)
    offsets = counts.select(group, "_part", (F.sum("_c").over(w.orderBy("_part")) - F.col("_c")).alias("_from"), F.sum("_c").over(w).alias("n"))
    return rows.join(offsets, [group, "_part"]).withColumn("pos", F.col("_from") + F.col("_i")).drop("_part", "_i", "_from")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FAN**height}"))


def _streamed(batches, columns):
    """Rows of each (group, block) in turn, from batches that are sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[:2] != key:
                if rows:
                    yield rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def block_roots(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(grp, pos, node, n, size): of nodes (grp, pos, node, n) each block's root, its place among the group's, their number, and the number of nodes."""

    def run(batches):
        for rows in _streamed(batches, ("grp", "block", "node", "n")):
            n = rows[0][3]
            stack = Stack(levels_of(len(rows), n, height))
            for row in rows:
                stack.add(row[2])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (rows[0][0], rows[0][1], stack.close(), -(-n // FAN**height), n)], names=["grp", "pos", "node", "n", "size"])

    rows = _blocks(nodes, height).select("grp", "block", "pos", "node", "n").repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    return rows.mapInArrow(run, "grp string, pos long, node string, n long, size long")


def _with_headers(nodes: DataFrame, headers: DataFrame, height: int, *more: str) -> DataFrame:
    """Rows of each block in order behind a row that holds the block's upper proof; one partition holds a block."""
    rows = _blocks(nodes, height).select("grp", "block", "pos", "node", *more, F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast("string").alias("root"))
    head = headers.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "root", "n")
    return rows.withColumn("n", F.lit(None).cast("long")).unionByName(head, allowMissingColumns=True).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _as_pairs(path) -> list[tuple[str, str]]:
    return [(x["l"], x["r"]) for x in path or ()]


def proofs(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(grp, pos, path, root): of nodes (grp, pos, node, n) the path up to the group's root, and that root."""
    upper = headers(nodes, height)

    def run(batches):
        for rows in _streamed(batches, ("grp", "block", "node", "pos", "path", "root", "n")):
            head, rows = rows[0], rows[1:]
            above = _as_pairs(head[4])
            paths = traverse([r[2] for r in rows], levels_of(len(rows), head[6], height))
            made = [[{"l": a, "r": b} for a, b in [*p, *above]] for p in paths]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[3] for r in rows]), pa.array(made, _PATH_TYPE), pa.array([head[5]] * len(rows))], names=["grp", "pos", "path", "root"])

    return _with_headers(nodes, upper, height).mapInArrow(run, f"grp string, pos long, path {_PATH}, root string")


def headers(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(grp, pos, path, root, n): for each block of nodes the path of its root up to the group's root, and the group's number of nodes.

    One tree of blocks after another until each group has one; their number is the logarithm of the largest group.
    """
    roots = written(block_roots(nodes, height), "roots")
    if roots.where("n > 1").isEmpty():
        return roots.select("grp", "pos", F.array().cast(_PATH).alias("path"), F.col("node").alias("root"), F.col("size").alias("n"))
    return written(proofs(roots, height).join(roots.select("grp", "pos", F.col("size").alias("n")), ["grp", "pos"]), "headers")


# ---------------------------------------------------------------- the manifest


def group_key(source: str = "source") -> Column:
    """The source as a key that orders null first and else bytewise."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def tampered(key: str = "doc_id") -> Column:
    """Rows whose text loses its line feeds: where 2 divides the CRC-32 of the key as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0, F.lit(False))


def manifest(documents: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(source, doc_id, pos, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Texts are hashed where they are read, so that shuffles carry digests alone. folded_root is folded from the leaf of the
    tampered text, where the row is tampered with, and the untampered siblings.
    """
    text = F.col("text").cast("string")
    other = F.when(tampered() & F.contains(text, F.lit("\n")), leaf(F.replace(text, F.lit("\n"), F.lit(""))))
    rows = documents.select(group_key().alias("grp"), "doc_id", leaf().alias("node"), other.alias("other"))
    nodes = ranked(rows, "grp", ["doc_id", "node"])
    lower = headers(nodes, height)
    subroots = ranked(lower.where("pos = 0").select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("root").alias("node")), "grp", ["of"])
    top = proofs(subroots, height).join(subroots.select("grp", "pos", "of"), ["grp", "pos"])
    upper = top.select(F.col("of").alias("grp"), F.col("path").alias("top"), F.col("root").alias("all"))
    # A header's root names both: the source's own and that of all.
    both = lower.join(upper, "grp").select("grp", "pos", F.concat("path", "top").alias("path"), F.concat("root", "all").alias("root"), "n")
    key = documents.schema["doc_id"].dataType
    kinds = [pa.string(), to_arrow_type(key), pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def run(batches):
        for rows in _streamed(batches, ("grp", "block", "node", "pos", "path", "root", "n", "doc_id", "other")):
            head, rows = rows[0], rows[1:]
            above, subroot, root = _as_pairs(head[4]), head[5][:64], head[5][64:]
            rest = "".join(a + b for a, b in above)
            level_count = levels_of(len(rows), head[6], height)
            made = []
            for r, path in zip(rows, traverse([r[2] for r in rows], level_count), strict=True):
                folded = fold(fold(r[8] or r[2], path), above)
                made.append((r[0][1:] if r[0] else None, r[7], r[3], r[2], subroot, root, digest((*(a + b for a, b in path), rest)), folded, folded == root))
            names = ["source", "doc_id", "pos", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    return _with_headers(nodes, both, height, "doc_id", "other").mapInArrow(run, f"source string, doc_id {key.simpleString()}, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
