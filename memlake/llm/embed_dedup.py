"""Embedding near-duplicates by an exact metric range join.

Unit vectors under Euclidean distance, where cosine >= c means distance <= r = sqrt(2 - 2c). Pivots partition the
vectors by nearest pivot. By the triangle inequality a vector x of cell i can have a partner in cell j only if
d(x,pj) <= d(x,pi) + 2r, and in Euclidean space only if x lies within r of the plane between the two pivots: such
boundary vectors are copied to cell j. A pair of two cells is met in the one of lower number alone, so copies go
downwards only. Cells join independently, cut into blocks whose sizes are bounded.

A task holds one block of home vectors and streams its guests. It gives sums of links for each vector and a
spanning forest of the links, never all pairs: what it writes is in proportion to the vectors it reads.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm._shared import connected_components, drop_written, written


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of unit length in double precision; shorter vectors are padded with zeros."""
    flat, lens = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if len(lens) and (lens == dims).all():
        out = flat.reshape(-1, dims).copy()
    else:
        out = np.zeros((len(lens), dims))
        out[np.arange(dims) < lens[:, None]] = flat
    return out / np.maximum(np.linalg.norm(out / np.maximum(np.abs(out).max(1, initial=0, keepdims=True), 1e-300), axis=1, keepdims=True) * np.maximum(np.abs(out).max(1, initial=0, keepdims=True), 1e-300), 1e-300)


def assign(reps: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """(rep, n, v, home, guests): the nearest pivot, and the lower cells that the vector may have partners in."""
    between = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), pivots.shape[1])
            square = np.maximum(0.0, 2 - 2 * x @ pivots.T)
            home = square.argmin(1)
            d, own = np.sqrt(square), np.arange(len(x))
            slack = 1e-7  # above the error of distances near 0, the root of the dot products' own
            near = d <= d[own, home][:, None] + 2 * radius + slack
            near &= square - square[own, home][:, None] <= 2 * between[home] * radius + slack
            near &= np.arange(len(pivots)) < home[:, None]
            guests = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(near.sum(1))].astype(np.int32)), pa.array(np.nonzero(near)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), batch.column("v"), pa.array(home.astype(np.int32)), guests], names=["rep", "n", "v", "home", "guests"])

    return reps.select("rep", "n", "v").mapInArrow(run, f"rep long, n long, v {reps.schema['v'].dataType.simpleString()}, home int, guests array<int>")


class _Block:
    """One block of home vectors and the links found so far."""

    def __init__(self, reps, sizes, x, own: bool):
        self.reps, self.sizes, self.x, self.x32, self.own = reps, sizes, x, x.astype(np.float32), own
        self.links, self.label = np.zeros(len(reps), np.int64), np.arange(len(reps))

    def meet(self, reps, sizes, x, cosine: float, same: bool = False):
        """Count links with guests (or among the home vectors); gives the guests' sums and one edge for each linked guest."""
        added, edge_a, edge_b = np.zeros(len(reps), np.int64), [], []
        for a in range(0, len(reps), 512):
            y = x[a : a + 512]
            h, g = np.nonzero(self.x32 @ y.astype(np.float32).T >= np.float32(cosine - 1e-4))
            sure = np.einsum("ij,ij->i", self.x[h], y[g]) >= cosine
            h, g = h[sure], g[sure] + a
            if same:
                h, g = h[h < g], g[h < g]
            if not len(h):
                continue
            self.links += np.bincount(h, weights=sizes[g], minlength=len(self.reps)).astype(np.int64)
            added += np.bincount(g, weights=self.sizes[h], minlength=len(reps)).astype(np.int64)
            if same:
                self._join(h, g, None)
            else:
                order = np.argsort(g, kind="stable")
                h, g = h[order], g[order]
                first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                edge_a.append(reps[g[first]]), edge_b.append(self.reps[h[first]])
                self._join(h, np.repeat(h[first], np.diff(np.r_[first, len(h)])), None)
        return added, np.concatenate(edge_a) if edge_a else reps[:0], np.concatenate(edge_b) if edge_b else reps[:0]

    def _join(self, a, b, _):
        while True:
            low = np.minimum(self.label[a], self.label[b])
            before = self.label.copy()
            np.minimum.at(self.label, self.label[a], low)
            np.minimum.at(self.label, self.label[b], low)
            self.label = self.label[self.label]
            if (before == self.label).all() and (self.label[a] == self.label[b]).all():
                return


def block_join(rows: DataFrame, cosine: float, dims: int) -> DataFrame:
    """Links within blocks: rows (key, own, role, rep, n, v) come sorted by key and role, homes (0) before guests (1); gives (rep, links, other), other null in sums."""

    def out(reps, links, other=None):
        other = pa.nulls(len(reps), pa.int64()) if other is None else pa.array(other)
        return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.asarray(links, np.int64)), other], names=["rep", "links", "other"])

    def finish(block):
        if block is not None:
            some = block.links > 0
            yield out(block.reps[some], block.links[some])
            tree = block.label != np.arange(len(block.reps))
            yield out(block.reps[tree], np.zeros(int(tree.sum())), block.reps[block.label[tree]])

    def run(batches):
        key, block, homes = None, None, []

        def close_homes():
            reps, sizes, x = (np.concatenate(c) for c in zip(*[h[:3] for h in homes], strict=True))
            made = _Block(reps, sizes, x, homes[0][3])
            if made.own:
                made.links += made.meet(reps, sizes, x, cosine, same=True)[0]
            return made

        for batch in batches:
            keys, roles = batch.column("key").to_numpy(), batch.column("role").to_numpy()
            reps, sizes, own, x = batch.column("rep").to_numpy(), batch.column("n").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False), _matrix(batch.column("v"), dims)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])])
            for a, b in zip(cuts, np.r_[cuts[1:], len(keys)], strict=True):
                if keys[a] != key:
                    if homes:
                        block, homes = close_homes(), []
                    yield from finish(block)
                    key, block = keys[a], None
                if roles[a] == 0:
                    homes.append((reps[a:b], sizes[a:b], x[a:b], bool(own[a])))
                    continue
                if homes:
                    block, homes = close_homes(), []
                if block is not None:
                    added, ea, eb = block.meet(reps[a:b], sizes[a:b], x[a:b], cosine)
                    yield out(reps[a:b][added > 0], added[added > 0])
                    yield out(ea, np.zeros(len(ea)), eb)
        if homes:
            block = close_homes()
        yield from finish(block)

    return rows.mapInArrow(run, "rep long, links long, other long")


def components(df: DataFrame, cosine: float = 0.95, key: str = "vec_id", vector: str = "embedding", cell: int = 4000, max_pivots: int = 1024, block: int = 2048, guests: int = 32768) -> DataFrame:
    """(key, n_links, component_id, kept) of every row, exactly, by links of cosine >= `cosine` in double precision.

    Pivots: one for each `cell` distinct vectors, 8 to max_pivots, chosen by hash; they alone are sent to all tasks.
    Equal vectors are one class, compared once and counted as often as they occur, whatever their keys. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing; shorter vectors count as padded with zeros.
    Rows with a null key are compared as any others, but name no component: one of null keys alone has a null component_id, whose
    rows are all kept. Repeated rows each give a row and count as others; an empty table gives none; other columns aren't read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    sound = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    classes = written(rows.where(sound).groupBy("v").agg(F.min("k").alias("least"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    total, dims = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    alone = rows.where(~sound).select(F.col("k").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return alone
    wanted = min(max_pivots, max(8, math.ceil(total / cell)))
    picked = classes.orderBy(F.xxhash64("v"), "least", "rep").limit(wanted).select("v").toArrow().column("v").combine_chunks()
    pivots = _matrix(picked if isinstance(picked, pa.Array) else picked.chunk(0), dims)
    placed = written(assign(classes, pivots, math.sqrt(2 - 2 * cosine)), "placed")
    # At most max_pivots rows.
    size = {r["c"]: (r["h"], r["g"]) for r in placed.select(F.explode(F.concat(F.array(F.struct(F.col("home").alias("c"), F.lit(1).alias("o"))), F.transform("guests", lambda c: F.struct(c.alias("c"), F.lit(0).alias("o"))))).alias("x")).groupBy("x.c").agg(F.sum("x.o").alias("h"), F.sum(1 - F.col("x.o")).alias("g")).collect()}
    blocks = {c: max(1, math.ceil(h / block)) for c, (h, g) in size.items()}
    parts = {c: max(1, math.ceil((g + (h if blocks[c] > 1 else 0)) / guests)) for c, (h, g) in size.items()}
    # Literal arrays by the cell's number: an element costs the same whatever it is.
    table = lambda m: (lambda a: lambda c: F.element_at(a, c.cast("int") + 1))(F.lit([m.get(c, 1) for c in range(len(pivots))]))
    nb, ng = table(blocks), table(parts)
    at = lambda c, b, g, role: F.struct(c.alias("c"), b.cast("int").alias("b"), g.cast("int").alias("g"), F.lit(role).alias("role"))
    salt = F.xxhash64("rep")
    mine, part = F.pmod(salt, nb(F.col("home"))), lambda c: F.pmod(F.shiftright(salt, 32), ng(c))
    as_home = F.transform(F.sequence(F.lit(0), ng(F.col("home")) - 1), lambda g: at(F.col("home"), mine, g, 0))
    as_later = F.transform(F.filter(F.sequence(F.lit(0), nb(F.col("home")) - 1), lambda b: b < mine), lambda b: at(F.col("home"), b, part(F.col("home")), 1))
    as_guest = F.flatten(F.transform("guests", lambda c: F.transform(F.sequence(F.lit(0), nb(c) - 1), lambda b: at(c, b, part(c), 1))))
    dealt = placed.select("rep", "n", "v", F.explode(F.concat(as_home, as_later, as_guest)).alias("x"))
    unit = (F.col("x.c").cast("long") * (1 << 40) + F.col("x.b").cast("long") * (1 << 20) + F.col("x.g")).alias("key")
    dealt = dealt.select(unit, (F.col("x.g") == 0).alias("own"), F.col("x.role").alias("role"), "rep", "n", "v")
    found = written(block_join(dealt.repartition("key").sortWithinPartitions("key", "role"), cosine, dims), "found")
    links = written(found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links")), "sums")
    comp = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    of = classes.select("rep", "least", "v", "n").join(links, "rep", "left").join(comp, "rep", "left")
    of = written(of.select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "of")
    least = written(of.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    known = written(of.join(least, "component").select("v", "n_links", "component_id"), "known")
    drop_written(placed, found, links, classes, of, least)
    linked = rows.where(sound).join(known, "v").select(F.col("k").alias(key), "n_links", "component_id")
    return linked.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))).union(alone)
