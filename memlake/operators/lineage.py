"""Walks over references between rows: the root and depth of chains by pointer doubling, and neighbours by frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.sources.scratch import written


def chains(rows: DataFrame, key: str, previous: str) -> DataFrame:
    """(key, root, depth): where each row's chain of `previous` ends, and how many steps away that is.

    Every round doubles how far a row has looked, so rounds are the logarithm of the longest chain. A reference to a key that
    is not there ends the chain before it. Rows without a key are left out, of repeated keys one counts; a circle of references raises an error.
    """
    keys = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(previous).alias("p"))
    known = keys.select(F.col("k").alias("p"), F.lit(1).alias("there"))
    at = keys.join(known, "p", "left").select("k", F.when(F.col("there").isNotNull(), F.col("p")).alias("p"))
    # to: the farthest row seen so far; done where it is the root.
    at = written(at.select("k", F.coalesce("p", "k").alias("to"), F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), F.col("p").isNull().alias("done")), "chains")
    limit = at.count().bit_length() + 1
    # Only rows that moved are written again: of most chains few rounds are left.
    ended, rest = at.where("done"), at.where("not done")
    while not rest.isEmpty():
        limit -= 1
        if limit == 0:
            raise ValueError(f"{previous} runs in a circle")
        step = ended.unionByName(rest).select(F.col("k").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("done").alias("end"))
        moved = written(rest.join(step, "to").select("k", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("done")), "chains")
        ended, rest = ended.unionByName(moved.where("done")), moved.where("not done")
    return ended.select(F.col("k").alias(key), F.col("to").alias("root"), "depth")


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int, src: str = "src", dst: str = "dst", seed: str = "node") -> DataFrame:
    """(node, hops): the nodes within `hops` steps of a seed along edges in either direction, and the fewest steps to each.

    Each hop joins the newest nodes alone to the edges. Edges with a null end and null seeds count for nothing.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(dst, src)).where("a is not null and b is not null").distinct()
    both = written(both, "edges")
    seen = written(seeds.select(F.col(seed).alias("node")).where("node is not null").distinct().withColumn("hops", F.lit(0)), "seen")
    newest = seen
    for h in range(1, hops + 1):
        reached = newest.select(F.col("node").alias("a")).join(both, "a").select(F.col("b").alias("node")).distinct()
        newest = written(reached.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(h)), "frontier")
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return seen
