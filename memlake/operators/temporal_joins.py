"""As-of and interval joins without range comparisons between rows of both sides.

An as-of join puts both sides in one order and carries the last right row forward. Time is cut in slices, so that a key
that holds much of the data is dealt over many tasks: a slice is walked by itself, and what comes into it is the last
right row of the slices before, of which there is one row for each key and slice. An interval join cuts intervals into
the nodes of a tree over time (units, runs of FAN units, runs of those, ...) and points into the one node of each level
that holds them; nodes are joined by equality. An interval has a few dozen nodes whatever its length, and two rows
never meet unless the point lies in the node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 32


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, columns: list[str], tie: str, slice_micros: int = 86_400_000_000) -> DataFrame:
    """left with `columns` of the last row of right with equal `on` whose `at` is not after the left row's, nulls where there is none.

    `at` is a timestamp of both sides; of right rows at one moment the one with the largest `tie` counts, and right rows come
    before left ones. Rows of left whose key or time is null stay, with nulls; such rows of right match nothing. Nulls in `columns` are values of their row.
    """
    taken = F.struct(*columns)
    sliced = lambda df: df.withColumns({"_t": micros(F.col(at)), "_slice": F.floor(micros(F.col(at)) / slice_micros)})
    known = F.lit(True)
    for c in [*on, at]:
        known = known & F.col(c).isNotNull()
    r = sliced(right.where(known)).select(*on, "_t", "_slice", F.col(tie).alias("_tie"), taken.alias("_right"))
    l = sliced(left.where(known)).withColumn("_left", F.struct(*left.columns)).select(*on, "_t", "_slice", "_left")
    # What comes into each slice of a key: the last right row of its earlier slices.
    last = r.groupBy(*on, "_slice").agg(F.max_by("_right", F.struct("_t", "_tie")).alias("_last"))
    slices = last.unionByName(l.select(*on, "_slice").distinct(), allowMissingColumns=True).groupBy(*on, "_slice").agg(F.first("_last", ignorenulls=True).alias("_last"))
    before = Window.partitionBy(*on).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).select(*on, "_slice", "_carried")
    both = r.withColumn("_side", F.lit(0)).unionByName(l.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    walk = Window.partitionBy(*on, "_slice").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_right", ignorenulls=True).over(walk)).where("_side = 1").join(carried, [*on, "_slice"], "left")
    out = found.select("_left.*", F.coalesce("_found", "_carried").alias("_got")).select(*left.columns, *(F.col("_got")[c].alias(c) for c in columns))
    rest = left.where(~known).select(*left.columns, *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns))
    return out.unionByName(rest)


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, unit_micros: int = 60_000_000, levels: int = 6) -> DataFrame:
    """points joined to the intervals with equal `on` that hold them: start <= at < end; a null end is open, a null start or `at` matches nothing.

    Column names of both sides but for `on` must differ. Intervals may overlap and be of any length: above the last level, FAN ** (levels - 1) units, nodes
    are listed one by one (at the defaults a node there is 64 years).
    """
    horizon = points.agg(F.max(micros(F.col(at))).alias("m")).first()["m"]
    if horizon is None:
        horizon = 0
    begin, stop = micros(F.col(start)), F.coalesce(micros(F.col(end)), F.lit(horizon + 1))
    rows = intervals.where(F.col(start).isNotNull()).withColumns({"_a": begin, "_b": F.least(stop, F.lit(horizon + 1))}).where("_a < _b")
    # Whole units at the lowest level; the exact bounds are looked at once a point has met a node.
    rows = rows.withColumns({"_lo": F.floor(F.col("_a") / unit_micros), "_hi": F.floor((F.col("_b") - 1) / unit_micros) + 1})
    node = lambda level, lo, hi: F.transform(F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>")), lambda x: F.struct(F.lit(level).alias("level"), x.alias("node")))
    parts = []
    for level in range(levels):
        lo, hi = F.col("_lo"), F.col("_hi")
        if level == levels - 1:
            parts.append("_p_last")
            rows = rows.withColumn("_p_last", node(level, lo, hi))
            break
        # Up to the first and from the last whole node of the next level; all, where there is none between.
        up, down = F.ceil(lo / FAN), F.floor(hi / FAN)
        inner = up < down
        rows = rows.withColumns({"_inner": inner, "_up": up, "_down": down})
        ends = F.concat(node(level, lo, F.col("_up") * FAN), node(level, F.col("_down") * FAN, hi))
        rows = rows.withColumn(f"_p{level}", F.when(F.col("_inner"), ends).otherwise(node(level, lo, hi)))
        parts.append(f"_p{level}")
        # Where all is listed, nothing is left for the levels above.
        rows = rows.withColumns({"_lo": F.when(F.col("_inner"), F.col("_up")).otherwise(F.lit(0).cast("long")), "_hi": F.when(F.col("_inner"), F.col("_down")).otherwise(F.lit(0).cast("long"))})
    rows = rows.withColumn("_n", F.explode(F.concat(*parts))).select(*intervals.columns, "_a", "_b", "_n.level", "_n.node")
    t = points.where(F.col(at).isNotNull()).withColumn("_t", micros(F.col(at)))
    place = F.array(*(F.struct(F.lit(level).alias("level"), F.floor(F.col("_t") / (unit_micros * FAN**level)).alias("node")) for level in range(levels)))
    t = t.withColumn("_n", F.explode(place)).select(*points.columns, "_t", "_n.level", "_n.node")
    met = t.join(rows, [*on, "level", "node"]).where("_t >= _a and _t < _b")
    return met.select(*points.columns, *(c for c in intervals.columns if c not in on))
