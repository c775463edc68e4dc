"""Windows in event time, for tables and for streams alike.

A stream needs a watermark: how late a row may be. Rows later than that are dropped, and windows that lie before it are
emitted and their state given up. A table has no watermark, and all its rows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time: str, late: str | None) -> DataFrame:
    return df.withWatermark(time, late) if late is not None else df


def _flat(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *(c for c in df.columns if c not in (*by, "_w")))


def tumbling(df: DataFrame, time: str, width: str, by: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    """(by, window_start, window_end, aggregates): a row for each key and window of `width` that holds rows; rows without a time are in none."""
    return _flat(_late(df, time, late).groupBy(*by, F.window(time, width).alias("_w")).agg(*aggregates), by)


def sliding(df: DataFrame, time: str, width: str, step: str, by: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    """The same for windows of `width` that begin every `step`; a row counts in each window that holds it."""
    return _flat(_late(df, time, late).groupBy(*by, F.window(time, width, step).alias("_w")).agg(*aggregates), by)


def sessions(df: DataFrame, time: str, gap: str, by: list[str], *aggregates: Column, late: str | None = None) -> DataFrame:
    """The same for sessions: a key's rows of which each is at most `gap` after the one before. window_end is the last row's time and the gap."""
    return _flat(_late(df, time, late).groupBy(*by, F.session_window(time, gap).alias("_w")).agg(*aggregates), by)
