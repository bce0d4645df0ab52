"""Splitting an ordered stream into sessions and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seconds(ts: str | Column) -> Column:
    """A timestamp (with or without zone) as whole microseconds since 1970, in seconds."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp")) / F.lit(1_000_000.0)


def mark_sessions(df: DataFrame, keys: list[str], ts: str, gap_seconds: float, tie: str | None = None, also: Column | None = None) -> DataFrame:
    """Number the sessions of each key from 0: a new one starts where the gap is strictly longer.

    also: a further condition, over the row and F.lag columns of it, that starts a session.
    """
    order = Window.partitionBy(*keys).orderBy(ts, *([tie] if tie else []))
    gap = seconds(ts) - F.lag(seconds(ts)).over(order)
    starts = F.coalesce(gap > gap_seconds, F.lit(False))
    if also is not None:
        starts = starts | F.coalesce(also, F.lit(False))
    return df.withColumn("_starts", starts.cast("long")).withColumn("session_no", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")
