"""Unions of time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import ROWS, framed, indexed, running_sum


def interval_union(df: DataFrame, start: str, end: str, rows: int = ROWS) -> DataFrame:
    """``start`` and ``end`` of the merged intervals; intervals that overlap or touch are one.

    Every interval opens (+1) and closes (-1); where the running count of open ones leaves or
    reaches zero, a merged one begins or ends. Intervals with a null end, or that end before they start, are left out.
    """
    ok = df.filter(F.col(start) <= F.col(end)).select(F.col(start).alias("a"), F.col(end).alias("b"))
    # equal events are one row with their number, and openings come before closings of the same time
    events = ok.select(F.col("a").alias("t"), F.lit(0).alias("k")).unionByName(ok.select(F.col("b").alias("t"), F.lit(1).alias("k")))
    events = events.groupBy("t", "k").agg(F.count("*").cast("double").alias("n"))
    open_ = running_sum(indexed(events, "t", "k", rows), F.when(F.col("k") == 0, F.col("n")).otherwise(-F.col("n")), "open", rows)
    ends = open_.filter(((F.col("k") == 0) & (F.col("open") == F.col("n"))) | ((F.col("k") == 1) & (F.col("open") == 0)))
    # beginnings and ends take turns
    ends = indexed(ends.select("t", "k"), "t", "k", rows)
    turns = framed(ends, 1, 1, lambda w: {"to": F.lead("t").over(w)}, rows)
    return turns.filter("k = 0").select(F.col("t").alias(start), F.col("to").alias(end))
