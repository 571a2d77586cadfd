"""Samples around a point of time, by windows on the native time column that grow until they hold enough.

The windows are ranges of the stored column, so that they reach the scan: row groups outside of
them are not read, and neither an order nor an index of the whole series is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import HOUR, between_ms, epoch_ms, finite

#: Times that a window grows by, and windows that are tried before all of a side is taken.
GROWTH, TRIES = 16, 6
#: The first and the last millisecond of the years 1 to 9999.
FIRST, LAST = -62_135_596_800_000, 253_402_300_799_998


def side(df: DataFrame, time: str, x: int, k: int, forward: bool, width: int = HOUR) -> DataFrame:
    """The rows of the smallest tried window before (at or before ``x``) or after it that has ``k`` rows; all of the side if none has."""
    a, b = (x + 1, LAST) if forward else (FIRST, x)
    for _ in range(TRIES):
        lo, hi = (a, min(b, x + width)) if forward else (max(a, x - width), b)
        rows = df.filter(between_ms(time, lo, hi))
        if (lo, hi) == (a, b) or rows.limit(k).count() == k:
            return rows
        width *= GROWTH
    return df.filter(between_ms(time, a, b))


def around(df: DataFrame, time: str, value: str, key: str, x: int, k: int = 1, width: int = HOUR) -> DataFrame:
    """t, v and key of the ``k`` last samples at or before ``x`` and the ``k`` first after it; of equal times, by the key. Rows without a time are not samples."""
    made = [epoch_ms(time).alias("t"), F.col(value).cast("double").alias("v"), F.col(key).alias("key")]
    before = side(df, time, x, k, False, width).select(*made).orderBy(F.desc("t"), F.desc("key")).limit(k)
    return before.unionByName(side(df, time, x, k, True, width).select(*made).orderBy("t", "key").limit(k))


def next_sample(df: DataFrame, time: str, x: int, forward: bool = True, width: int = HOUR) -> DataFrame:
    """The first time after ``x``, or the last one before it; null if there is none."""
    rows = side(df, time, x if forward else x - 1, 1, forward, width)
    return rows.agg((F.min if forward else F.max)(epoch_ms(time)).alias("t"))


def interpolate_at(df: DataFrame, time: str, value: str, key: str, x: int, step: bool = False, width: int = HOUR) -> DataFrame:
    """The value at ``x``: linear or step between neighbours, the end value outside, NaN beside non-finite values."""
    rows = around(df, time, value, key, x, 1, width)
    sample = F.struct("t", "v")
    near = rows.agg(F.max_by(sample, F.when(F.col("t") <= x, F.col("t"))).alias("a"), F.min_by(sample, F.when(F.col("t") > x, F.col("t"))).alias("b"))
    inside = F.col("a").isNotNull() & F.col("b").isNotNull()
    line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.lit(float(x)) - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    v = F.when(inside, F.when(finite("a.v") & finite("b.v"), F.col("a.v") if step else line).otherwise(F.lit(float("nan")))).otherwise(F.coalesce("a.v", "b.v"))
    return near.select(F.lit(float(x)).alias("x"), v.alias("v"))


def measures(df: DataFrame, time: str, value: str, key: str, x1: int, x2: int, width: int = HOUR) -> DataFrame:
    """What two cursors show of a series: values at both, differences of time (ms) and value, and the slope a second; null where a value is not finite."""
    a, b = (interpolate_at(df, time, value, key, x, width=width).select(F.col("v").alias(f"v{i}")) for i, x in ((1, x1), (2, x2)))
    both = a.crossJoin(b).select(*[F.when(finite(c), F.col(c)).alias(c) for c in ("v1", "v2")])  # a row each
    dv = F.col("v2") - F.col("v1")
    return both.select("v1", "v2", F.lit(x2 - x1).cast("long").alias("dt"), dv.alias("dv"), F.try_divide(dv * 1000.0, F.lit(float(x2 - x1))).alias("slope"))
