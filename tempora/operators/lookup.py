"""As-of lookups of many points in a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import NAN, finite
from .ordering import ROWS, indexed, nearest_valid


def interpolated(s: DataFrame, at: DataFrame, x: str, step: bool = False, rows: int = ROWS) -> DataFrame:
    """``at`` with ``v``, the value of the series at each row's time ``x``, null if the series is empty or ``x`` null.

    Linear (or a step) between the last sample at or before ``x`` and the next one, the end
    value outside, NaN beside non-finite values. Points and samples are put into one order,
    so that no join by range is needed and hot times are cut into chunks as others are.
    """
    samples = s.select(F.col("t").cast("double").alias("t"), F.struct(F.col("t").cast("double").alias("t"), F.col("v").alias("v")).alias("_s"), F.struct(F.lit(0).alias("k"), F.col("_i").alias("i")).alias("_key"))
    points = at.select(F.col(x).cast("double").alias("t"), F.struct("*").alias("_at"), F.struct(F.lit(1).alias("k"), F.monotonically_increasing_id().alias("i")).alias("_key"))
    both = samples.unionByName(points, allowMissingColumns=True)
    near = nearest_valid(indexed(both, "t", "_key", rows), F.col("_s"), rows).filter("_at is not null")
    a, b = F.col("_prev.v"), F.col("_next.v")
    line = a["v"] if step else a["v"] + (b["v"] - a["v"]) * (F.col("t") - a["t"]) / (b["t"] - a["t"])
    v = F.when(a.isNotNull() & b.isNotNull(), F.when(finite(a["v"]) & finite(b["v"]), line).otherwise(F.lit(NAN))).otherwise(F.coalesce(a["v"], b["v"]))
    return near.select(*[F.col(f"_at.`{c}`").alias(c) for c in at.columns if c != "v"], F.when(F.col("t").isNotNull(), v).alias("v"))
