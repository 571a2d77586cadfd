"""Series kernels: derivatives, integrals, moving averages, gaps, outliers, cursor searches and samples.

Unless said otherwise, a series is a frame of ``_i`` (place), ``t`` (ms or a number) and ``v``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import NAN, clean, epoch_ms, finite, safe_div
from .ordering import ROWS, chunked, framed, indexed, median_step, nearest_valid, quantiles, running_sum, with_previous


def series(df: DataFrame, time: str, value: str, key: str, rows: int = ROWS) -> DataFrame:
    """The series of a column against a timestamp column, in the order of time, then ``key``."""
    return indexed(df.select(epoch_ms(time).alias("t"), F.col(value).cast("double").alias("v"), F.col(key).alias("key")).filter("t is not null"), "t", "key", rows)


def derivative(s: DataFrame, how: str = "centered", unit: float = 1000.0, rows: int = ROWS) -> DataFrame:
    """``s`` with ``d``: the slope to the neighbours (one-sided at the ends); NaN for bad pairs and equal times. ``unit`` is a second of ``t``."""
    near = framed(s, 1, 1, lambda w: {"pt": F.lag("t").over(w), "pv": F.lag("v").over(w), "nt": F.lead("t").over(w), "nv": F.lead("v").over(w)}, rows)
    here_t, here_v = F.col("t"), F.col("v")
    first, last = F.col("pt").isNull(), F.col("nt").isNull()
    back, ahead = {"centered": (True, True), "forward": (False, True), "backward": (True, False)}[how]
    lo_t, lo_v = (F.when(first, here_t).otherwise(F.col("pt")), F.when(first, here_v).otherwise(F.col("pv"))) if back else (F.when(last, F.col("pt")).otherwise(here_t), F.when(last, F.col("pv")).otherwise(here_v))
    hi_t, hi_v = (F.when(last, here_t).otherwise(F.col("nt")), F.when(last, here_v).otherwise(F.col("nv"))) if ahead else (F.when(first, F.col("nt")).otherwise(here_t), F.when(first, F.col("nv")).otherwise(here_v))
    dt = (hi_t - lo_t) / F.lit(unit)
    d = F.when(finite(lo_v) & finite(hi_v) & (dt != 0), safe_div(hi_v - lo_v, dt)).otherwise(F.lit(NAN))
    return near.withColumn("d", d).drop("pt", "pv", "nt", "nv")


def integral(s: DataFrame, how: str = "trapezoidal", unit: float = 1000.0, rows: int = ROWS) -> DataFrame:
    """``s`` with ``integral``, the running sum of areas between neighbours; pairs with a non-finite end add nothing."""
    near = with_previous(s, ["t", "v"], rows)
    dt = (F.col("t") - F.col("prev_t")) / F.lit(unit)
    mean = (F.col("v") + F.col("prev_v")) / 2 if how == "trapezoidal" else F.col("prev_v")
    return running_sum(near, F.when(finite("v") & finite("prev_v"), mean * dt), "integral", rows).drop("prev_t", "prev_v")


def moving_average(s: DataFrame, window: int = 21, rows: int = ROWS) -> DataFrame:
    """``s`` with ``ma``, the mean of finite values in a centred window; partial at the ends."""
    left = (window - 1) // 2
    right = window - left - 1
    return framed(s, left, right, lambda w: {"ma": F.avg(clean("v")).over(w.rowsBetween(-left, right))}, rows)


def sampling_gaps(s: DataFrame, rows: int = ROWS) -> DataFrame:
    """Steps of more than 1.5 median steps, with the number of samples that are missing."""
    med = median_step(s, rows)
    dt = F.col("t") - F.col("prev_t")
    missing = F.greatest(F.lit(1), F.round(dt / F.lit(med)) - 1).cast("long")
    return with_previous(s.select("_i", "t"), ["t"], rows).filter(dt > 1.5 * med).select(F.col("prev_t").alias("t0"), F.col("t").alias("t1"), dt.alias("dt"), missing.alias("missing"))


def time_stats(s: DataFrame, rows: int = ROWS) -> DataFrame:
    med = median_step(s, rows)
    return s.agg(F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max")).withColumn("median_step", F.lit(med))


def nan_runs(s: DataFrame, rows: int = ROWS) -> DataFrame:
    """Runs of non-finite values as (last good time, first good time, rows); an open end is null."""
    near = nearest_valid(s.withColumn("_tv", F.col("t")), F.when(finite("v"), F.col("t")), rows).filter(~finite("v"))
    # by the places of the good samples: their times may be equal
    runs = near.groupBy(F.col("_prev.i"), F.col("_next.i")).agg(F.first("_prev.v").alias("last_good"), F.first("_next.v").alias("first_good"), F.count("*").alias("n"))
    return runs.select("last_good", "first_good", "n")


def iqr_bounds(s: DataFrame, factor: float = 1.5) -> tuple[float, float] | None:
    """Bounds from exact quartiles; None for fewer than four finite values."""
    n, q = quantiles(s, clean("v"), [0.25, 0.75])
    if n < 4:
        return None
    d = factor * (q[1] - q[0])
    return q[0] - d, q[1] + d


def outliers_bounds(s: DataFrame, lo: float, hi: float) -> DataFrame:
    return s.withColumn("outlier", finite("v") & ((F.col("v") < lo) | (F.col("v") > hi)))


def outliers_iqr(s: DataFrame, factor: float = 1.5) -> DataFrame:
    b = iqr_bounds(s, factor)
    return outliers_bounds(s, *b) if b else s.withColumn("outlier", F.lit(False))


def replaced(s: DataFrame, how: str = "nan", rows: int = ROWS) -> DataFrame:
    """``v`` of outliers set to NaN, or to the line between the nearest valid rows by place (NaN at the ends)."""
    valid = F.when(finite("v") & ~F.col("outlier"), F.col("v"))
    if how == "nan":
        return s.withColumn("v", F.when(F.col("outlier"), F.lit(NAN)).otherwise(F.col("v")))
    near = nearest_valid(s, valid, rows)
    share = F.try_divide(F.col("_i") - F.col("_prev.i"), F.col("_next.i") - F.col("_prev.i"))
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * share
    return near.withColumn("v", F.when(F.col("outlier"), F.coalesce(line, F.lit(NAN))).otherwise(F.col("v"))).drop("_prev", "_next")


def extremum(s: DataFrame, x: float, kind: str = "max", forward: bool = True, rows: int = ROWS) -> DataFrame:
    """The next (or previous) plateau strictly above (below) both finite neighbours: its first (or last) time and value.

    A plateau is next if it begins after ``x``, and previous if it ends before.
    """
    turn = framed(s, 1, 0, lambda w: {"fresh": F.coalesce(F.col("v") != F.lag("v").over(w), F.lit(True)), "pt": F.lag("t").over(w)}, rows).filter("fresh")
    w_cols = lambda w: {"pv": F.lag("v").over(w), "nv": F.lead("v").over(w), "right": F.lead("pt").over(w)}
    runs = framed(indexed(turn.select("t", "v", "pt", F.col("_i").alias("i0")), "t", "i0", rows), 1, 1, w_cols, rows)
    better = (lambda a, b: a > b) if kind == "max" else (lambda a, b: a < b)
    hit = runs.filter(finite("v") & finite("pv") & finite("nv") & better(F.col("v"), F.col("pv")) & better(F.col("v"), F.col("nv")))
    hit = hit.withColumn("t", F.col("t") if forward else F.col("right"))
    return hit.filter(F.col("t") > x if forward else F.col("t") < x).orderBy("t" if forward else F.desc("t")).limit(1).select("t", "v")


def zero_crossing(s: DataFrame, x: float, forward: bool = True, rows: int = ROWS, step: bool = False) -> DataFrame:
    """The time of the next (or previous) zero: a sample at zero, or the root of the line between opposite signs (of a stepped series, where the sign changes)."""
    near = with_previous(s, ["t", "v"], rows).filter(finite("v") & finite("prev_v"))
    root = F.col("prev_t") - F.col("prev_v") * (F.col("t") - F.col("prev_t")) / F.nullif(F.col("v") - F.col("prev_v"), F.lit(0.0))
    z = F.when(F.col("v") == 0, F.col("t").cast("double")).when(F.col("prev_v") == 0, F.col("prev_t").cast("double")).when(F.col("v") * F.col("prev_v") < 0, F.col("t").cast("double") if step else root)
    z = near.select(z.alias("t")).filter(F.col("t") > x if forward else F.col("t") < x)
    return z.agg((F.min if forward else F.max)("t").alias("t"))


def stride(s: DataFrame, points: int) -> DataFrame:
    """First, last and every k-th row in order, about ``points`` of them."""
    n = s.count()
    k = max(1, -(-n // max(points, 1)))
    return s.filter((F.col("_i") % k == 0) | (F.col("_i") == n - 1))


def reservoir(df: DataFrame, key: str, points: int, seed: int = 42) -> DataFrame:
    """``points`` rows chosen by a hash of seed and ``key``; reruns choose the same, in any order of rows."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(points)


def downsample(s: DataFrame, points: int) -> DataFrame:
    """First and last row and the rows of the least and greatest value of each run of rows between."""
    n = s.count()
    if n <= points or n <= 2:
        return s.select("_i", "t", "v")
    size = -(-(n - 2) // max(1, (points - 2) // 2))
    row = F.struct("_i", "t", "v")
    inner = s.filter((F.col("_i") > 0) & (F.col("_i") < n - 1) & finite("v")).groupBy(F.floor((F.col("_i") - 1) / size).alias("b"))
    inner = inner.agg(F.min(F.struct("v", "_i", row.alias("r"))).alias("a"), F.min(F.struct((-F.col("v")).alias("v"), "_i", row.alias("r"))).alias("z"))
    inner = inner.select(F.explode(F.array("a.r", "z.r")).alias("r")).select("r.*").distinct()
    return inner.unionByName(s.filter((F.col("_i") == 0) | (F.col("_i") == n - 1)).select("_i", "t", "v"))


def transform(s: DataFrame, gain: float = 1.0, offset: float = 0.0, negate: bool = False, start: float | None = None, end: float | None = None, shift: float = 0.0) -> DataFrame:
    """Crop by time, then shift it; gain, sign and offset act on finite values only."""
    if start is not None:
        s = s.filter(F.col("t") >= start)
    if end is not None:
        s = s.filter(F.col("t") <= end)
    v = F.col("v") * gain * (-1.0 if negate else 1.0) + offset
    return s.withColumn("v", F.when(finite("v"), v).otherwise(F.col("v"))).withColumn("t", F.col("t") + F.lit(shift))


def bounds_mask(s: DataFrame, lo: float, hi: float) -> DataFrame:
    return s.withColumn("v", F.when(F.col("v").between(lo, hi), F.col("v")))


def phase(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a trajectory whose coordinates are all finite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & finite(c)
    return df.filter(ok)


def duplicate_times(s: DataFrame) -> DataFrame:
    """One row for each time; of equal times the last row's value wins."""
    return s.groupBy("t").agg(F.max_by("v", "_i").alias("v"), F.max("_i").alias("_i"))


def pairs(names: list[str], most: int = 64) -> list[tuple[str, str]]:
    """Names two by two, in order."""
    return list(zip(names[::2], names[1::2], strict=False))[:most]
