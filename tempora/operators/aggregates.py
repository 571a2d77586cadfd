"""Aggregates of series: envelopes, missing data, statistics, fits and histograms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import between_ms, bucket, clean, col, epoch_ms, finite
from .ordering import quantiles


def envelope(df: DataFrame, time: str, values: list[str], lo: int, hi: int, max_points: int = 4000) -> DataFrame:
    """Per bucket of [lo, hi] (ms): first and last time, least and greatest finite value of each series."""
    n = max(1, max_points // 2)
    rows = df.filter(between_ms(time, lo, hi)).select(epoch_ms(time).alias("t"), *[clean(v).alias(v) for v in values])
    aggs = [a for v in values for a in (F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"))]
    return rows.groupBy(bucket(F.col("t"), lo, hi - lo, n).alias("bucket")).agg(F.min("t").alias("t_lo"), F.max("t").alias("t_hi"), *aggs)


def envelope_points(env: DataFrame, value: str) -> DataFrame:
    """The drawn points of an envelope: (t_lo, min) and (t_hi, max) of each bucket."""
    pts = F.array(F.struct(F.col("t_lo").alias("t"), F.col(f"{value}_min").alias("v")), F.struct(F.col("t_hi").alias("t"), F.col(f"{value}_max").alias("v")))
    return env.select("bucket", F.explode(pts).alias("p")).select("bucket", "p.t", "p.v")


def row_estimate(rows: int, span: float, full_span: float) -> float:
    return rows * min(1.0, abs(span) / full_span) if full_span > 0 else float(rows)


def raw_range(df: DataFrame, time: str, values: list[str], lo: int, hi: int, limit: int | None = None) -> DataFrame:
    """Exact samples of a range in order of time; with ``limit``, its first ones, and ``truncated`` tells that there are more."""
    rows = df.filter(between_ms(time, lo, hi)).select(epoch_ms(time).alias("t"), *values).orderBy("t", *values)
    if limit is None:
        return rows
    more = rows.limit(limit + 1).agg((F.count("*") > limit).alias("truncated"))
    return rows.limit(limit).crossJoin(F.broadcast(more)).orderBy("t", *values)


def missing_buckets(df: DataFrame, time: str, values: list[str], lo: int, hi: int, n: int) -> DataFrame:
    """Per bucket: rows, rows with a non-finite value, first and last time."""
    bad = ~finite(values[0])
    for v in values[1:]:
        bad = bad | ~finite(v)
    rows = df.filter(between_ms(time, lo, hi)).select(epoch_ms(time).alias("t"), bad.alias("bad"))
    b = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col("t") - lo) / F.lit(float(hi - lo)) * n))).cast("long")
    return rows.groupBy(b.alias("bucket")).agg(F.count("*").alias("n_total"), F.count_if("bad").alias("n_missing"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))


def missing_intervals(buckets: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    """What ``missing_buckets`` shows as intervals (kind, t0, t1): ``any`` missing data, and ``solid`` where all of it is.

    The nominal step is the middle one of the steps within and between buckets. Steps of more
    than 1.5 of it are gaps, a bucket whose samples lie too far apart is one as a whole, and a
    bucket without a finite value reaches one step over its samples. Intervals that touch are
    one. There are as many rows as buckets on a screen, which one window holds.
    """
    span, step, prev = float(hi - lo), F.col("step"), F.col("prev")
    b = buckets.filter("n_total > 0").withColumn("prev", F.lag("t_max").over(Window.orderBy("bucket")))
    width = F.col("t_max") - F.col("t_min")
    steps = F.array_compact(F.array(F.when((F.col("n_total") > 1) & (width > 0), width / (F.col("n_total") - 1)), F.when(F.col("t_min") > prev, (F.col("t_min") - prev).cast("double"))))
    sorted_ = b.select(F.explode(steps).alias("s")).agg(F.sort_array(F.collect_list("s")).alias("s"))
    b = b.crossJoin(F.broadcast(sorted_.select(F.try_element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("step"))))
    edge = lambda i: lo + i / n * span
    item = lambda kind, a, z: F.struct(F.lit(kind).alias("kind"), a.cast("double").alias("t0"), z.cast("double").alias("t1"))
    here = (edge(F.col("bucket")), edge(F.col("bucket") + 1))
    full = F.col("n_missing") >= F.col("n_total")
    sides = (F.greatest(F.lit(float(lo)), F.col("t_min") - step), F.least(F.lit(float(hi)), F.col("t_max") + step))
    found = [
        (F.col("t_min") - prev > 1.5 * step, (prev, F.col("t_min")), ("any", "solid")),
        ((F.col("n_total") > 1) & (width > (F.col("n_total") - 0.5) * step), here, ("any", "solid")),
        (full & step.isNotNull(), sides, ("any", "solid")),
        (full & step.isNull(), here, ("any", "solid")),
        ((F.col("n_missing") > 0) & ~full, here, ("any",)),
    ]
    rows = b.select(F.explode(F.array_compact(F.array(*[F.when(c, item(k, *ends)) for c, ends, kinds in found for k in kinds]))).alias("i")).select("i.*").filter("t0 < t1")
    by = Window.partitionBy("kind").orderBy("t0", "t1")
    seen = F.max("t1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (seen.isNull() | (F.col("t0") > seen)).cast("int")).withColumn("run", F.sum("new").over(by))
    return rows.groupBy("kind", "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("run")


def missing_summary(buckets: DataFrame, n: int) -> DataFrame:
    """Buckets with missing and with some missing data, their share, and whether they are too many to be told apart."""
    some = F.count_if((F.col("n_missing") > 0) & (F.col("n_missing") < F.col("n_total")))
    bad = F.count_if((F.col("n_missing") > 0) & (F.col("n_total") > 0))
    return buckets.agg(bad.alias("missing"), some.alias("partial"), (bad / F.lit(float(n))).alias("coverage"), (some >= max(3, n // 100)).alias("dense"))


def panel_stats(df: DataFrame, value: str) -> DataFrame:
    v = clean(value)
    return df.agg(F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.sqrt(F.avg(v * v)).alias("v_rms"))


def extent(df: DataFrame, time: str) -> DataFrame:
    return df.agg(F.min(epoch_ms(time)).alias("t_min"), F.max(epoch_ms(time)).alias("t_max"), F.count("*").alias("n"))


def bounds_count(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    v = clean(value)
    return df.agg(F.count_if((v < lo) | (v > hi)).alias("n_out"), F.count(v).alias("n_finite"))


def _both(x: str, y: str) -> list[Column]:
    both = finite(x) & finite(y)
    return [F.when(both, col(x).cast("double")).alias("x"), F.when(both, col(y).cast("double")).alias("y")]


def _pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(*_both(x, y))


def _moments(x: str = "x", y: str = "y") -> list[Column]:
    return [
        F.count("*").alias("n_scope"), F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("mx"), F.regr_avgy(y, x).alias("my"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    ]


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r over the rows where both are finite; null if it is undefined."""
    return _correlation(_pair(df, x, y).agg(*_moments()))


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``correlation`` and the straight line's b0, b1 and r2 of every pair of columns, in one scan: a row a pair, for a report."""
    # pairs stand side by side in one row of sums, and are turned into rows at the end
    columns = [c.alias(f"{e}{i}") for i, (x, y) in enumerate(pairs) for e, c in zip("xy", _both(x, y), strict=True)]
    sums = df.select(*columns).agg(*[F.struct(F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), *_moments(f"x{i}", f"y{i}")).alias(f"p{i}") for i, (x, y) in enumerate(pairs)])
    m = sums.select(F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")).select("p.*")
    b1 = F.when((F.col("n") >= 2) & (F.col("sxx") > 0), F.try_divide("sxy", "sxx"))
    return _correlation(m, "x_name", "y_name", (F.col("my") - b1 * F.col("mx")).alias("b0"), b1.alias("b1")).withColumn("r2", F.col("r") * F.col("r"))


def _correlation(m: DataFrame, *more) -> DataFrame:
    defined = (F.col("n") >= 2) & (F.col("sxx") > 0) & (F.col("syy") > 0)
    r = F.when(defined, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("sxy", F.sqrt(F.col("sxx") * F.col("syy"))))))
    std = lambda s: F.when(F.col("n") > 1, F.sqrt(F.try_divide(F.col(s), F.col("n") - 1)))
    return m.select(
        *more, "n", "n_scope", (F.col("n_scope") - F.col("n")).alias("n_excluded"), F.col("mx").alias("mean_x"), F.col("my").alias("mean_y"),
        std("sxx").alias("std_x"), std("syy").alias("std_y"), r.alias("r"),
    )


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    m = _pair(df, x, y).agg(*_moments()).filter("n >= 2 and sxx > 0")
    m = m.withColumn("b1", F.col("sxy") / F.col("sxx")).withColumn("sse", F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")))
    r2 = F.when(F.col("syy") > 0, 1 - F.try_divide("sse", "syy"))
    return m.select("n", (F.col("my") - F.col("b1") * F.col("mx")).alias("b0"), "b1", r2.alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "sse", F.col("syy").alias("sst"))


def quadratic_moments(df: DataFrame, x: str, y: str) -> DataFrame:
    """Power sums in u = (x - mean) / std, which a quadratic fit needs."""
    p = _pair(df, x, y).filter("x is not null")
    mx, sx = p.agg(F.avg("x"), F.stddev_samp("x")).first()
    if not sx:
        return p.limit(0).agg(*[F.sum("x").alias(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2", "yy")])
    u = (F.col("x") - mx) / sx
    out = {"s0": F.lit(1.0), "s1": u, "s2": u * u, "s3": u * u * u, "s4": u * u * u * u, "t0": F.col("y"), "t1": u * F.col("y"), "t2": u * u * F.col("y"), "yy": F.col("y") * F.col("y")}
    return p.agg(*[F.sum(v).alias(k) for k, v in out.items()]).withColumn("mean_x", F.lit(mx)).withColumn("std_x", F.lit(sx))


def quadratic_fit(df: DataFrame, x: str, y: str) -> dict | None:
    """Coefficients of a x^2 + b x + c with r2 and rmse; None if the system is singular."""
    m = quadratic_moments(df, x, y).first()
    if m is None or m["s0"] is None or m["s0"] < 3:
        return None
    a = np.array([[m.s0, m.s1, m.s2], [m.s1, m.s2, m.s3], [m.s2, m.s3, m.s4]])
    if np.linalg.cond(a) > 1e12:
        return None
    t = np.array([m.t0, m.t1, m.t2])
    c, b, q = np.linalg.solve(a, t)
    s, mx = m.std_x, m.mean_x
    sst, sse = m.yy - m.t0**2 / m.s0, max(0.0, float(m.yy - np.dot([c, b, q], t)))
    return {"a": q / s**2, "b": b / s - 2 * q * mx / s**2, "c": c - b * mx / s + q * mx**2 / s**2, "r2": 1 - sse / sst if sst > 0 else math.nan, "rmse": math.sqrt(sse / m.s0)}


def fit_curve(df: DataFrame, x: str, coefficients: tuple[float, ...], points: int = 200) -> DataFrame:
    """``points`` values of a polynomial (lowest power first) between the least and greatest finite x."""
    ends = df.agg(F.min(clean(x)).alias("lo"), F.max(clean(x)).alias("hi"))
    at = df.sparkSession.range(points).crossJoin(F.broadcast(ends)).select("id", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("id") / (points - 1)).alias("x"))
    y = F.lit(0.0)
    for c in reversed(coefficients):
        y = y * F.col("x") + float(c)
    return at.select("id", "x", y.alias("y"))


def histogram_edges(df: DataFrame, value: str, bins: int | None = None, width: float | None = None, lo: float | None = None, hi: float | None = None) -> tuple[float, float, int] | None:
    """Lowest edge, highest edge and number of bins: by count, by width, or Freedman-Diaconis with Sturges behind it."""
    v = clean(value)
    n, a, b = df.agg(F.count(v), F.min(v), F.max(v)).first()
    if not n:
        return None
    lo, hi = a if lo is None else lo, b if hi is None else hi
    if lo == hi:
        return lo - 0.5, hi + 0.5, 1
    if bins is None:
        if not (h := width):
            q = quantiles(df, v, [0.25, 0.75])[1]
            h = 2 * (q[1] - q[0]) / n ** (1 / 3)
        bins = min(500 if width else 200, max(1, math.ceil((hi - lo) / h))) if h > 0 else min(200, math.ceil(math.log2(n) + 1))
    return lo, hi, min(500, max(1, bins))


def histogram(df: DataFrame, value: str, **how) -> DataFrame:
    """bin, edges, count, percent, density and cumulative count of every bin of a series; ``underflow`` and ``overflow`` count the values outside of the edges."""
    edges = histogram_edges(df, value, **how)
    lo, hi, k = edges or (0.0, 1.0, 0)
    w = (hi - lo) / max(k, 1)
    v = F.col("v")
    place = F.when(v < lo, -1).when(v > hi, k).otherwise(F.least(F.lit(k - 1), F.floor((v - lo) / w))).cast("long")
    counts = df.select(clean(value).alias("v")).filter("v is not null").groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(-1, k + 1).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])
    whole = Window.partitionBy()
    every = every.withColumns({"underflow": F.max(F.when(F.col("bin") == -1, F.col("n"))).over(whole), "overflow": F.max(F.when(F.col("bin") == k, F.col("n"))).over(whole)})
    total = F.sum("n").over(whole)
    return every.filter((F.col("bin") >= 0) & (F.col("bin") < k)).select(
        "bin", (lo + F.col("bin") * w).alias("lo"), F.when(F.col("bin") == k - 1, F.lit(hi)).otherwise(lo + (F.col("bin") + 1) * w).alias("hi"), "n",
        F.try_divide(100.0 * F.col("n"), total).alias("percent"), F.try_divide(F.col("n"), total * w).alias("density"), F.sum("n").over(Window.orderBy("bin")).alias("cumulative"),
        "underflow", "overflow",
    )
