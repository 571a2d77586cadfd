"""Histograms of several traces on common edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clean
from .quantiles import grouped_quantiles

#: Bins that are found, and that may be asked for, at most (fixed values).
MOST_FOUND, MOST_ASKED = 200, 500


def trace_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, lo, hi, q1, q3 and the bins that each trace suggests: Freedman-Diaconis by its own span, or Sturges where quartiles are equal."""
    v = clean(value)
    of = df.groupBy(F.col(by).alias("by")).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).filter("n > 0")
    q = grouped_quantiles(df, by, value, [0.25, 0.75]).groupBy(F.col("by").alias("_by"))
    q = q.agg(F.max(F.when(F.col("share") == 0.25, F.col("value"))).alias("q1"), F.max(F.when(F.col("share") == 0.75, F.col("value"))).alias("q3"))
    found = of.join(q, F.col("by").eqNullSafe(F.col("_by"))).drop("_by")
    width = 2 * (F.col("q3") - F.col("q1")) / F.cbrt("n")
    bins = F.when((F.col("n") >= 2) & (width > 0) & (F.col("hi") > F.col("lo")), F.ceil((F.col("hi") - F.col("lo")) / width)).otherwise(F.ceil(F.log2("n") + 1))
    return found.withColumn("bins", F.greatest(bins, F.lit(1)).cast("long"))


def histograms(df: DataFrame, by: str, value: str, bins: int | None = None, width: float | None = None) -> DataFrame:
    """by, bin, lo, hi, n, percent, density, cumulative and stacked of each trace in every bin of the common edges.

    Edges reach from the least to the greatest finite value of all traces; there are as many bins as the
    trace that suggests most of them, or as ``bins`` or ``width`` say. ``percent`` and ``density`` are
    shares of the trace, ``stacked`` is the share of all traces in per cent. Traces without finite values have no rows.
    """
    if bins is not None and not 1 <= bins <= MOST_ASKED:
        raise ValueError(f"{bins} bins")
    if width is not None and not width > 0:
        raise ValueError(f"bins of {width}")
    stats = trace_stats(df, by, value).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("bins").alias("bins"), F.sum("n").alias("all")).first()
    if stats.lo is None:
        lo, hi, k = 0.0, 1.0, 0
    elif stats.lo == stats.hi:
        lo, hi, k = stats.lo - 0.5, stats.hi + 0.5, 1
    else:
        lo, hi = stats.lo, stats.hi
        k = bins or (int(-(-(hi - lo) // width)) if width else min(MOST_FOUND, stats.bins))
    if k > MOST_ASKED:
        raise ValueError(f"{k} bins")
    w = width if width and lo < hi and k > 1 else (hi - lo) / max(k, 1)
    place = F.least(F.lit(k - 1), F.greatest(F.lit(0), F.floor((F.col("v") - lo) / w))).cast("long")
    counts = df.select(F.col(by).alias("by"), clean(value).alias("v")).filter("v is not null").groupBy("by", place.alias("bin")).agg(F.count("*").alias("n"))
    # a list of bins for each trace, filled where it has values: k rows a trace, whatever the table
    traces = counts.groupBy("by").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("of"), F.sum("n").alias("total"))
    every = traces.select("by", "of", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(k, 1) - 1).cast("long"))).alias("bin"))
    n = F.coalesce(F.try_element_at("of", F.col("bin")), F.lit(0))
    upto = F.sum("n").over(Window.partitionBy("by").orderBy("bin"))
    size = F.col("hi") - F.col("lo")
    out = every.select("by", "bin", "total", n.alias("n"), (lo + F.col("bin") * w).alias("lo"), F.when(F.col("bin") == k - 1, F.lit(hi)).otherwise(lo + (F.col("bin") + 1) * w).alias("hi"))
    return out.select(
        F.col("by").alias(by), "bin", "lo", "hi", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"), (F.col("n") / (F.col("total") * size)).alias("density"),
        upto.alias("cumulative"), (100.0 * F.col("n") / F.lit(stats["all"] or 1)).alias("stacked"),
    )
