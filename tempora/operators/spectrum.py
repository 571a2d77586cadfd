"""Amplitude spectra of uniformly sampled series, each over many tasks.

The transform of N = A * B points is done in four steps. Sample i belongs to the strided
sub-series i mod B; (1) each has a transform of its own, of A points, (2) is turned by
twiddle factors, (3) one shuffle transposes the tiles, and (4) each of the A columns has a
transform of B points. As samples are real, only half the columns are shuffled; the others are their mirror
images. A group of tiles holds LEAF points, or the square root of N if that is more.

Places of samples come from chunks of time of equal width, which hold about as many rows each
wherever a series is uniform enough to be transformed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite
from .ordering import ROWS
from .quantiles import grouped_quantiles
from .tables import cut

#: Periodic windows as cosine sums (fixed values).
WINDOWS = {
    "none": [1.0], "hann": [0.5, -0.5], "hamming": [0.54, -0.46], "blackman": [0.42, -0.5, 0.08],
    "flattop": [0.21557895, -0.41663158, 0.277263158, -0.083578947, 0.006947368],
}
#: Points of a group of sub-series or columns, about.
LEAF = 1 << 14


def decibels(amp: Column, peak: Column | None = None) -> Column:
    """20 log10, -200 at least; relative to ``peak`` if there is one (all -200 if that is nothing)."""
    value = amp if peak is None else amp / peak
    db = F.greatest(20 * F.log10(F.greatest(value, F.lit(1e-10))), F.lit(-200.0))
    return db if peak is None else F.when(peak <= 1e-10, F.lit(-200.0)).otherwise(db)


def shape(n: int, pad: int, leaf: int = LEAF) -> tuple[int, int]:
    """A and B for ``n`` samples: one transform if it fits in a group, else about square."""
    size = (1 << (n - 1).bit_length()) * pad
    if size <= leaf:
        return size, 1
    bits = size.bit_length() - 1
    return 1 << (bits + 1) // 2, 1 << bits // 2


def windowed(i: np.ndarray, v: np.ndarray, n: int, window: str) -> np.ndarray:
    x = 2 * np.pi * i / n
    return v * sum(a * np.cos(k * x) for k, a in enumerate(WINDOWS[window]))


def window_sum(n: int, window: str) -> float:
    """The sum of a window of n points: its cosines cancel but for those of whole turns a sample."""
    return float(sum(a * n for k, a in enumerate(WINDOWS[window]) if k % n == 0))


def placed(df: DataFrame, by: str, time: str, value: str, key: str, rows: int = ROWS) -> DataFrame:
    """by, i, t, v, step (from the sample before, null for the first): each series in order, one sample for each time.

    Of equal times the row of the greatest ``key`` wins. Chunks meet once in a shuffle;
    their places come from a table of one row a chunk.
    """
    rows_of = df.select(F.col(by).alias("by"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v"), F.col(key).alias("_k"))
    span = rows_of.groupBy(F.col("by").alias("_by")).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"), F.ceil(F.count("*") / rows).alias("_parts"))
    share = F.try_divide(F.col("t") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    chunk = F.least(F.col("_parts") - 1, F.floor(F.coalesce(share, F.lit(0.0)) * F.col("_parts"))).cast("long")
    dealt = rows_of.join(span, F.col("by").eqNullSafe(F.col("_by"))).select("by", "t", "v", "_k", chunk.alias("_c")).repartition("by", "_c")
    single = dealt.groupBy("by", "_c", "t").agg(F.max_by("v", "_k").alias("v"))
    w = Window.partitionBy("by", "_c").orderBy("t")
    own = cut(single.withColumns({"_own": F.row_number().over(w) - 1, "_before": F.lag("t").over(w)}))
    edge = own.groupBy("by", "_c").agg(F.count("*").alias("_n"), F.max("t").alias("_last"))
    chunks = Window.partitionBy("by").orderBy("_c")
    edge = edge.select("by", "_c", F.coalesce(F.sum("_n").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.lag("_last").over(chunks).alias("_prev"))
    both = own.alias("o").join(edge.alias("e"), F.col("o.by").eqNullSafe(F.col("e.by")) & (F.col("o._c") == F.col("e._c")))
    return both.select("o.by", (F.col("_start") + F.col("_own")).alias("i"), "t", "v", (F.col("t") - F.coalesce("_before", "_prev")).alias("step"))


def gated(df: DataFrame, points: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """by, n, mean, step (median) and status of each series: ok, nan, invalidTime, nonUniform or tooShort."""
    bad = df.groupBy(F.col(by).alias("by")).agg(F.max(~finite(value)).alias("_nan"), F.max(~finite(time)).alias("_time"))
    steps = F.col("step")
    of = points.groupBy("by").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min(steps).alias("_least"), F.max(steps).alias("_most"))
    # a median lies between: most series are settled without one
    near = of.filter((F.col("_least") > 0) & (F.col("_most") > F.col("_least")) & (F.col("_most") - F.col("_least") < 2.1e-3 * F.col("_most")))
    asked = points.filter("step is not null").join(near.select(F.col("by").alias("_by")), F.col("by").eqNullSafe(F.col("_by")), "left_semi")
    medians = grouped_quantiles(asked, "by", "step", [0.5]).select(F.col("by").alias("_by"), F.col("value").alias("_median"))
    all_ = bad.alias("b").join(of.alias("o"), F.col("b.by").eqNullSafe(F.col("o.by")), "left").join(medians, F.col("b.by").eqNullSafe(F.col("_by")), "left")
    step = F.coalesce(F.col("_median"), F.when(F.col("_most") == F.col("_least"), F.col("_most")))
    off = F.greatest(F.col("_most") - step, step - F.col("_least")) / step
    uniform = F.coalesce((step > 0) & (off < 1e-3), F.lit(False))
    status = F.when(F.col("_nan"), "nan").when(F.col("_time"), "invalidTime").when(F.coalesce("n", F.lit(0)) < 2, "tooShort").when(~uniform, "nonUniform").otherwise("ok")
    return all_.select("b.by", "n", "mean", step.alias("step"), status.alias("status"))


def regularity(df: DataFrame, by: str, time: str, rows: int = ROWS) -> DataFrame:
    """Each series' number of different times, whether its steps are uniform (none a thousandth off their median), and then their median."""
    points = cut(placed(df, by, time, time, time, rows))
    out = gated(df, points, by, time, time)
    uniform = F.col("status") == "ok"
    return out.select(F.col("by").alias(by), F.coalesce("n", F.lit(0)).alias("n"), uniform.alias("uniform"), F.when(uniform, F.col("step")).alias("step"))


def spectrum(
    df: DataFrame, by: str, time: str = "t", value: str = "v", window: str = "hann", pad: int = 1, scale: str = "amplitude", unit: float = 1000.0, key: str | None = None, rows: int = ROWS, leaf: int = LEAF
) -> DataFrame:
    """k, frequency and amplitude (or dB) of each series of ``df``; a series that can't be transformed has one row with its status.

    A series with a null or NaN value (status nan) or time (invalidTime), with unequal
    steps (nonUniform) or fewer than two times (tooShort) has no lines. Of equal times the row of the greatest
    ``key`` wins (the greatest value, without one). An empty table gives no rows.
    """
    if pad not in (1, 2, 4, 8, 16):
        raise ValueError(f"zeros for a series of {pad} times its length")
    points = cut(placed(df, by, time, value, key or value, rows))
    known = cut(gated(df, points, by, time, value))
    lines = _transformed(points, known, window, pad, unit, leaf, points.schema["by"].dataType.simpleString())
    if scale == "relative_db":
        peaks = lines.groupBy("by").agg(F.max(F.when(F.col("k") > 0, F.col("amplitude"))).alias("_peak")).withColumnRenamed("by", "_by")
        lines = lines.join(peaks, F.col("by").eqNullSafe(F.col("_by"))).withColumn("amplitude", decibels(F.col("amplitude"), F.coalesce("_peak", F.lit(0.0))))
    elif scale == "db":
        lines = lines.withColumn("amplitude", decibels(F.col("amplitude")))
    nothing = F.lit(float("nan"))
    lost = known.filter("status <> 'ok'").select("by", F.lit(0).cast("long").alias("k"), nothing.alias("frequency"), nothing.alias("amplitude"), "status")
    return lines.select("by", "k", "frequency", "amplitude", F.lit("ok").alias("status")).unionByName(lost).withColumnRenamed("by", by)


def _transformed(points: DataFrame, known: DataFrame, window: str, pad: int, unit: float, leaf: int, kind: str) -> DataFrame:
    """by, k, frequency and amplitude of the series that are ok."""
    # logarithms are not exact, numbers of binary digits are
    size = F.expr("shiftleft(1L, length(bin(n - 1)))") * pad
    half = F.floor((F.length(F.bin(size)) - 1) / 2).cast("int")
    b = F.when(size <= leaf, F.lit(1)).otherwise(F.pow(F.lit(2.0), half)).cast("long")
    ok = known.filter("status = 'ok'").select(F.col("by").alias("_by"), "n", "mean", F.col("step").alias("_step"), b.alias("_b"), size.alias("_size"))
    # so many sub-series make a group that it has LEAF points
    each = F.greatest(F.lit(1), F.floor(leaf / (F.col("_size") / F.col("_b")))).cast("long")
    strided = points.join(ok, F.col("by").eqNullSafe(F.col("_by"))).withColumn("_g", F.floor((F.col("i") % F.col("_b")) / each))
    strided = strided.select("by", "_g", "i", "v", "n", "mean", "_step")

    def inner(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n, mean, step = int(group["n"].iloc[0]), float(group["mean"].iloc[0]), float(group["_step"].iloc[0])
        a, b = shape(n, pad, leaf)
        each = max(1, leaf // a)
        first = int(key[1]) * each
        i, v = group["i"].to_numpy(), group["v"].to_numpy(float) - mean
        sub = np.zeros((min(each, b - first), a))
        sub[i % b - first, i // b] = windowed(i, v, n, window)
        place = np.arange(first, first + len(sub))
        y = np.fft.rfft(sub, axis=1) * np.exp(-2j * np.pi / (a * b) * np.outer(place, np.arange(a // 2 + 1)))
        wide = max(1, leaf // b)  # columns of a tile
        starts = range(0, y.shape[1], wide)
        tiles = [np.ascontiguousarray(y[:, s : s + wide]).tobytes() for s in starts]
        return pd.DataFrame({"by": key[0], "col": list(starts), "row": first, "n": n, "step": step, "tile": tiles})

    def outer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n, step, start = int(group["n"].iloc[0]), float(group["step"].iloc[0]), int(key[1])
        a, b = shape(n, pad, leaf)
        size, wide = a * b, min(max(1, leaf // b), a // 2 + 1 - start)
        y = np.zeros((b, wide), complex)  # sub-series without samples are zero
        for row, tile in zip(group["row"], group["tile"], strict=True):
            part = np.frombuffer(tile, complex).reshape(-1, wide)
            y[row : row + len(part)] = part
        amp = np.abs(np.fft.fft(y, axis=0)) / window_sum(n, window)
        col = np.arange(start, start + wide)
        k = col[None, :] + a * np.arange(b)[:, None]
        mirrored = np.broadcast_to((col > 0) & (2 * col < a), k.shape) & (2 * (size - k) <= size)
        k, amp = np.concatenate([k[2 * k <= size], (size - k)[mirrored]]), np.concatenate([amp[2 * k <= size], amp[mirrored]])
        amp = np.where((k > 0) & (2 * k < size), 2 * amp, amp)
        return pd.DataFrame({"by": key[0], "k": k, "frequency": k / (size * (step / unit)), "amplitude": amp})

    tiles = strided.groupBy("by", "_g").applyInPandas(inner, f"by {kind}, col long, row long, n long, step double, tile binary")
    return tiles.groupBy("by", "col").applyInPandas(outer, f"by {kind}, k long, frequency double, amplitude double")
