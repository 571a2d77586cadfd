"""What is drawn of a series: strided trajectories, visible slices, thinned spectra, breaks at gaps, state vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clean
from .ordering import ROWS, with_previous
from .series import downsample


def order_violations(s: DataFrame, t: str = "t", rows: int = ROWS) -> int:
    """Rows of an indexed frame whose time is before that of the row ahead of it."""
    return with_previous(s.select("_i", t), [t], rows).filter(F.col(t) < F.col(f"prev_{t}")).count()


def phase_stride(s: DataFrame, most: int, t: str = "t", rows: int = ROWS) -> DataFrame:
    """First, last and every k-th row of a trajectory, ``most`` of them or one more; its rows must be in order of time."""
    if bad := order_violations(s, t, rows):
        raise ValueError(f"{bad} rows are out of time order")
    last = max(0, s.count() - 1)
    k = max(1, -(-last // max(1, most - 1)))
    return s.filter((F.col("_i") % k == 0) | (F.col("_i") == last))


def index_stride(s: DataFrame, points: int) -> DataFrame:
    """``points`` rows at evenly spaced places, the first and last among them; all of a shorter series."""
    last = s.count() - 1
    if last < points:
        return s
    inner = max(0, points - 2)
    place = F.when(F.col("id") > inner, last).otherwise(F.floor(F.col("id") * last / F.lit(float(inner + 1)) + 0.5)).cast("long")
    return s.join(F.broadcast(s.sparkSession.range(inner + 2).select(place.alias("_i")).distinct()), "_i")


def visible(s: DataFrame, lo: float, hi: float, points: int) -> DataFrame:
    """The samples in [lo, hi] and one more on either side, thinned to about ``points`` by least and greatest values."""
    inside = s.filter(F.col("t").between(lo, hi)).agg(F.min("_i"), F.max("_i")).first()
    if inside[0] is None:  # between two samples
        a = s.filter(F.col("t") < lo).agg(F.max("_i")).first()[0]
        inside = (0, -1) if a is None else (a + 1, a)
    cut = s.filter(F.col("_i").between(inside[0] - 1, inside[1] + 1))
    first = max(0, inside[0] - 1)
    return downsample(cut.withColumn("_i", F.col("_i") - first), points).withColumn("_i", F.col("_i") + first)


def thinned_spectrum(spectrum: DataFrame, points: int = 12_000, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """The least and greatest amplitude of each of points // 2 runs of ``k``, at their own frequencies; a short spectrum stays.

    With ``lo`` and ``hi`` only the lines in that range of frequencies and one more on either side.
    """
    if lo is not None and hi is not None and hi > lo:
        a, b = spectrum.filter(F.col("frequency").between(lo, hi)).agg(F.min("k"), F.max("k")).first()
        spectrum = spectrum.filter(F.col("k").between(a - 1, b + 1)) if a is not None else spectrum.limit(0)
    n, first = spectrum.agg(F.count("*"), F.min("k")).first()
    if n <= points:
        return spectrum
    runs = max(1, points // 2)
    run = F.floor(((F.col("k") - first + 1) * runs - 1) / F.lit(n))
    line = F.struct(*spectrum.columns)
    ends = spectrum.groupBy(run.alias("_run")).agg(F.min_by(line, F.struct("amplitude", "k")).alias("a"), F.min_by(line, F.struct(-F.col("amplitude"), F.col("k"))).alias("b"))
    return ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select("p.*")


def gap_breaks(points: DataFrame, t: str = "t", v: str = "v") -> DataFrame:
    """Drawn points with a null value after each one whose next is over 1.5 bucket widths away; ``_break`` marks what is put in.

    The points are those of a screen (some thousands), so that one window holds them.
    """
    by = Window.orderBy(t)
    whole = Window.partitionBy()
    near = points.withColumns({"_to": F.lead(t).over(by), "_n": F.count("*").over(whole), "_span": F.max(t).over(whole) - F.min(t).over(whole)})
    far = (F.col("_n") >= 4) & (F.col("_span") > 0) & (F.col("_to") - F.col(t) > 1.5 * F.col("_span") / (F.col("_n") / 2))
    marks = F.array_compact(F.array(F.lit(False), F.when(far, F.lit(True))))
    return near.withColumn("_break", F.explode(marks)).withColumn(v, F.when(~F.col("_break"), F.col(v))).drop("_to", "_n", "_span")


def state_view(df: DataFrame, x: list[str], dx: list[str], normalized: bool = True) -> DataFrame:
    """``df`` with tip1.. : where the arrow der(x) that starts at the state x ends.

    Normalised arrows have a quarter of the greatest coordinate's (1 at least) length; missing coordinates and rates count as 0.
    """
    at = [F.coalesce(clean(c), F.lit(0.0)) for c in x]
    rate = [F.coalesce(clean(c), F.lit(0.0)) for c in dx]
    size = F.sqrt(sum((r * r for r in rate), F.lit(0.0)))
    scale = F.greatest(*[F.abs(a) for a in at], F.lit(1.0)) * 0.25
    times = F.when(size > 1e-12, scale / size).otherwise(F.lit(1.0)) if normalized else F.lit(1.0)
    return df.withColumn("_times", times).withColumns({f"tip{i}": a + r * F.col("_times") for i, (a, r) in enumerate(zip(at, rate, strict=True), 1)}).drop("_times")


def stacked(traces: DataFrame, beside: float = 2.0**-40) -> DataFrame:
    """Points (trace, x, y) of traces that are drawn on top of each other: each is zero wherever another begins or ends outside its own support.

    A trace's support reaches from its first to its last point; where it has zeros to
    draw beyond an end, it falls to zero right ``beside`` that end, relative to its size.
    """
    points = traces.select("trace", "x", "y").filter("x is not null and y is not null").distinct()
    support = points.groupBy("trace").agg(F.min("x").alias("from"), F.max("x").alias("to"))
    # two rows a trace: the places where the stack changes
    ends = support.select(F.explode(F.array("from", "to")).alias("x")).distinct()
    outside = support.join(ends, (F.col("x") < F.col("from")) | (F.col("x") > F.col("to")))
    left = F.col("x") < F.col("from")
    near = F.when(left, F.col("from") - beside * F.greatest(F.abs("from"), F.lit(1.0))).otherwise(F.col("to") + beside * F.greatest(F.abs("to"), F.lit(1.0)))
    # never beyond the place that the zero stands for
    near = F.when(left, F.greatest("x", near)).otherwise(F.least("x", near))
    zeros = outside.select("trace", F.explode(F.array("x", near)).alias("x"), F.lit(0.0).alias("y")).distinct()
    return points.unionByName(zeros)
