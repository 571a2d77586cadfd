"""Calendar views in UTC: heatmaps, their time integrals, and profiles of a period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import DAY, HOUR, clean, day_start, epoch_ms, safe_div, week_start, weekday
from .ordering import ROWS, indexed, median_step, with_previous

#: Name of a mode -> (start of the column, row of the cell, length of a cell).
MODES = {
    "week_day": (week_start, lambda t: weekday(t) + 1, DAY),
    "day_hour": (day_start, lambda t: F.floor(F.pmod(t, F.lit(DAY)) / HOUR).cast("long"), HOUR),
}


def heatmap(df: DataFrame, time: str, value: str, mode: str = "week_day") -> DataFrame:
    """Count, finite count, mean, min, max and sum of every cell that has rows."""
    column, row, _ = MODES[mode]
    rows = df.select(epoch_ms(time).alias("t"), clean(value).alias("v")).filter("t is not null")
    return rows.groupBy(column(F.col("t")).cast("long").alias("col_start"), row(F.col("t")).alias("row_idx")).agg(
        F.count("*").alias("n_scope"), F.count("v").alias("n_finite"), F.avg("v").alias("mean_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.sum("v").alias("sum_v")
    )


def dense(cells: DataFrame, mode: str = "week_day") -> DataFrame:
    """All cells between the first and last column; absent ones have null values."""
    step, first, last = (7 * DAY, 1, 7) if mode == "week_day" else (DAY, 0, 23)
    ends = cells.agg(F.min("col_start").alias("lo"), F.max("col_start").alias("hi")).filter("lo is not null")
    grid = ends.select(F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("col_start"))
    grid = grid.select("col_start", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("row_idx"))
    return grid.join(cells, ["col_start", "row_idx"], "left")


def heatmap_integral(df: DataFrame, time: str, value: str, key: str, mode: str = "day_hour", rows: int = ROWS) -> DataFrame:
    """Trapezoid area in value hours of every cell; steps are split at cell borders, and cells touched by a gap have none.

    A gap is a step of more than 1.5 times the median positive step between finite samples.
    """
    column, row, size = MODES[mode]
    s = indexed(df.select(epoch_ms(time).alias("t"), clean(value).alias("v"), F.col(key).alias("_k")).filter("t is not null and v is not null"), "t", "_k", rows)
    limit = 1.5 * median_step(s, rows)
    steps = with_previous(s, ["t", "v"], rows).filter("t > prev_t")
    cells = steps.withColumn("cell", F.explode(F.sequence(F.floor(F.col("prev_t") / size) * size, F.floor((F.col("t") - 1) / size) * size, F.lit(size).cast("long"))))
    a, b = F.greatest("prev_t", "cell"), F.least(F.col("t"), F.col("cell") + size)
    at = lambda x: F.col("prev_v") + (F.col("v") - F.col("prev_v")) * (x - F.col("prev_t")) / (F.col("t") - F.col("prev_t"))
    gap = (F.col("t") - F.col("prev_t")) > limit
    parts = cells.select("cell", gap.alias("gap"), F.when(~gap, (at(a) + at(b)) / 2 * (b - a)).alias("area"))
    out = parts.groupBy("cell").agg(F.max("gap").alias("has_gap"), F.sum("area").alias("area"))
    out = out.select(column(F.col("cell")).cast("long").alias("col_start"), row(F.col("cell")).alias("row_idx"), "has_gap", F.when(~F.col("has_gap"), F.col("area") / HOUR).alias("integral"))
    return heatmap(df, time, value, mode).select("col_start", "row_idx", "n_scope", "n_finite").join(out, ["col_start", "row_idx"], "full")


def iso_week(df: DataFrame, time: str) -> DataFrame:
    """Monday (ms), ISO year and ISO week of the weeks that have rows."""
    t = epoch_ms(time)
    d = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("week") / DAY).cast("int"))
    return df.select(week_start(t).cast("long").alias("week")).distinct().filter("week is not null").select("week", F.extract(F.lit("YEAROFWEEK"), d).cast("long").alias("iso_year"), F.weekofyear(d).cast("long").alias("iso_week"))


def _period(name: str, t):
    ts = F.timestamp_millis(t)
    if name == "day":
        return day_start(t), F.lit(DAY)
    if name == "week":
        return week_start(t), F.lit(7 * DAY)
    unit = {"month": 1, "year": 12}[name]
    start = F.date_trunc(name, ts)
    return F.unix_millis(start), F.unix_millis((start + F.make_interval(F.lit(0), F.lit(unit))).cast("timestamp")) - F.unix_millis(start)


def profile(df: DataFrame, time: str, value: str, key: str, period: str = "day", resolution: int = HOUR, discard: bool = False, category=None, rows: int = ROWS) -> DataFrame:
    """What a typical period looks like: per bin, mean and sample deviation over periods of the periods' bin means.

    Days have 24 h, weeks start on Monday, months have 31 days and years always
    reserve Feb 29. ``discard`` leaves out periods with a non-finite value, a gap (a
    step of over 1.5 median steps inside of it) or a missing beginning or end.
    Bins that a period cannot have are not expected of it. ``category`` "daytype"
    splits days into workday, saturday and sunday; "combined" into workday and weekend.
    """
    return period_bins(df, time, value, key, period, resolution, discard, category, rows).groupBy("category", "bin").agg(
        F.avg("m").alias("mean"), F.when(F.count("m") > 1, F.stddev_samp("m")).alias("std"), F.count("m").alias("n_periods"), F.count("*").alias("n_expected"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("n_invalid"), F.count("gap").alias("n_gaps"), safe_div(F.count("m").cast("double"), F.count("*").cast("double")).alias("coverage"),
    )


def period_bins(df: DataFrame, time: str, value: str, key: str, period: str = "day", resolution: int = HOUR, discard: bool = False, category=None, rows: int = ROWS) -> DataFrame:
    """A row for each bin that a period of ``profile`` can have: its mean ``m``, rows ``n``, ``invalid`` ones, ``gap`` (1 if one reaches into it), and whether the period is ``partial``."""
    s = df.select(epoch_ms(time).alias("t"), clean(value).alias("v"), F.col(key).alias("_k")).filter("t is not null")
    start, length = _period(period, F.col("t"))
    s = indexed(s.withColumn("p", start.cast("long")).withColumn("len", length.cast("long")), "t", "_k", rows)
    offset = F.col("t") - F.col("p")
    if period == "year":  # dates from March on move past the reserved Feb 29
        common = F.col("len") == 365 * DAY
        offset = F.when(common & (offset >= 59 * DAY), offset + DAY).otherwise(offset)
    s = s.withColumn("bin", F.floor(offset / resolution).cast("long"))
    n_bins = -(-{"day": DAY, "week": 7 * DAY, "month": 31 * DAY, "year": 366 * DAY}[period] // resolution)
    tol = 1.5 * median_step(s, rows)
    steps = with_previous(s, ["t", "p", "bin"], rows).filter((F.col("prev_p") == F.col("p")) & (F.col("t") - F.col("prev_t") > tol))
    gaps = steps.select("p", F.explode(F.sequence("prev_bin", "bin")).alias("bin")).distinct().withColumn("gap", F.lit(1))
    by_bin = s.groupBy("p", "bin").agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("invalid"))
    lo, hi = s.agg(F.min("t"), F.max("t")).first()
    if lo is None:
        lo = hi = 0
    periods = s.groupBy("p", "len").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(F.col("v").isNull()).alias("p_invalid"))
    end = F.col("p") + F.col("len")
    cut = (F.lit(lo) > F.col("p") + tol) | (F.lit(hi) < end - tol)
    late = (F.col("first") > F.greatest(F.col("p"), F.lit(lo)) + tol) | (F.col("last") < F.least(end, F.lit(hi)) - tol)
    periods = periods.withColumn("partial", cut | late).join(gaps.select("p").distinct().withColumn("p_gap", F.lit(True)), "p", "left").fillna({"p_gap": False})
    day = weekday(F.col("p"))
    kinds = {None: F.lit("all"), "daytype": F.when(day < 5, "workday").when(day == 5, "saturday").otherwise("sunday"), "combined": F.when(day < 5, "workday").otherwise("weekend")}
    periods = periods.withColumn("category", kinds[category])
    if discard:
        periods = periods.filter(~F.col("partial") & ~F.col("p_gap") & (F.col("p_invalid") == 0))
    bins = periods.select("p", "len", "category", "partial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))).alias("bin"))
    at = F.col("bin") * resolution
    if period == "month":
        bins = bins.filter(at < F.col("len"))
    elif period == "year":
        bins = bins.filter((F.col("len") == 366 * DAY) | (at < 59 * DAY) | (at + resolution > 60 * DAY))
    return bins.join(by_bin, ["p", "bin"], "left").join(gaps, ["p", "bin"], "left")
