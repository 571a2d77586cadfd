"""The registered queries of the time-series operators, each beside the SQL that says the same."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import axes
from ..functions.durations import duration_ms
from ..functions.exprs import DAY, HOUR, epoch_ms
from ..functions.formula import compile_formula
from ..operators import aggregates as agg
from ..operators import calendar as cal
from ..operators import cursor, display, histograms, intervals, lookup, overlay, project, sliding, tools
from ..operators import series as ser
from ..operators.ordering import indexed
from ..operators.spectrum import regularity, spectrum
from ..sources import delimited
from ..streaming import live, tail
from .registry import query, table

T0, T1 = 1_704_412_800_000, 1_705_017_600_000  # 2024-01-05 and 2024-01-12
MS = "CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT)"
EVENTS = f"e AS (SELECT event_id, {MS} AS t, value AS v FROM events)"
#: events with missing values
HOLES = f"e AS (SELECT event_id, {MS} AS t, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events)"
RANGE = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 00:00:00.001'"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def events(spark, sf):
    return ser.series(table(spark, sf, "events"), "ts", "value", "event_id")


def holes(spark, sf):
    df = table(spark, sf, "events")
    return ser.series(df.withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value"))), "ts", "value", "event_id")


@query("envelope_bucketed", f"""
SELECT CAST(least(99, greatest(0, floor((t - {T0}) * 100 / 604800000.0))) AS BIGINT) AS bucket, min(t) AS t_lo, max(t) AS t_hi, min(v) AS value_min, max(v) AS value_max
FROM (SELECT {MS} AS t, value AS v FROM events WHERE {RANGE}) GROUP BY 1""")
def envelope_bucketed(spark, sf):
    return agg.envelope(table(spark, sf, "events"), "ts", ["value"], T0, T1, 200)


@query("envelope_multi_var", """
SELECT CAST(least(199, greatest(0, floor((t - 788918400000) * 200 / 210000000000.0))) AS BIGINT) AS bucket, min(t) AS t_lo, max(t) AS t_hi,
       min(a) AS l_quantity_min, max(a) AS l_quantity_max, min(b) AS l_extendedprice_min, max(b) AS l_extendedprice_max
FROM (SELECT CAST(floor(epoch_us(l_shipdate) / 1000.0) AS BIGINT) AS t, CAST(l_quantity AS DOUBLE) AS a, l_extendedprice AS b FROM lineitem) WHERE t BETWEEN 788918400000 AND 998918400000 GROUP BY 1""")
def envelope_multi_var(spark, sf):
    return agg.envelope(table(spark, sf, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice"], 788918400000, 998918400000, 400)


@query("raw_range", f"SELECT {MS} AS t, value FROM events WHERE {RANGE}")
def raw_range(spark, sf):
    return agg.raw_range(table(spark, sf, "events"), "ts", ["value"], T0, T1)


@query("missing_buckets", f"""
SELECT CAST(least(49, greatest(0, floor((t - {T0}) / 604800000.0 * 50))) AS BIGINT) AS bucket, count(*) AS n_total, CAST(count(*) FILTER (v IS NULL) AS BIGINT) AS n_missing, min(t) AS t_min, max(t) AS t_max
FROM (SELECT {MS} AS t, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events WHERE {RANGE}) GROUP BY 1""")
def missing_buckets(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    return agg.missing_buckets(df, "ts", ["value"], T0, T1, 50)


@query("panel_stats", "SELECT min(o_totalprice) AS v_min, max(o_totalprice) AS v_max, round(avg(o_totalprice), 6) AS v_mean, round(sqrt(avg(o_totalprice * o_totalprice)), 6) AS v_rms FROM orders")
def panel_stats(spark, sf):
    return agg.panel_stats(table(spark, sf, "orders"), "o_totalprice").select("v_min", "v_max", *r6("v_mean", "v_rms"))


@query("extent_stats", f"SELECT min({MS}) AS t_min, max({MS}) AS t_max, count(*) AS n FROM events")
def extent_stats(spark, sf):
    return agg.extent(table(spark, sf, "events"), "ts")


@query("bounds_count", "SELECT CAST(count(*) FILTER (o_totalprice < 50000 OR o_totalprice > 300000) AS BIGINT) AS n_out, count(o_totalprice) AS n_finite FROM orders")
def bounds_count(spark, sf):
    return agg.bounds_count(table(spark, sf, "orders"), "o_totalprice", 50000, 300000)


@query("bounds_mask", f"WITH {EVENTS} SELECT t, CASE WHEN v BETWEEN 20 AND 80 THEN v END AS v FROM e")
def bounds_mask(spark, sf):
    return ser.bounds_mask(table(spark, sf, "events").select(epoch_ms("ts").alias("t"), F.col("value").alias("v")), 20, 80)


@query("pair_correlation", """
SELECT regr_count(l_extendedprice, l_quantity) AS n, count(*) AS n_scope, CAST(0 AS BIGINT) AS n_excluded, round(avg(l_quantity), 6) AS mean_x, round(avg(l_extendedprice), 6) AS mean_y,
       round(stddev_samp(l_quantity), 6) AS std_x, round(stddev_samp(l_extendedprice), 6) AS std_y, round(corr(l_extendedprice, l_quantity), 9) AS r FROM lineitem""")
def pair_correlation(spark, sf):
    out = agg.correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", "n_scope", "n_excluded", *r6("mean_x", "mean_y", "std_x", "std_y"), F.round("r", 9).alias("r"))


@query("pair_correlation_constant", "SELECT count(*) AS n, CAST(NULL AS DOUBLE) AS r FROM lineitem")
def pair_correlation_constant(spark, sf):
    return agg.correlation(table(spark, sf, "lineitem").withColumn("one", F.lit(7.0)), "one", "l_extendedprice").select("n", "r")


@query("linear_fit", """
SELECT regr_count(l_extendedprice, l_quantity) AS n, round(regr_intercept(l_extendedprice, l_quantity), 5) AS b0, round(regr_slope(l_extendedprice, l_quantity), 5) AS b1,
       round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem""")
def linear_fit(spark, sf):
    out = agg.linear_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", F.round("b0", 5).alias("b0"), F.round("b1", 5).alias("b1"), F.round("r2", 8).alias("r2"))


@query("quadratic_moments", """
WITH m AS (SELECT avg(l_quantity) AS mx, stddev_samp(l_quantity) AS sx FROM lineitem), u AS (SELECT (l_quantity - mx) / sx AS u, l_extendedprice AS y FROM lineitem, m)
SELECT round(count(*), 3) AS s0, round(sum(u * u), 3) AS s2, round(sum(u * u * u), 3) AS s3, round(sum(u * u * u * u), 3) AS s4, round(sum(y), 1) AS t0, round(sum(u * y), 1) AS t1, round(sum(u * u * y), 1) AS t2 FROM u""")
def quadratic_moments(spark, sf):
    out = agg.quadratic_moments(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(*[F.round(c, 3).alias(c) for c in ("s0", "s2", "s3", "s4")], *[F.round(c, 1).alias(c) for c in ("t0", "t1", "t2")])


@query("quadratic_fit", """
WITH m AS (SELECT avg(l_quantity) AS mx, stddev_samp(l_quantity) AS sx FROM lineitem), u AS (SELECT (l_quantity - mx) / sx AS u, l_extendedprice AS y, mx, sx FROM lineitem, m),
s AS (SELECT count(*) AS s0, sum(u) AS s1, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(y) AS t0, sum(u * y) AS t1, sum(u * u * y) AS t2, sum(y * y) AS yy, any_value(mx) AS mx, any_value(sx) AS sx FROM u),
d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS d FROM s),
f AS (SELECT *, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / d AS p0, (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / d AS p1,
             (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / d AS p2 FROM d), e AS (SELECT *, greatest(0, yy - (p0 * t0 + p1 * t1 + p2 * t2)) AS sse, yy - t0 * t0 / s0 AS sst FROM f)
SELECT round(p2 / (sx * sx), 4) AS a, round(p1 / sx - 2 * p2 * mx / (sx * sx), 3) AS b, round(p0 - p1 * mx / sx + p2 * mx * mx / (sx * sx), 2) AS c, round(1 - sse / sst, 6) AS r2, round(sqrt(sse / s0), 3) AS rmse FROM e""")
def quadratic_fit(spark, sf):
    fit = agg.quadratic_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice") or dict.fromkeys(("a", "b", "c", "r2", "rmse"))
    digits = {"a": 4, "b": 3, "c": 2, "r2": 6, "rmse": 3}
    return spark.range(1).select(*[F.round(F.lit(v).cast("double"), digits[k]).alias(k) for k, v in fit.items()])


@query("fit_curve", "WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT i AS id, lo + (hi - lo) * i / 199 AS x, round(1 + 2 * (lo + (hi - lo) * i / 199) + 3 * (lo + (hi - lo) * i / 199) * (lo + (hi - lo) * i / 199), 6) AS y FROM e, range(200) r(i)")
def fit_curve(spark, sf):
    return agg.fit_curve(table(spark, sf, "lineitem"), "l_quantity", (1.0, 2.0, 3.0)).select("id", "x", *r6("y"))


def _histogram_sql(k: str) -> str:
    return f"""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders),
k AS (SELECT *, CAST({k} AS BIGINT) AS k FROM s), c AS (SELECT CAST(least(k - 1, floor((o_totalprice - lo) / ((hi - lo) / k))) AS BIGINT) AS bin, count(*) AS m FROM orders, k GROUP BY 1),
b AS (SELECT i AS bin, k.* FROM k, range(1000) r(i) WHERE i < k)
SELECT bin, coalesce(m, 0) AS n, round(100.0 * coalesce(m, 0) / n, 6) AS percent, round(coalesce(m, 0) / (n * ((hi - lo) / k)), 12) AS density, CAST(sum(coalesce(m, 0)) OVER (ORDER BY bin) AS BIGINT) AS cumulative FROM b LEFT JOIN c USING (bin)"""


def _histogram(df, **how):
    return agg.histogram(df, "o_totalprice", **how).select("bin", "n", F.round("percent", 6).alias("percent"), F.round("density", 12).alias("density"), "cumulative")


@query("histogram_count", _histogram_sql("30"))
def histogram_count(spark, sf):
    return _histogram(table(spark, sf, "orders"), bins=30)


@query("histogram_auto_fd", _histogram_sql("least(200, greatest(1, ceil((hi - lo) / (2 * (q3 - q1) / cbrt(n)))))"))
def histogram_auto_fd(spark, sf):
    return _histogram(table(spark, sf, "orders"))


@query("histogram_width", _histogram_sql("least(500, ceil((hi - lo) / 10000.0))").replace("(hi - lo) / k)", "(hi - lo) / k)"))
def histogram_width(spark, sf):
    return _histogram(table(spark, sf, "orders"), width=10000.0)


D = "CAST(floor(epoch_us(o_orderdate) / 1000.0) AS BIGINT)"
CELLS = "count(*) AS n_scope, count(v) AS n_finite, round(avg(v), 6) AS mean_v, min(v) AS min_v, max(v) AS max_v, round(sum(v), 2) AS sum_v"


def _cells(df):
    return df.select("col_start", "row_idx", "n_scope", "n_finite", F.round("mean_v", 6).alias("mean_v"), "min_v", "max_v", F.round("sum_v", 2).alias("sum_v"))


@query("heatmap_week_day", f"WITH b AS (SELECT {D} // 86400000 AS d, o_totalprice AS v FROM orders) SELECT (d - ((d + 3) % 7)) * 86400000 AS col_start, (d + 3) % 7 + 1 AS row_idx, {CELLS} FROM b GROUP BY 1, 2")
def heatmap_week_day(spark, sf):
    return _cells(cal.heatmap(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


@query("heatmap_day_hour", f"WITH {HOLES} SELECT t - t % 86400000 AS col_start, t % 86400000 // 3600000 AS row_idx, {CELLS} FROM e GROUP BY 1, 2")
def heatmap_day_hour(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    return _cells(cal.heatmap(df, "ts", "value", "day_hour"))


@query("heatmap_dense", f"""
WITH b AS (SELECT {D} // 86400000 AS d, o_totalprice AS v FROM orders), c AS (SELECT (d - ((d + 3) % 7)) * 86400000 AS col_start, (d + 3) % 7 + 1 AS row_idx, count(*) AS n FROM b GROUP BY 1, 2),
g AS (SELECT unnest(range(lo, hi + 1, 604800000)) AS col_start FROM (SELECT min(col_start) AS lo, max(col_start) AS hi FROM c))
SELECT g.col_start, i AS row_idx, n FROM g CROSS JOIN range(1, 8) r(i) LEFT JOIN c ON c.col_start = g.col_start AND c.row_idx = i""")
def heatmap_dense(spark, sf):
    return cal.dense(cal.heatmap(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")).select("col_start", "row_idx", F.col("n_scope").alias("n"))


@query("heatmap_integral_day_hour", f"""
WITH {EVENTS}, s AS (SELECT t, v, lag(t) OVER w AS pt, lag(v) OVER w AS pv FROM e WINDOW w AS (ORDER BY t, event_id)), m AS (SELECT median(t - pt) AS med FROM s WHERE t > pt),
c AS (SELECT s.*, t - pt > 1.5 * med AS gap, unnest(range(pt // 3600000, (t - 1) // 3600000 + 1)) * 3600000 AS cell FROM s, m WHERE t > pt),
a AS (SELECT *, greatest(pt, cell) AS a, least(t, cell + 3600000) AS b FROM c),
g AS (SELECT cell, bool_or(gap) AS has_gap, sum(CASE WHEN NOT gap THEN (2 * pv + (v - pv) * ((a - pt) + (b - pt)) / (t - pt)) / 2 * (b - a) END) AS area FROM a GROUP BY cell),
h AS (SELECT t - t % 3600000 AS cell, count(*) AS n_scope, count(v) AS n_finite FROM e GROUP BY 1)
SELECT cell - cell % 86400000 AS col_start, cell % 86400000 // 3600000 AS row_idx, n_scope, n_finite, has_gap, CASE WHEN NOT has_gap THEN round(area / 3600000, 6) END AS integral FROM h FULL JOIN g USING (cell)""")
def heatmap_integral_day_hour(spark, sf):
    out = cal.heatmap_integral(table(spark, sf, "events"), "ts", "value", "event_id")
    return out.select("col_start", "row_idx", "n_scope", "n_finite", "has_gap", *r6("integral"))


@query("iso_week_labels", f"WITH b AS (SELECT DISTINCT {D} // 86400000 AS d FROM orders), w AS (SELECT DISTINCT d - ((d + 3) % 7) AS w FROM b) SELECT w * 86400000 AS week, isoyear(DATE '1970-01-01' + CAST(w AS INTEGER)) AS iso_year, week(DATE '1970-01-01' + CAST(w AS INTEGER)) AS iso_week FROM w")
def iso_week_labels(spark, sf):
    return cal.iso_week(table(spark, sf, "orders"), "o_orderdate")


@query("profile_day_all", f"""
WITH {EVENTS}, bin AS (SELECT t - t % 86400000 AS p, t % 86400000 // 3600000 AS bin, avg(v) AS m FROM e GROUP BY 1, 2), per AS (SELECT count(DISTINCT p) AS n_expected FROM bin)
SELECT bin, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, count(m) AS n_periods, any_value(n_expected) AS n_expected FROM bin, per GROUP BY bin""")
def profile_day_all(spark, sf):
    return cal.profile(table(spark, sf, "events"), "ts", "value", "event_id").select("bin", *r6("mean", "std"), "n_periods", "n_expected")


@query("profile_day_type", f"""
WITH {HOLES}, q AS (SELECT *, t - t % 86400000 AS p, t % 86400000 // 3600000 AS bin FROM e), b AS (SELECT p, bin, avg(v) AS m, count(*) FILTER (v IS NULL) AS inv FROM q GROUP BY 1, 2),
p AS (SELECT DISTINCT p, CASE WHEN (p // 86400000 + 3) % 7 < 5 THEN 'workday' WHEN (p // 86400000 + 3) % 7 = 5 THEN 'saturday' ELSE 'sunday' END AS category FROM q), g AS (SELECT p, category, i AS bin FROM p, range(24) r(i))
SELECT category, bin, round(avg(m), 6) AS mean, round(CASE WHEN count(m) > 1 THEN stddev_samp(m) END, 6) AS std, count(m) AS n_periods, count(*) AS n_expected, CAST(coalesce(sum(inv), 0) AS BIGINT) AS n_invalid FROM g LEFT JOIN b USING (p, bin) GROUP BY 1, 2""")
def profile_day_type(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    return cal.profile(df, "ts", "value", "event_id", category="daytype").select("category", "bin", *r6("mean", "std"), "n_periods", "n_expected", "n_invalid")


@query("profile_week", f"""
WITH b AS (SELECT {D} AS t, o_totalprice AS v FROM orders), q AS (SELECT t, v, (t // 86400000 - (t // 86400000 + 3) % 7) * 86400000 AS p FROM b), c AS (SELECT p, (t - p) // 86400000 AS bin, avg(v) AS m FROM q GROUP BY 1, 2), n AS (SELECT count(DISTINCT p) AS n_expected FROM q)
SELECT bin, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std, count(m) AS n_periods, any_value(n_expected) AS n_expected FROM c, n GROUP BY bin""")
def profile_week(spark, sf):
    out = cal.profile(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderkey", period="week", resolution=DAY)
    return out.select("bin", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n_periods", "n_expected")


@query("profile_month", f"""
WITH b AS (SELECT date_trunc('month', o_orderdate) AS p, day(o_orderdate) - 1 AS bin, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2), p AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS p FROM orders),
g AS (SELECT p, i AS bin FROM p, range(31) r(i) WHERE i < day(last_day(p)))
SELECT bin, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std, count(m) AS n_periods, count(*) AS n_expected FROM g LEFT JOIN b USING (p, bin) GROUP BY bin""")
def profile_month(spark, sf):
    out = cal.profile(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderkey", period="month", resolution=DAY)
    return out.select("bin", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n_periods", "n_expected")


@query("profile_year_day", """
WITH b AS (SELECT year(o_orderdate) AS p, dayofyear(o_orderdate) - 1 + CASE WHEN NOT (year(o_orderdate) % 4 = 0) AND dayofyear(o_orderdate) >= 60 THEN 1 ELSE 0 END AS bin, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2),
p AS (SELECT DISTINCT year(o_orderdate) AS p FROM orders), g AS (SELECT p, i AS bin FROM p, range(366) r(i) WHERE p % 4 = 0 OR i <> 59)
SELECT bin, round(avg(m), 4) AS mean, count(m) AS n_periods, count(*) AS n_expected FROM g LEFT JOIN b USING (p, bin) GROUP BY bin""")
def profile_year_day(spark, sf):
    out = cal.profile(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderkey", period="year", resolution=DAY)
    return out.select("bin", F.round("mean", 4).alias("mean"), "n_periods", "n_expected")


@query("profile_day_discard", f"""
WITH h AS (SELECT {MS} // 3600000 * 3600000 AS t, avg(value) AS v FROM events GROUP BY 1), s AS (SELECT t, v, t - t % 86400000 AS p, t % 86400000 // 3600000 AS bin, lag(t) OVER (ORDER BY t) AS pt FROM h),
m AS (SELECT 1.5 * median(t - pt) AS tol, min(t) AS lo, max(t) AS hi FROM s WHERE t > pt OR pt IS NULL), g AS (SELECT DISTINCT p FROM s, m WHERE pt >= p AND t - pt > tol),
d AS (SELECT p, min(t) AS first, max(t) AS last FROM s GROUP BY p), k AS (SELECT p FROM d, m WHERE NOT (lo > p + tol OR hi < p + 86400000 - tol) AND NOT (first > greatest(p, lo) + tol OR last < least(p + 86400000, hi) - tol) AND p NOT IN (SELECT p FROM g))
SELECT 'all' AS category, CAST(i AS BIGINT) AS bin, round(avg(v), 6) AS mean, round(CASE WHEN count(v) > 1 THEN stddev_samp(v) END, 6) AS std, count(v) AS n_periods, count(*) AS n_expected, count(v) * 1.0 / count(*) AS coverage
FROM k CROSS JOIN range(24) r(i) LEFT JOIN s ON s.p = k.p AND s.bin = i GROUP BY i""")
def profile_day_discard(spark, sf):
    hourly = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value")).withColumn("id", F.unix_seconds(F.col("ts").cast("timestamp")))
    return cal.profile(hourly, "ts", "value", "id", discard=True).select("category", "bin", *r6("mean", "std"), "n_periods", "n_expected", "coverage")


@query("sampling_gaps", f"""
WITH {EVENTS}, d AS (SELECT t, lag(t) OVER (ORDER BY t, event_id) AS p FROM e), m AS (SELECT median(t - p) AS med FROM d WHERE t > p)
SELECT p AS t0, t AS t1, t - p AS dt, CAST(greatest(1, round((t - p) / med) - 1) AS BIGINT) AS missing FROM d, m WHERE t - p > 1.5 * med""")
def sampling_gaps(spark, sf):
    return ser.sampling_gaps(events(spark, sf))


@query("time_stats", f"WITH {EVENTS}, d AS (SELECT t, lag(t) OVER (ORDER BY t, event_id) AS p FROM e) SELECT count(*) AS n, min(t) AS t_min, max(t) AS t_max, median(t - p) FILTER (t > p) AS median_step FROM d")
def time_stats(spark, sf):
    return ser.time_stats(events(spark, sf))


@query("nan_runs", f"""
WITH {HOLES}, r AS (SELECT t, v, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS last_good,
  first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER (ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS first_good FROM e)
SELECT last_good, first_good, count(*) AS n FROM r WHERE v IS NULL GROUP BY 1, 2""")
def nan_runs(spark, sf):
    # runs between samples of the same two times are one row of the SQL
    return ser.nan_runs(holes(spark, sf)).groupBy("last_good", "first_good").agg(F.sum("n").alias("n"))


_NEAR = "SELECT event_id, t, v, lag(t) OVER w AS pt, lag(v) OVER w AS pv, lead(t) OVER w AS nt, lead(v) OVER w AS nv FROM e WINDOW w AS (ORDER BY t, event_id)"


def _derivative_sql(lo: str, hi: str) -> str:
    ends = [f"coalesce({x}t, t)" if x else "t" for x in (lo, hi)], [f"CASE WHEN {x}t IS NULL THEN v ELSE {x}v END" if x else "v" for x in (lo, hi)]
    return f"""WITH {EVENTS}, n AS ({_NEAR}), f AS (SELECT event_id, {ends[0][0]} AS a, {ends[0][1]} AS b, {ends[1][0]} AS x, {ends[1][1]} AS y FROM n) SELECT event_id AS key, round(1000.0 * (y - x) / nullif(b - a, 0), 6) AS d FROM f"""


@query("derivative_centered", _derivative_sql("p", "n"))
def derivative_centered(spark, sf):
    return ser.derivative(events(spark, sf)).select("key", F.round(F.nanvl("d", F.lit(None)), 6).alias("d"))


@query("derivative_forward", f"WITH {EVENTS}, n AS ({_NEAR}) SELECT event_id AS key, round(CASE WHEN nt IS NULL THEN 1000.0 * (v - pv) / nullif(t - pt, 0) ELSE 1000.0 * (nv - v) / nullif(nt - t, 0) END, 6) AS d FROM n")
def derivative_forward(spark, sf):
    return ser.derivative(events(spark, sf), "forward").select("key", F.round(F.nanvl("d", F.lit(None)), 6).alias("d"))


@query("derivative_backward", f"WITH {EVENTS}, n AS ({_NEAR}) SELECT event_id AS key, round(CASE WHEN pt IS NULL THEN 1000.0 * (nv - v) / nullif(nt - t, 0) ELSE 1000.0 * (v - pv) / nullif(t - pt, 0) END, 6) AS d FROM n")
def derivative_backward(spark, sf):
    return ser.derivative(events(spark, sf), "backward").select("key", F.round(F.nanvl("d", F.lit(None)), 6).alias("d"))


@query("integral_trapezoidal", f"WITH {HOLES}, n AS ({_NEAR}) SELECT event_id AS key, round(sum(coalesce((v + pv) / 2 * (t - pt) / 1000.0, 0)) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 3) AS integral FROM n")
def integral_trapezoidal(spark, sf):
    return ser.integral(holes(spark, sf)).select("key", F.round("integral", 3).alias("integral"))


@query("integral_rectangular", f"WITH {HOLES}, n AS ({_NEAR}) SELECT event_id AS key, round(sum(CASE WHEN v IS NULL THEN 0 ELSE coalesce(pv * (t - pt) / 1000.0, 0) END) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 3) AS integral FROM n")
def integral_rectangular(spark, sf):
    return ser.integral(holes(spark, sf), "rectangular").select("key", F.round("integral", 3).alias("integral"))


@query("moving_average", f"WITH {HOLES} SELECT event_id AS key, round(avg(v) OVER (ORDER BY t, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS ma FROM e")
def moving_average(spark, sf):
    return ser.moving_average(holes(spark, sf)).select("key", *r6("ma"))


_IQR = "q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM e)"


@query("outliers_iqr", f"WITH {EVENTS}, {_IQR} SELECT event_id AS key, v FROM e, q WHERE v < q1 - 0.2 * (q3 - q1) OR v > q3 + 0.2 * (q3 - q1)")
def outliers_iqr(spark, sf):
    return ser.outliers_iqr(events(spark, sf), 0.2).filter("outlier").select("key", "v")


@query("outliers_bounds", f"WITH {EVENTS} SELECT event_id AS key, v FROM e WHERE v < 10 OR v > 90")
def outliers_bounds(spark, sf):
    return ser.outliers_bounds(events(spark, sf), 10, 90).filter("outlier").select("key", "v")


@query("outliers_iqr_interpolate", f"""
WITH {EVENTS}, {_IQR}, i AS (SELECT event_id, v, row_number() OVER (ORDER BY t, event_id) AS i, v < q1 - 0.2 * (q3 - q1) OR v > q3 + 0.2 * (q3 - q1) AS o FROM e, q),
n AS (SELECT *, last_value(CASE WHEN NOT o THEN {{'i': i, 'v': v}} END IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS a, first_value(CASE WHEN NOT o THEN {{'i': i, 'v': v}} END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM i)
SELECT event_id AS key, round(CASE WHEN o THEN a.v + (b.v - a.v) * (i - a.i) / (b.i - a.i) ELSE v END, 6) AS v FROM n""")
def outliers_iqr_interpolate(spark, sf):
    out = ser.replaced(ser.outliers_iqr(events(spark, sf), 0.2), "linear")
    return out.select("key", F.round(F.nanvl("v", F.lit(None)), 6).alias("v"))


_EPS32 = "32 * pow(2, -52)"


@query("spike_outliers", f"""
WITH {EVENTS}, x AS (SELECT event_id AS key, t, CASE WHEN event_id % 97 = 0 THEN v * 10 ELSE v END AS v, row_number() OVER (ORDER BY t, event_id) - 1 AS i FROM e),
m AS (SELECT *, median(v) OVER w AS med, 1.4826 * mad(v) OVER w AS s, count(v) OVER w AS n FROM x WINDOW w AS (ORDER BY i ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)),
f AS (SELECT i, i - row_number() OVER (ORDER BY i) AS g FROM m WHERE n >= 3 AND abs(v - med) > 6 * CASE WHEN s > 0 THEN s ELSE greatest({_EPS32} * greatest(1, abs(med)), 1e-12) END),
r AS (SELECT min(i) AS a, max(i) AS b FROM f GROUP BY g HAVING count(*) <= 6),
d AS (SELECT a, b, median(v) FILTER (i < a) AS lo, median(v) FILTER (i > b) AS hi, median(v) FILTER (i < a OR i > b) AS med, 1.4826 * mad(v) FILTER (i < a OR i > b) AS s, median(v) FILTER (i BETWEEN a AND b) AS run
      FROM r JOIN x ON i BETWEEN a - 25 AND b + 25 GROUP BY a, b),
u AS (SELECT *, 6 * CASE WHEN s > 0 THEN s ELSE greatest({_EPS32} * greatest(1, abs(med)), 1e-12) END AS far FROM d),
l AS (SELECT a, b, any_value(lo) AS lo, any_value(hi) AS hi, any_value(med) AS med, any_value(run) AS run, any_value(far) AS far,
             a - 1 - coalesce(max(i) FILTER (i < a AND abs(v - run) > greatest(far, {_EPS32} * greatest(1, abs(run)), 1e-12)), greatest(a - 8, -1)) AS left_,
             coalesce(min(i) FILTER (i > b AND abs(v - run) > greatest(far, {_EPS32} * greatest(1, abs(run)), 1e-12)), max(i) + 1) - b - 1 AS right_ FROM u JOIN x ON i BETWEEN a - 7 AND b + 7 GROUP BY a, b)
SELECT key, v FROM x JOIN l ON i BETWEEN a AND b WHERE lo IS NOT NULL AND hi IS NOT NULL AND abs(lo - hi) <= far AND b - a + 1 + left_ + right_ <= 6 AND abs(run - med) > far""")
def spike_outliers(spark, sf):
    s = events(spark, sf).withColumn("v", F.when(F.col("key") % 97 == 0, F.col("v") * 10).otherwise(F.col("v")))
    return sliding.outliers_spike(s).filter("outlier").select("key", "v")


@query("rolling_median", f"""
WITH {HOLES} SELECT event_id AS key, count(v) OVER w AS n, round(median(v) OVER w, 6) AS median, round(mad(v) OVER w, 6) AS mad FROM e WINDOW w AS (ORDER BY t, event_id ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING)""")
def rolling_median(spark, sf):
    return sliding.rolling_median(holes(spark, sf)).select("key", "n", *r6("median", "mad"))


@query("tool_pipeline", f"WITH {EVENTS}, m AS (SELECT event_id, t, avg(v) OVER (ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM e), n AS ({_NEAR.replace('FROM e', 'FROM m')}) SELECT event_id AS key, round(sum(coalesce(pv * (t - pt) / 1000.0, 0)) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 3) AS integral FROM n")
def tool_pipeline(spark, sf):
    steps = [tools.Step("moving_average", "v", params={"window": 5}), tools.Step("integral", "v", "integral", {"how": "rectangular"})]
    return tools.replay(events(spark, sf), tools.from_json(tools.to_json(steps))).select("key", F.round("integral", 3).alias("integral"))


@query("project_replay", f"""
WITH e AS (SELECT event_id, {MS} AS t, -2.0 * value + 5 AS v FROM events WHERE {MS} BETWEEN {T0} AND {T1}), m AS (SELECT event_id, t, v, avg(v) OVER (ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM e),
r AS (SELECT event_id, t, v - smooth AS rest, v FROM m), n AS (SELECT *, lag(t) OVER w AS pt, lag(rest) OVER w AS p FROM r WINDOW w AS (ORDER BY t, event_id))
SELECT event_id AS key, CAST(t + 3600000 AS DOUBLE) AS t, round(rest, 6) AS rest, round(sum(coalesce(p * (t - pt) / 1000.0, 0)) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 3) AS area FROM n""")
def project_replay(spark, sf):
    """A transform, a formula and two tools in an order of reading, kept as text and replayed for two columns."""
    made = (
        project.Definition("area", "integral", "rest", {"how": "rectangular"}),
        project.Definition("rest", params={"text": "value - smooth"}),
        project.Definition("smooth", "moving_average", "value", {"window": 5}),
        project.Definition("unused", params={"text": "area ^ 2"}),
    )
    transform = project.FileTransform(gain=2.0, offset=5.0, negate=True, start=T0, end=T1, shift=float(HOUR))
    saved = project.Project({"events": project.File(("value",), transform, made)}).to_json()
    inside = table(spark, sf, "events").filter(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")))
    frame = ser.series(inside, "ts", "value", "event_id")
    out = project.Project.from_json(saved).replay({"events": frame.withColumnRenamed("v", "value")}, {"events": ["rest", "area"]})["events"]
    return out.join(frame.select("_i", "key"), "_i").select("key", F.col("t").cast("double").alias("t"), *r6("rest"), F.round("area", 3).alias("area"))


X = 1_705_000_000_000
_TURN = f"WITH {EVENTS}, n AS ({_NEAR}) SELECT t, v FROM n WHERE v {{0}} pv AND v {{0}} nv AND t {{1}} {X} ORDER BY t {{2}} LIMIT 1"


@query("next_max", _TURN.format(">", ">", "ASC"))
def next_max(spark, sf):
    return ser.extremum(events(spark, sf), X)


@query("next_min", _TURN.format("<", ">", "ASC"))
def next_min(spark, sf):
    return ser.extremum(events(spark, sf), X, "min")


@query("prev_max", _TURN.format(">", "<", "DESC"))
def prev_max(spark, sf):
    return ser.extremum(events(spark, sf), X, forward=False)


@query("next_zero", f"WITH {EVENTS.replace('value AS v', 'value - 50 AS v')}, n AS ({_NEAR}) SELECT round(min(z), 3) AS t FROM (SELECT CASE WHEN v = 0 THEN t WHEN pv = 0 THEN pt WHEN v * pv < 0 THEN pt - pv * (t - pt) / (v - pv) END AS z FROM n) WHERE z > {X}")
def next_zero(spark, sf):
    return ser.zero_crossing(events(spark, sf).withColumn("v", F.col("v") - 50), X).select(F.round("t", 3).alias("t"))


@query("next_sample", f"WITH {EVENTS} SELECT min(t) AS t FROM e WHERE t > {X}")
def next_sample(spark, sf):
    return cursor.next_sample(table(spark, sf, "events"), "ts", X)


@query("interpolate_at", f"WITH {EVENTS}, a AS (SELECT * FROM e WHERE t <= {X} ORDER BY t DESC LIMIT 1), b AS (SELECT * FROM e WHERE t > {X} ORDER BY t LIMIT 1) SELECT {X}::DOUBLE AS x, round(a.v + (b.v - a.v) * ({X}.0 - a.t) / (b.t - a.t), 6) AS v FROM a, b")
def interpolate_at(spark, sf):
    return cursor.interpolate_at(table(spark, sf, "events"), "ts", "value", "event_id", X).select("x", *r6("v"))


@query("source_window", f"WITH {EVENTS} (SELECT t, v FROM e WHERE t <= {X} ORDER BY t DESC LIMIT 20) UNION ALL (SELECT t, v FROM e WHERE t > {X} ORDER BY t LIMIT 20)")
def source_window(spark, sf):
    return cursor.around(table(spark, sf, "events"), "ts", "value", "event_id", X, 20).select("t", "v")


_AT = "(SELECT a.v + (b.v - a.v) * ({x} - a.t) / (b.t - a.t) FROM (SELECT * FROM e WHERE t <= {x} ORDER BY t DESC, event_id DESC LIMIT 1) a, (SELECT * FROM e WHERE t > {x} ORDER BY t, event_id LIMIT 1) b)"


@query("cursor_measures", f"""
WITH {EVENTS}, m AS (SELECT {_AT.format(x=f"{X}.0")} AS v1, {_AT.format(x=f"{X + 9_000_000}.0")} AS v2)
SELECT round(v1, 6) AS v1, round(v2, 6) AS v2, CAST(9000000 AS BIGINT) AS dt, round(v2 - v1, 6) AS dv, round((v2 - v1) / 9000.0, 9) AS slope FROM m""")
def cursor_measures(spark, sf):
    out = cursor.measures(table(spark, sf, "events"), "ts", "value", "event_id", X, X + 9_000_000)
    return out.select(*r6("v1", "v2"), "dt", *r6("dv"), F.round("slope", 9).alias("slope"))


@query("stride_overview", f"WITH {EVENTS}, i AS (SELECT t, v, row_number() OVER (ORDER BY t, event_id) - 1 AS i, count(*) OVER () AS n FROM e) SELECT i AS row, t, v FROM i WHERE i % CAST(ceil(n / 500.0) AS BIGINT) = 0 OR i = n - 1")
def stride_overview(spark, sf):
    return ser.stride(events(spark, sf), 500).select(F.col("_i").alias("row"), "t", "v")


@query("reservoir_overview", "SELECT event_id, value FROM events ORDER BY sha256('42:' || event_id), event_id LIMIT 500")
def reservoir_overview(spark, sf):
    return ser.reservoir(table(spark, sf, "events").select("event_id", "value"), "event_id", 500)


@query("downsample_minmax", f"""
WITH {EVENTS}, i AS (SELECT t, v, row_number() OVER (ORDER BY t, event_id) - 1 AS i, count(*) OVER () AS n FROM e), b AS (SELECT *, (i - 1) // CAST(ceil((n - 2) / 99.0) AS BIGINT) AS b FROM i WHERE i > 0 AND i < n - 1),
p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY v, i) AS lo, row_number() OVER (PARTITION BY b ORDER BY -v, i) AS hi FROM b)
SELECT i AS row, t, v FROM p WHERE lo = 1 OR hi = 1 UNION ALL SELECT i, t, v FROM i WHERE i = 0 OR i = n - 1""")
def downsample_minmax(spark, sf):
    return ser.downsample(events(spark, sf), 200).select(F.col("_i").alias("row"), "t", "v")


@query("transform_gain_shift_crop", f"WITH {EVENTS} SELECT t + 3600000 AS t, -2.0 * v + 5 AS v FROM e WHERE t BETWEEN {T0} AND {T1}")
def transform_gain_shift_crop(spark, sf):
    s = table(spark, sf, "events").select(epoch_ms("ts").alias("t"), F.col("value").alias("v"))
    return ser.transform(s, 2.0, 5.0, True, T0, T1, HOUR).select("t", "v")


@query("elapsed_axis", f"WITH {EVENTS}, o AS (SELECT min(t) AS o FROM e) SELECT event_id AS key, (t - o) / 1000.0 AS elapsed FROM e, o")
def elapsed_axis(spark, sf):
    df = table(spark, sf, "events").select(F.col("event_id").alias("key"), epoch_ms("ts").alias("t"))
    return axes.elapsed(df, "t").select("key", "elapsed")


@query("derived_formula", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / l_quantity - sqrt(l_tax) ^ 2, 6) AS y FROM lineitem")
def derived_formula(spark, sf):
    df = table(spark, sf, "lineitem")
    y = compile_formula("price * (1 - disc) / qty - sqrt(tax) ^ 2", {"price": F.col("l_extendedprice"), "disc": F.col("l_discount"), "qty": F.col("l_quantity"), "tax": F.col("l_tax")})
    return df.select("l_orderkey", "l_linenumber", F.round(y, 6).alias("y"))


@query("root_power_formula", "SELECT event_id AS key, round(-(abs(value - 50) ^ (1.0 / 3)) * CASE WHEN value < 50 THEN -1 ELSE 1 END - value ^ 2, 6) AS y FROM events")
def root_power_formula(spark, sf):
    y = compile_formula("-root(v - 50, 3) - v^2", {"v": F.col("value")})
    return table(spark, sf, "events").select(F.col("event_id").alias("key"), F.round(y, 6).alias("y"))


@query("overlay_union", f"SELECT 'events' AS file, {MS} AS t, value AS v FROM events UNION ALL SELECT 'orders', {D}, o_totalprice FROM orders")
def overlay_union(spark, sf):
    a = table(spark, sf, "events").select(F.lit("events").alias("file"), epoch_ms("ts").alias("t"), F.col("value").alias("v"))
    b = table(spark, sf, "orders").select(F.lit("orders").alias("file"), epoch_ms("o_orderdate").alias("t"), F.col("o_totalprice").alias("v"))
    return a.unionByName(b, allowMissingColumns=True)


@query("overlay_axes", f"""
WITH e AS (SELECT {MS} AS t, value AS v FROM events), o AS (SELECT min(t) AS o FROM e)
SELECT 'clock' AS file, CAST(t AS DOUBLE) AS t, v AS speed FROM e UNION ALL SELECT 'elapsed', CAST(o + (t - o) / 1000.0 * 1000 AS DOUBLE), v * 2 FROM e, o""")
def overlay_axes(spark, sf):
    """The events on calendar time, and twice their values on elapsed time from the first event on, on one axis."""
    rows = table(spark, sf, "events").select(epoch_ms("ts").alias("t"), F.col("value").alias("speed", metadata={"unit": "m/s"}))
    origin = float(rows.agg(F.min("t")).first()[0])
    later = overlay.with_axis(rows.withColumn("speed", (F.col("speed") * 2).alias("speed", metadata={"unit": "m/s"})), axes.Axis("elapsed", origin))
    return overlay.overlaid({"clock": overlay.with_axis(rows, axes.Axis()), "elapsed": later})


@query("pivot_export", f"SELECT {MS} // 86400000 AS day, " + ", ".join(f"round(avg(value) FILTER (event_type = '{e}'), 6) AS {e}" for e in ("click", "purchase", "view")) + " FROM events GROUP BY 1")
def pivot_export(spark, sf):
    df = table(spark, sf, "events").select(F.floor(epoch_ms("ts") / DAY).cast("long").alias("day"), "event_type", "value")
    return df.groupBy("day").pivot("event_type", ["click", "purchase", "view"]).agg(F.avg("value")).select("day", *r6("click", "purchase", "view"))


@query("duplicate_times", f"WITH b AS (SELECT {D} AS t, o_totalprice AS v, o_orderkey AS k FROM orders) SELECT t, arg_max(v, k) AS v FROM b GROUP BY t")
def duplicate_times(spark, sf):
    return ser.duplicate_times(ser.series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderkey")).select("t", "v")


def _hourly(spark, sf):
    return table(spark, sf, "events").groupBy((F.floor(epoch_ms("ts") / HOUR) * HOUR).cast("long").alias("t")).agg(F.avg("value").alias("v"))


_SPECTRUM = f"""
WITH h AS (SELECT {MS} // 3600000 AS h, avg(value) AS v FROM events GROUP BY 1), i AS (SELECT row_number() OVER (ORDER BY h) - 1 AS i, v - avg(v) OVER () AS v, count(*) OVER () AS n FROM h),
w AS (SELECT i, n, v, 0.5 - 0.5 * cos(2 * pi() * i / n) AS w, CAST(2 ^ ceil(log2(n)) AS BIGINT) AS nf FROM i)
SELECT k, round(CASE WHEN k > 0 AND k < any_value(nf) / 2 THEN 2 ELSE 1 END * sqrt(sum(v * w * cos(2 * pi() * k * i / nf)) ^ 2 + sum(v * w * sin(2 * pi() * k * i / nf)) ^ 2) / sum(w), 6) AS amplitude
FROM w, range(600) r(k) WHERE k <= nf / 2 GROUP BY k"""


@query("spectrum_hann", _SPECTRUM)
def spectrum_hann(spark, sf):
    hourly = _hourly(spark, sf)
    s = indexed(hourly, "t", "t").select(F.lit("value").alias("series"), F.col("_i").cast("double").alias("t"), "v")
    return spectrum(s, "series", unit=1.0).select("k", *r6("amplitude"))


_TYPES = f"""
WITH h AS (SELECT event_type AS s, {MS} // 86400000 AS h, avg(value) AS v FROM events GROUP BY 1, 2), i AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY h) - 1 AS i, v - avg(v) OVER (PARTITION BY s) AS v, count(*) OVER (PARTITION BY s) AS n FROM h),
w AS (SELECT s, i, n, v, 0.42 - 0.5 * cos(2 * pi() * i / n) + 0.08 * cos(4 * pi() * i / n) AS w, 4 * CAST(2 ^ ceil(log2(n)) AS BIGINT) AS nf FROM i),
a AS (SELECT s, k, CASE WHEN k > 0 AND k < any_value(nf) / 2 THEN 2 ELSE 1 END * sqrt(sum(v * w * cos(2 * pi() * k * i / nf)) ^ 2 + sum(v * w * sin(2 * pi() * k * i / nf)) ^ 2) / sum(w) AS a FROM w, range(3000) r(k) WHERE k <= nf / 2 GROUP BY s, k),
p AS (SELECT s, max(a) FILTER (k > 0) AS p FROM a GROUP BY s)
SELECT s AS series, k, round(CASE WHEN p <= 1e-10 THEN -200 ELSE greatest(-200, 20 * log10(greatest(a / p, 1e-10))) END, 4) AS amplitude FROM a JOIN p USING (s)"""


@query("spectrum_db", _TYPES)
def spectrum_db(spark, sf):
    """Daily means of each type of event, as three series on their own days."""
    day = F.floor(epoch_ms("ts") / DAY).cast("long")
    daily = table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), day.alias("day")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("series").orderBy("day")
    daily = daily.withColumn("t", F.row_number().over(w).cast("double"))
    out = spectrum(daily, "series", window="blackman", pad=4, scale="relative_db", unit=1.0)
    return out.select("series", "k", F.round("amplitude", 4).alias("amplitude"))


@query("regularity", f"""
WITH e AS (SELECT event_type AS series, {MS} // 3600000 * 3600000 AS t FROM events UNION ALL SELECT 'daily', {MS} // 86400000 * 86400000 FROM events), u AS (SELECT DISTINCT series, CAST(t AS DOUBLE) AS t FROM e),
d AS (SELECT series, t, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS step FROM u), m AS (SELECT series, count(*) AS n, median(step) AS step, max(step) AS hi, min(step) AS lo FROM d GROUP BY series)
SELECT series, n, coalesce(greatest(hi - step, step - lo) / step < 1e-3, false) AS uniform, CASE WHEN greatest(hi - step, step - lo) / step < 1e-3 THEN step END AS step FROM m""")
def regularity_of_types(spark, sf):
    """The hours that have events of each type, and the days that have any."""
    t = epoch_ms("ts")
    df = table(spark, sf, "events").select(F.explode(F.array(
        F.struct(F.col("event_type").alias("series"), (F.floor(t / HOUR) * HOUR).cast("long").alias("t")), F.struct(F.lit("daily").alias("series"), (F.floor(t / DAY) * DAY).cast("long").alias("t")),
    )).alias("x")).select("x.*")
    return regularity(df, "series", "t")


def _folder(spark) -> str:
    """A new folder that the driver and all executors share (a local one in a session of one machine)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tempora-")
    return f"{top.rstrip('/')}/tempora/{uuid.uuid4().hex}"


def _as_text(spark, sf) -> str:
    """The events as a folder of delimited text."""
    path = f"{_folder(spark)}.csv"
    delimited.export(table(spark, sf, "events").withColumn("t", epoch_ms("ts")), ["event_id", "event_type", "value"], path)
    return path


_TEXT = f"SELECT CAST({MS} AS DOUBLE) AS t, CAST(event_id AS DOUBLE) AS event_id, event_type, value FROM events"


@query("csv_read", _TEXT)
def csv_read(spark, sf):
    return delimited.read_delimited(spark, _as_text(spark, sf)).drop("_row")


@query("csv_row_filter", _TEXT + " WHERE event_type = 'purchase'")
def csv_row_filter(spark, sf):
    return delimited.read_delimited(spark, _as_text(spark, sf), keep=delimited.row_filter("event_type", "==", " purchase ")).drop("_row")


@query("csv_to_parquet", _TEXT)
def csv_to_parquet(spark, sf):
    path = f"{_folder(spark)}.parquet"
    delimited.to_parquet(delimited.read_delimited(spark, _as_text(spark, sf)), path)
    return spark.read.parquet(path)


def _read_back(spark, df, **options):
    """A table written as delimited text with a header in each file, and read again."""
    path = f"{_folder(spark)}.csv"
    df.write.options(header=True, **options).csv(path)
    return delimited.read_delimited(spark, path).drop("_row")


def _at(pattern):
    return F.date_format(F.timestamp_millis(epoch_ms("ts")), pattern)


_ROW = f"CAST({MS} AS DOUBLE) AS t, CAST(event_id AS DOUBLE) AS event_id"


@query("csv_decimal_comma", f"SELECT {_ROW}, round(value, 3) AS value FROM events")
def csv_decimal_comma(spark, sf):
    """Semicolons, day before month, and decimal commas."""
    value = F.regexp_replace(F.format_string("%.3f", "value"), r"\.", ",")
    return _read_back(spark, table(spark, sf, "events").select(_at("dd/MM/yyyy HH:mm:ss.SSS").alias("time"), "event_id", value.alias("value [m/s]")), sep=";")


@query("csv_split_time", f"SELECT {_ROW}, event_type FROM events")
def csv_split_time(spark, sf):
    """Date and time of day in two columns, between tabs."""
    return _read_back(spark, table(spark, sf, "events").select(_at("yyyy-MM-dd").alias("date"), _at("HH:mm:ss.SSS").alias("time"), "event_id", "event_type"), sep="\t")


@query("csv_month_names", f"SELECT {_ROW}, 'a, ' || chr(34) || event_type || chr(34) || chr(10) || event_id AS note FROM events")
def csv_month_names(spark, sf):
    """Names of months, and text with commas, quotes and line ends within quotes."""
    note = F.concat(F.lit('a, "'), "event_type", F.lit('"\n'), F.col("event_id").cast("string"))
    return _read_back(spark, table(spark, sf, "events").select(_at("d MMMM yyyy HH:mm:ss.SSS").alias("when"), "event_id", note.alias("note")), escape='"', quoteAll=True)


@query("csv_latin", f"SELECT {_ROW}, CASE event_type WHEN 'view' THEN 'déjà vu' ELSE event_type END AS event_type FROM events")
def csv_latin(spark, sf):
    """Text that is no UTF-8."""
    kind = F.when(F.col("event_type") == "view", "déjà vu").otherwise(F.col("event_type"))
    return _read_back(spark, table(spark, sf, "events").select(_at("yyyy-MM-dd HH:mm:ss.SSS").alias("time"), "event_id", kind.alias("event_type")), encoding="ISO-8859-1")


@query("csv_profile", "SELECT count(*) AS rows, CAST(count(*) FILTER (event_id % 50 = 0) AS BIGINT) AS invalid_times, CAST(count(*) FILTER (event_id % 40 = 0) AS BIGINT) AS invalid_cells FROM events")
def csv_profile(spark, sf):
    """What the check of a whole file counts: rows without a valid time, and cells that are no numbers."""
    path = f"{_folder(spark)}.csv"
    time = F.when(F.col("event_id") % 50 != 0, _at("yyyy-MM-dd HH:mm:ss.SSS")).otherwise("never")
    value = F.when(F.col("event_id") % 40 != 0, F.col("value").cast("string")).otherwise("none")
    table(spark, sf, "events").select(time.alias("time"), value.alias("value"), "event_id").write.csv(path, header=True)
    counts = delimited.inspect(spark, path)[1]
    return spark.createDataFrame([(counts.rows, counts.invalid_times, counts.invalid_cells.get("value", 0))], "rows long, invalid_times long, invalid_cells long")


@query("column_kinds", """SELECT 'l_quantity' AS name, min(l_quantity) = max(l_quantity) AS constant, false AS boolean FROM lineitem
UNION ALL SELECT 'one', true, false UNION ALL SELECT 'returned', false, true""")
def column_kinds(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", F.lit(1).alias("one"), (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return delimited.column_kinds(df, ["l_quantity", "one", "returned"])


@query("time_text", f"SELECT event_id, strftime(make_timestamp({MS} * 1000), '%Y-%m-%d %H:%M:%S.%g') AS at FROM events")
def time_text(spark, sf):
    return table(spark, sf, "events").select("event_id", delimited.time_text(epoch_ms("ts")).alias("at"))


@query("interval_union", f"""
WITH i AS (SELECT {MS} AS a, {MS} + 120000 AS b FROM events), m AS (SELECT a, b, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR a > seen THEN 1 ELSE 0 END) OVER (ORDER BY a, b) AS k FROM m) SELECT min(a) AS a, max(b) AS b FROM g GROUP BY k""")
def interval_union(spark, sf):
    t = epoch_ms("ts")
    return intervals.interval_union(table(spark, sf, "events").select(t.alias("a"), (t + 120_000).alias("b")), "a", "b")


@query("live_append", f"SELECT {MS} AS t, value FROM events")
def live_append(spark, sf):
    """The events as a base and two batches appended to it; events of one millisecond are rows of their own, those without a time are in the base."""
    all_ = table(spark, sf, "events").select(epoch_ms("ts").alias("t"), "value")
    at = live.LiveTable(all_.filter((F.col("t") < T0) | F.col("t").isNull()), _folder(spark), most_rows=None, most_bytes=None, repeats=True)
    at.append(all_.filter((F.col("t") >= T0) & (F.col("t") < T1)), 0)
    at.append(all_.filter(F.col("t") >= T1), 1)
    return at.view()


@query("envelope_zoom", f"""
SELECT min(t) AS t_lo, max(t) AS t_hi, min(v) AS value_min, max(v) AS value_max FROM (SELECT {MS} AS t, value AS v FROM events)
WHERE t // 15360000 BETWEEN {T0} // 15360000 AND {T1} // 15360000 GROUP BY t // 15360000""")
def envelope_zoom(spark, sf):
    """A week of a live table of a base and two batches, from one level of its envelopes: 50 buckets need cells of 256 minutes."""
    all_ = table(spark, sf, "events").select(epoch_ms("ts").alias("t"), "value")
    at = live.LiveTable(all_.filter(F.col("t") < T0), _folder(spark), most_rows=None, most_bytes=None, envelopes=("value",), finest=60_000.0, repeats=True)
    at.append(all_.filter((F.col("t") >= T0) & (F.col("t") < T1 - 3 * DAY)), 0)
    at.append(all_.filter(F.col("t") >= T1 - 3 * DAY), 1)
    return at.zoom(T0, T1, 100)


@query("tail_stream", f"SELECT event_id, {MS} AS t, event_type FROM events")
def tail_stream(spark, sf):
    """The events as text files that a stream follows, read by ranges of bytes and written by its batches."""
    text, out = _folder(spark), _folder(spark)
    table(spark, sf, "events").select(F.concat_ws(";", "event_id", epoch_ms("ts"), "event_type")).write.text(text)
    spark.dataSource.register(tail.TailSource)
    part = F.split("line", ";")
    rows = spark.readStream.format("tail").option("path", text).option("splitBytes", 1 << 20).load()
    rows = rows.select(part[0].cast("long").alias("event_id"), part[1].cast("long").alias("t"), part[2].alias("event_type"))
    run = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.parquet(f"{out}/rows")


@query("parquet_row_count", "SELECT count(*) AS n FROM lineitem")
def parquet_row_count(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("spectrum_display", f"""
WITH s AS ({_SPECTRUM}), n AS (SELECT count(*) AS n FROM s), b AS (SELECT s.*, ((k + 1) * 50 - 1) // n AS b FROM s, n),
r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY amplitude, k) AS lo, row_number() OVER (PARTITION BY b ORDER BY -amplitude, k) AS hi FROM b) SELECT k, amplitude FROM r WHERE lo = 1 OR hi = 1""")
def spectrum_display(spark, sf):
    return display.thinned_spectrum(spectrum_hann(spark, sf), 100)


@query("prev_zero", f"WITH {EVENTS.replace('value AS v', 'value - 50 AS v')}, n AS ({_NEAR}) SELECT round(max(z), 3) AS t FROM (SELECT CASE WHEN v = 0 THEN t WHEN pv = 0 THEN pt WHEN v * pv < 0 THEN pt - pv * (t - pt) / (v - pv) END AS z FROM n) WHERE z < {X}")
def prev_zero(spark, sf):
    return ser.zero_crossing(events(spark, sf).withColumn("v", F.col("v") - 50), X, forward=False).select(F.round("t", 3).alias("t"))


@query("next_zero_step", f"WITH {EVENTS.replace('value AS v', 'value - 50 AS v')}, n AS ({_NEAR}) SELECT CAST(min(z) AS DOUBLE) AS t FROM (SELECT CASE WHEN v = 0 THEN t WHEN pv = 0 THEN pt WHEN v * pv < 0 THEN t END AS z FROM n) WHERE z > {X}")
def next_zero_step(spark, sf):
    return ser.zero_crossing(events(spark, sf).withColumn("v", F.col("v") - 50), X, step=True)


@query("order_violations", f"WITH {EVENTS} SELECT count(*) AS n FROM (SELECT t, lag(t) OVER (ORDER BY event_id) AS p FROM e) WHERE t < p")
def order_violations(spark, sf):
    s = indexed(table(spark, sf, "events").select("event_id", epoch_ms("ts").alias("t")), "event_id", "event_id")
    return spark.range(1).select(F.lit(display.order_violations(s)).cast("long").alias("n"))


_ROWS = f"{EVENTS}, i AS (SELECT t, v, row_number() OVER (ORDER BY t, event_id) - 1 AS i, count(*) OVER () AS n FROM e)"


@query("phase_stride", f"WITH {_ROWS} SELECT i AS row, t, v FROM i WHERE i % CAST(greatest(1, ceil((n - 1) / 299.0)) AS BIGINT) = 0 OR i = n - 1")
def phase_stride(spark, sf):
    return display.phase_stride(ser.phase(events(spark, sf), ["v"]), 300).select(F.col("_i").alias("row"), "t", "v")


@query("index_stride", f"WITH {_ROWS}, p AS (SELECT DISTINCT CAST(CASE WHEN k > 198 THEN n - 1 ELSE floor(k * (n - 1) / 199.0 + 0.5) END AS BIGINT) AS i FROM range(200) r(k), (SELECT any_value(n) AS n FROM i)) SELECT i AS row, t, v FROM i JOIN p USING (i)")
def index_stride(spark, sf):
    return display.index_stride(events(spark, sf), 200).select(F.col("_i").alias("row"), "t", "v")


@query("visible_slice", f"""
WITH {_ROWS}, c AS (SELECT min(i) - 1 AS a, max(i) + 1 AS z FROM i WHERE t BETWEEN {T0} AND {T1}), j AS (SELECT i.i AS row, t, v, i.i - greatest(0, a) AS i, count(*) OVER () AS n FROM i, c WHERE i.i BETWEEN a AND z),
b AS (SELECT *, (i - 1) // CAST(ceil((n - 2) / 49.0) AS BIGINT) AS b FROM j WHERE i > 0 AND i < n - 1),
p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY v, i) AS lo, row_number() OVER (PARTITION BY b ORDER BY -v, i) AS hi FROM b)
SELECT row, t, v FROM p WHERE lo = 1 OR hi = 1 UNION ALL SELECT row, t, v FROM j WHERE i = 0 OR i = n - 1""")
def visible_slice(spark, sf):
    return display.visible(events(spark, sf), T0, T1, 100).select(F.col("_i").alias("row"), "t", "v")


@query("envelope_gap_breaks", f"""
WITH b AS (SELECT CAST(least(999, greatest(0, floor((t - {T0}) * 1000 / 604800000.0))) AS BIGINT) AS b, min(t) AS lo, max(t) AS hi, min(v) AS a, max(v) AS z FROM (SELECT {MS} AS t, value AS v FROM events WHERE {RANGE}) GROUP BY 1),
p AS (SELECT lo AS t, a AS v, 2 * b AS o FROM b UNION ALL SELECT hi, z, 2 * b + 1 FROM b), n AS (SELECT t, v, lead(t) OVER (ORDER BY t, o) AS nt, count(*) OVER () AS n, max(t) OVER () - min(t) OVER () AS span FROM p)
SELECT t, v, false AS put_in FROM n UNION ALL SELECT t, NULL, true FROM n WHERE nt - t > 1.5 * span / (n / 2)""")
def envelope_gap_breaks(spark, sf):
    env = agg.envelope(table(spark, sf, "events"), "ts", ["value"], T0, T1, 2000)
    return display.gap_breaks(agg.envelope_points(env, "value")).select("t", "v", F.col("_break").alias("put_in"))


@query("state_view", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b, l_tax AS da, l_discount - l_tax AS db, sqrt(l_tax * l_tax + (l_discount - l_tax) * (l_discount - l_tax)) AS m FROM lineitem),
k AS (SELECT *, CASE WHEN m > 1e-12 THEN greatest(abs(a), abs(b), 1) * 0.25 / m ELSE 1 END AS k FROM s) SELECT l_orderkey, l_linenumber, round(a + da * k, 6) AS tip1, round(b + db * k, 6) AS tip2 FROM k""")
def state_view(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("rate", F.col("l_discount") - F.col("l_tax"))
    return display.state_view(df, ["l_quantity", "l_discount"], ["l_tax", "rate"]).select("l_orderkey", "l_linenumber", *r6("tip1", "tip2"))


@query("asof_interpolate", f"""
WITH e AS (SELECT event_id, event_type, {MS} AS t, value AS v FROM events), s AS (SELECT t, arg_max(v, event_id) AS v FROM e WHERE event_type = 'click' GROUP BY t), x AS (SELECT event_id AS key, t + 1800000 AS x FROM e WHERE event_type = 'purchase'),
a AS (SELECT key, x, s.t AS ta, s.v AS va FROM x ASOF LEFT JOIN s ON x.x >= s.t), b AS (SELECT key, s.t AS tb, s.v AS vb FROM x ASOF LEFT JOIN s ON x.x < s.t)
SELECT key, x, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va ELSE va + (vb - va) * (x - ta) / (tb - ta) END, 6) AS v FROM a JOIN b USING (key)""")
def asof_interpolate(spark, sf):
    df = table(spark, sf, "events").withColumn("t", epoch_ms("ts"))
    clicks = ser.duplicate_times(ser.series(df.filter("event_type = 'click'"), "ts", "value", "event_id"))
    at = df.filter("event_type = 'purchase'").select(F.col("event_id").alias("key"), (F.col("t") + 1_800_000).alias("x"))
    return lookup.interpolated(clicks, at, "x").select("key", "x", *r6("v"))


@query("profile_period_bins", f"""
WITH {HOLES}, q AS (SELECT *, t - t % 86400000 AS p, t % 86400000 // 3600000 AS bin FROM e), d AS (SELECT t, p, bin, lag(t) OVER w AS pt, lag(p) OVER w AS pp, lag(bin) OVER w AS pb FROM q WINDOW w AS (ORDER BY t, event_id)),
m AS (SELECT median(t - pt) AS med FROM d WHERE t > pt), g AS (SELECT DISTINCT p, unnest(range(pb, bin + 1)) AS bin, true AS gap FROM d, m WHERE p = pp AND t - pt > 1.5 * med),
b AS (SELECT p, bin, avg(v) AS m, count(*) AS n, count(*) FILTER (v IS NULL) AS invalid FROM q GROUP BY 1, 2), f AS (SELECT p, i AS bin FROM (SELECT DISTINCT p FROM q), range(24) r(i))
SELECT p, bin, round(m, 6) AS m, n, invalid, coalesce(gap, false) AS gap FROM f LEFT JOIN b USING (p, bin) LEFT JOIN g USING (p, bin)""")
def profile_period_bins(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    return cal.period_bins(df, "ts", "value", "event_id").select("p", "bin", *r6("m"), "n", "invalid", F.col("gap").isNotNull().alias("gap"))


@query("histogram_traces", """
WITH s AS (SELECT o_orderstatus AS trace, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr FROM orders GROUP BY 1),
k AS (SELECT min(lo) AS lo, max(hi) AS hi, sum(n) AS total, CAST(least(200, max(CASE WHEN n >= 2 AND iqr > 0 THEN ceil((hi - lo) / (2 * iqr / cbrt(n))) ELSE ceil(log2(n) + 1) END)) AS BIGINT) AS k FROM s),
c AS (SELECT o_orderstatus AS trace, CAST(least(k - 1, floor((o_totalprice - lo) / ((hi - lo) / k))) AS BIGINT) AS bin, count(*) AS m FROM orders, k GROUP BY 1, 2),
b AS (SELECT trace, n, CAST(i AS BIGINT) AS bin, k.lo, k.hi, k, total FROM s, k, range(200) r(i) WHERE i < k)
SELECT trace, bin, coalesce(m, 0) AS n, round(100.0 * coalesce(m, 0) / n, 6) AS percent, round(coalesce(m, 0) / (n * ((hi - lo) / k)), 12) AS density,
       CAST(sum(coalesce(m, 0)) OVER (PARTITION BY trace ORDER BY bin) AS BIGINT) AS cumulative, round(CAST(100.0 * coalesce(m, 0) / total AS DOUBLE), 6) AS stacked FROM b LEFT JOIN c USING (trace, bin)""")
def histogram_traces(spark, sf):
    out = histograms.histograms(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "trace"), "trace", "o_totalprice")
    return out.select("trace", "bin", "n", *r6("percent", "stacked"), F.round("density", 12).alias("density"), "cumulative")


@query("histogram_manual_range", """
WITH c AS (SELECT CAST(least(19, floor((o_totalprice - 100000) / 10000.0)) AS BIGINT) AS bin, count(*) AS m FROM orders WHERE o_totalprice BETWEEN 100000 AND 300000 GROUP BY 1), o AS (SELECT CAST(count(*) FILTER (o_totalprice < 100000) AS BIGINT) AS underflow, CAST(count(*) FILTER (o_totalprice > 300000) AS BIGINT) AS overflow FROM orders)
SELECT CAST(i AS BIGINT) AS bin, coalesce(m, 0) AS n, CAST(sum(coalesce(m, 0)) OVER (ORDER BY i) AS BIGINT) AS cumulative, underflow, overflow FROM range(20) r(i) LEFT JOIN c ON bin = i, o""")
def histogram_manual_range(spark, sf):
    return agg.histogram(table(spark, sf, "orders"), "o_totalprice", bins=20, lo=100000.0, hi=300000.0).select("bin", "n", "cumulative", "underflow", "overflow")


@query("histogram_constant", "SELECT CAST(0 AS BIGINT) AS bin, 6.5 AS lo, 7.5 AS hi, count(*) AS n FROM orders")
def histogram_constant(spark, sf):
    return agg.histogram(table(spark, sf, "orders").withColumn("seven", F.lit(7.0)), "seven").select("bin", "lo", "hi", "n")


@query("correlation_report", " UNION ALL ".join(f"""
SELECT '{x}' AS x_name, '{y}' AS y_name, regr_count({y}, {x}) AS n, round(corr({y}, {x}), 8) AS r, round(regr_intercept({y}, {x}), 4) AS b0, round(regr_slope({y}, {x}), 6) AS b1 FROM lineitem""" for x, y in (("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"))))
def correlation_report(spark, sf):
    """The rows of a report as text, written and read again."""
    path = f"{_folder(spark)}.csv"
    out = agg.correlations(table(spark, sf, "lineitem"), ser.pairs(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
    out.coalesce(1).write.csv(path, header=True)
    back = spark.read.schema(out.schema).csv(path, header=True)
    return back.select("x_name", "y_name", "n", F.round("r", 8).alias("r"), F.round("b0", 4).alias("b0"), F.round("b1", 6).alias("b1"))


@query("missing_intervals", f"""
WITH r AS (SELECT {MS} AS t, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events WHERE {RANGE}),
b AS (SELECT CAST(least(499, greatest(0, floor((t - {T0}) / 604800000.0 * 500))) AS BIGINT) AS b, count(*) AS n, count(*) FILTER (v IS NULL) AS m, min(t) AS lo, max(t) AS hi FROM r GROUP BY 1), p AS (SELECT *, lag(hi) OVER (ORDER BY b) AS prev FROM b),
c AS (SELECT list_sort(list(s)) AS s FROM (SELECT (hi - lo) / (n - 1) AS s FROM p WHERE n > 1 AND hi > lo UNION ALL SELECT lo - prev FROM p WHERE lo > prev)), k AS (SELECT p.*, s[len(s) // 2 + 1] AS step, {T0} + b / 500 * 604800000.0 AS x, {T0} + (b + 1) / 500 * 604800000.0 AS y FROM p, c),
i AS (SELECT 'both' AS kind, CAST(prev AS DOUBLE) AS t0, CAST(lo AS DOUBLE) AS t1 FROM k WHERE lo - prev > 1.5 * step UNION ALL SELECT 'both', x, y FROM k WHERE n > 1 AND hi - lo > (n - 0.5) * step
  UNION ALL SELECT 'both', greatest({T0}, lo - step), least({T1}, hi + step) FROM k WHERE m >= n UNION ALL SELECT 'any', x, y FROM k WHERE m > 0 AND m < n),
j AS (SELECT 'any' AS kind, t0, t1 FROM i UNION ALL SELECT 'solid', t0, t1 FROM i WHERE kind = 'both'), s AS (SELECT *, max(t1) OVER (PARTITION BY kind ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM j),
g AS (SELECT *, sum(CASE WHEN seen IS NULL OR t0 > seen THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY t0, t1) AS run FROM s) SELECT kind, round(min(t0), 3) AS t0, round(max(t1), 3) AS t1 FROM g GROUP BY kind, run""")
def missing_intervals(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    out = agg.missing_intervals(agg.missing_buckets(df, "ts", ["value"], T0, T1, 500), T0, T1, 500)
    return out.select("kind", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query("duration_parse", """
SELECT event_id AS key, round(CASE event_id % 4 WHEN 0 THEN user_id * 1000.0 WHEN 1 THEN -(user_id * 86400000.0 + (event_id % 24) * 3600000.0 + (event_id % 60) * 60000.0)
       WHEN 2 THEN user_id * 3600000.0 + (event_id % 60) * 60000.0 ELSE 0 END, 3) AS ms FROM events""")
def duration_parse(spark, sf):
    hours, minutes = F.lpad((F.col("event_id") % 24).cast("string"), 2, "0"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")
    user, form = F.col("user_id").cast("string"), F.col("event_id") % 4
    text = F.when(form == 0, F.concat(user, F.lit(" s"))).when(form == 1, F.concat(F.lit("-"), user, F.lit(" days "), hours, F.lit(":"), minutes))
    text = text.when(form == 2, F.concat(user, F.lit("h "), minutes, F.lit("min"))).otherwise(F.concat(user, F.lit(" parsecs")))
    return table(spark, sf, "events").select(F.col("event_id").alias("key"), F.round(duration_ms(text), 3).alias("ms"))


@query("stacked_traces", f"""
WITH p AS (SELECT o_orderstatus AS trace, CAST({D} // 86400000 AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2),
s AS (SELECT trace, min(x) AS a, max(x) AS b FROM p GROUP BY 1), e AS (SELECT a AS x FROM s UNION SELECT b FROM s)
SELECT trace, x, y FROM p UNION SELECT trace, x, 0.0 FROM s, e WHERE x < a OR x > b
UNION SELECT trace, greatest(x, a - greatest(abs(a), 1) * pow(2, -40)), 0.0 FROM s, e WHERE x < a UNION SELECT trace, least(x, b + greatest(abs(b), 1) * pow(2, -40)), 0.0 FROM s, e WHERE x > b""")
def stacked_traces(spark, sf):
    day = F.floor(epoch_ms("o_orderdate") / DAY).cast("double")
    return display.stacked(table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("trace"), day.alias("x")).agg(F.count("*").cast("double").alias("y")))
