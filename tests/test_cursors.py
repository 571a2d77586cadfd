"""Cursor windows, histograms of several traces, and overlays of unlike axes."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.functions.axes import Axis
from tempora.operators import cursor, histograms, overlay


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i * i), float(i)) for i in range(300)] + [(300, None, 5.0), (301, datetime(2024, 1, 1, 0, 4), 9.0)]
    path = f"{tmp_path_factory.mktemp('c')}/s.parquet"
    spark.createDataFrame(rows, "k long, ts timestamp_ntz, v double").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def at(minutes):
    return 1_704_067_200_000 + minutes * 60_000


@pytest.mark.parametrize("width", [1, 60_000, 10**9])
def test_neighbours_of_a_point(samples, width):
    got = cursor.around(samples, "ts", "v", "k", at(4), 2, width).collect()
    assert [(r.t, r.key) for r in got] == [(at(4), 301), (at(4), 2), (at(9), 3), (at(16), 4)]
    assert [r.key for r in cursor.around(samples, "ts", "v", "k", at(-5), 2, width).collect()] == [0, 1]
    assert len(cursor.around(samples, "ts", "v", "k", at(10**6), 1000, width).collect()) == 301
    for x, forward, want in ((at(5), True, at(9)), (at(4), True, at(9)), (at(4), False, at(1)), (at(10**7), True, None), (at(0), False, None)):
        assert cursor.next_sample(samples, "ts", x, forward, width).first().t == want


def test_values_and_measures(samples):
    value = lambda x, **how: cursor.interpolate_at(samples, "ts", "v", "k", x, **how).first().v
    assert value(at(10)) == pytest.approx(3 + 1 / 7) and value(at(10), step=True) == 3 and value(at(-9)) == 0 and value(at(10**7)) == 299
    assert math.isnan(cursor.interpolate_at(samples.withColumn("v", F.when(F.col("k") != 4, F.col("v"))), "ts", "v", "k", at(10)).first().v)
    m = cursor.measures(samples, "ts", "v", "k", at(9), at(16)).first()
    assert (m.v1, m.v2, m.dt, m.dv, m.slope) == (3, 4, 420_000, 1, pytest.approx(1 / 420))


def test_windows_reach_the_scan(samples):
    for df in (cursor.next_sample(samples, "ts", at(50)), cursor.around(samples, "ts", "v", "k", at(50)), cursor.interpolate_at(samples, "ts", "v", "k", at(50))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_histograms_share_edges(spark):
    rng = np.random.default_rng(1)
    traces = {"a": rng.normal(size=500), "b": rng.uniform(3, 9, 80), "c": [4.0] * 7}
    rows = [(k, float(x)) for k, v in traces.items() for x in v] + [("a", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "s string, x double")
    lo, hi = min(map(min, traces.values())), max(map(max, traces.values()))

    def suggested(v):
        q1, q3 = np.quantile(v, [0.25, 0.75])
        return math.ceil((max(v) - min(v)) / (2 * (q3 - q1) / len(v) ** (1 / 3))) if q3 > q1 else math.ceil(math.log2(len(v)) + 1)

    for how, k in (({}, max(map(suggested, traces.values()))), ({"bins": 12}, 12), ({"width": 1.5}, math.ceil((hi - lo) / 1.5))):
        out = histograms.histograms(df, "s", "x", **how).toPandas()
        step = how.get("width", (hi - lo) / k)
        for s, v in traces.items():
            got = out[out.s == s].sort_values("bin")
            n = np.bincount(np.minimum(k - 1, np.floor((np.asarray(v) - lo) / step)).astype(int), minlength=k)
            assert got.n.tolist() == n.tolist() and got.cumulative.tolist() == np.cumsum(n).tolist()
            assert np.allclose(got.percent, 100 * n / len(v)) and np.allclose((got.density * (got.hi - got.lo)).sum(), 1)
        assert np.isclose(out.stacked.sum(), 100) and out.hi.max() == hi and set(out.s) == set(traces)
    one = histograms.histograms(df.filter("s = 'c'"), "s", "x").collect()
    assert [(r.lo, r.hi, r.n) for r in one] == [(3.5, 4.5, 7)] and histograms.histograms(df.limit(0), "s", "x").count() == 0
    for bad in ({"bins": 0}, {"width": -1.0}, {"width": 1e-9}):
        with pytest.raises(ValueError):
            histograms.histograms(df, "s", "x", **bad)


def test_overlays_check_axes_and_units(spark):
    def file(unit, axis, *rows):
        df = spark.createDataFrame([(float(t), float(v)) for t, v in rows], "t double, v double")
        return overlay.with_axis(df.withColumn("v", F.col("v").alias("v", metadata={"unit": unit} if unit else {})), axis)

    clock, elapsed = Axis(), Axis("elapsed", 5000.0)
    out = overlay.overlaid({"a": file("m", clock, (7000, 1)), "b": file("", elapsed, (6000, 2))})
    assert sorted(map(tuple, out.collect())) == [("a", 7000, 1), ("b", 6000, 2)]
    assert overlay.unit_of(out, "v") == "m" and overlay.axis_of(out) == clock and overlay.axis_of(out.filter("v > 1")) == clock
    back = overlay.overlaid({"b": file("", elapsed, (6000, 2)), "a": file("m", clock, (7000, 1)), "c": file("", Axis("elapsed", 6000.0), (6000, 3))})
    assert sorted(map(tuple, back.collect())) == [("a", 2, 1), ("b", 1, 2), ("c", 1, 3)]
    more = overlay.overlaid({"a": file("m", clock, (1, 1)), "b": file("", clock, (2, 2)).withColumnRenamed("v", "w")})
    assert more.columns == ["file", "t", "v", "w"] and more.count() == 2
    for bad in ({"a": file("m", clock, (1, 1)), "b": file("s", clock, (1, 1))}, {"a": file("m", clock, (1, 1)), "b": file("m", Axis("index"), (1, 1))}, {"a": file("", Axis("index"), (1, 1)), "b": file("", Axis("index", step=2.0), (1, 1))}):
        with pytest.raises(overlay.Unlike):
            overlay.overlaid(bad)
