"""Axes, drawn points, tool steps, as-of lookups, missing intervals and column trees on small cases."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.functions.axes import Axis, mapped, stored_range
from tempora.functions.durations import duration_ms
from tempora.operators import aggregates as agg
from tempora.operators import display, lookup, tools
from tempora.operators import series as ser
from tempora.sources.columns import column_paths, read_column_paths

NAN = float("nan")


def frame(spark, t, v):
    return spark.createDataFrame([(i, float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(t, v, strict=True))], "_i long, t double, v double")


DURATIONS = {
    "90": 90, "2.5 h": 9e6, "-3 min": -1.8e5, "1 d 02:30:00": 95_400_000, "-00:01": -60_000, "7 ps": 7e-9, "2 us": 2e-3, "1y": 365.25 * 8.64e7, "2 weeks": 2 * 6.048e8, "1 parsec": 0, "": 0, None: 0, "1e3": 1000,
    "1h 30min": 5.4e6, "+ 2 S": 2000, "1e3s": 1e6, "00:00:01.5": 1500, "00:61": 0, "1:2:3:4": 0, "5 6": 0, "h": 0, "1 h 5": 0, ".5d": 4.32e7, "1..2 s": 0, "-1 d 01:00": -90_000_000,
}


def test_durations(spark):
    rows = spark.createDataFrame([(t,) for t in DURATIONS], "t string").select("t", duration_ms("t").alias("ms")).collect()
    assert {r.t: r.ms for r in rows} == {t: pytest.approx(ms) for t, ms in DURATIONS.items()}


def test_axes_there_and_back():
    for axis in (Axis(), Axis("elapsed", 5000.0), Axis("index", step=0.5), Axis("promoted", 1e12)):
        assert axis.stored(axis.shown(1234.0)) == pytest.approx(1234.0)
    assert Axis("elapsed", 5000.0).shown(7000.0) == 2.0
    assert stored_range(Axis("elapsed", 1000.0), 5.0, 2.0, shift=500.0, start=3000.0) == (3000.0, 5500.0)
    assert stored_range(Axis(), 0, 10, end=-1) is None
    assert mapped(7000.0, Axis(), Axis("elapsed", 5000.0)) == 2.0
    assert mapped(2.0, Axis("elapsed", 5000.0), Axis()) == 7000.0
    assert math.isnan(mapped(2.0, Axis("index"), Axis()))


def test_lookup_of_many_points(spark):
    s = frame(spark, [0, 10, 20, 30], [1, 3, NAN, 5])
    at = spark.createDataFrame([(i, x, "kept") for i, x in enumerate([-5.0, 0.0, 5.0, 15.0, 30.0, 99.0, None, 5.0])], "key int, x double, v string")
    for rows in (2, 100):
        got = {r.key: r.v for r in lookup.interpolated(s, at, "x", rows=rows).collect()}
        assert [got[i] for i in (0, 1, 2, 4, 5, 6, 7)] == [1, 1, 2, 5, 5, None, 2] and math.isnan(got[3])
    got = {r.key: r.v for r in lookup.interpolated(s, at, "x", step=True).collect()}
    assert got[2] == 1
    assert lookup.interpolated(s.limit(0), at, "x").filter("v is not null").count() == 0


def test_tool_steps(spark):
    s = frame(spark, range(6), [0, 1, 2, 3, 4, 5]).withColumn("ma", F.lit(7.0))
    steps = [tools.Step("moving_average", "v", "smooth", {"window": 3}), tools.Step("derivative", "smooth", "rate", {"unit": 1.0}), tools.Step("formula", target="twice", params={"text": "rate * 2 + v"})]
    again = tools.from_json(tools.to_json(steps))
    assert again == steps
    rows = tools.replay(s, again).orderBy("_i").collect()
    assert [r.smooth for r in rows] == [0.5, 1, 2, 3, 4, 4.5] and [r.v for r in rows] == [0, 1, 2, 3, 4, 5]
    assert rows[2].rate == 1 and rows[2].twice == 4 and rows[2].ma == 7.0
    changed = tools.replay(s, [tools.Step("moving_average", "v", params={"window": 3})])
    assert [r.v for r in changed.orderBy("_i").collect()] == [0.5, 1, 2, 3, 4, 4.5]
    for bad in (tools.Step("melt", "v"), tools.Step("derivative", "none"), tools.Step("derivative", "v", "ma"), tools.Step("formula", params={"text": "v"})):
        with pytest.raises(ValueError):
            tools.replay(s, [bad])


def test_drawn_points(spark):
    s = frame(spark, range(100), [i % 10 for i in range(100)])
    assert sorted(r._i for r in display.index_stride(s, 4).collect()) == [0, 33, 66, 99]
    assert display.index_stride(s, 100).count() == 100
    assert sorted(r._i for r in display.phase_stride(s, 10).collect()) == [*range(0, 100, 11)]
    with pytest.raises(ValueError):
        display.phase_stride(frame(spark, [0, 2, 1], [0, 0, 0]), 10)
    assert sorted(r._i for r in display.visible(s, 10.5, 13, 100).collect()) == [10, 11, 12, 13, 14]
    assert sorted(r._i for r in display.visible(s, 10.2, 10.8, 100).collect()) == [10, 11]
    gaps = display.gap_breaks(frame(spark, [0, 1, 2, 9, 10, 11], [1] * 6).select("t", "v"))
    assert [r.t for r in gaps.filter("_break").collect()] == [2] and gaps.count() == 7
    lines = s.select(F.col("_i").alias("k"), F.col("t").alias("frequency"), F.when(F.col("_i") == 42, 9.5).otherwise(F.col("v")).alias("amplitude"))
    thin = {r.k: r.amplitude for r in display.thinned_spectrum(lines, 4).collect()}
    assert thin == {0: 0, 42: 9.5, 50: 0, 59: 9}
    assert sorted(r.k for r in display.thinned_spectrum(lines, 50, 20, 22).collect()) == [19, 20, 21, 22, 23]


def test_state_arrows(spark):
    df = spark.createDataFrame([(3.0, 4.0, 0.6, 0.8), (0.0, 0.0, 0.0, 0.0), (None, 1.0, 2.0, NAN)], "x double, y double, dx double, dy double")
    tips = [(r.tip1, r.tip2) for r in display.state_view(df, ["x", "y"], ["dx", "dy"]).collect()]
    assert tips[0] == pytest.approx((3.6, 4.8)) and tips[1] == (0, 0) and tips[2] == pytest.approx((0.25, 1.0))


def test_stacked_traces_have_zeros_outside(spark):
    traces = spark.createDataFrame([("a", 0.0, 1.0), ("a", 4.0, 2.0), ("b", 2.0, 5.0), ("b", 8.0, 6.0)], "trace string, x double, y double")
    got = {n: sorted((round(r.x, 6), r.y) for r in display.stacked(traces).filter(F.col("trace") == n).collect()) for n in "ab"}
    assert got["a"] == [(0, 1), (4, 0), (4, 2), (8, 0)]
    assert got["b"] == [(0, 0), (2, 0), (2, 5), (8, 6)]
    beside = display.stacked(traces).filter("trace = 'b' and x < 2 and x > 1").first()
    assert 0 < 2 - beside.x < 1e-6
    assert display.stacked(traces.filter("trace = 'a'")).count() == 2 and display.stacked(traces.limit(0)).count() == 0


def test_missing_intervals(spark):
    # a sample a second; none from 40 to 49, bad ones at 70
    rows = [(i * 1000, None if i == 70 else 1.0) for i in range(100) if not 40 <= i < 50]
    df = spark.createDataFrame(rows, "ms long, value double").select(F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "value")
    for n, kind in ((100, "solid"), (10, "any")):
        buckets = agg.missing_buckets(df, "ts", ["value"], 0, 100_000, n)
        got = sorted((r.t0, r.t1) for r in agg.missing_intervals(buckets, 0, 100_000, n).filter(F.col("kind") == kind).collect())
        assert got == [(39_000, 50_000), (69_000, 71_000) if n == 100 else (70_000, 80_000)]
    assert tuple(agg.missing_summary(buckets, 10).first()) == (1, 1, 0.1, False)
    none = agg.missing_buckets(df.limit(0), "ts", ["value"], 0, 1000, 10)
    assert agg.missing_intervals(none, 0, 1000, 10).count() == 0


def test_histogram_counts_outside(spark):
    rows = agg.histogram(frame(spark, range(6), [-1, 0, 1, 2, 9, None]), "v", bins=2, lo=0.0, hi=2.0).orderBy("bin").collect()
    assert [(r.n, r.cumulative, r.underflow, r.overflow) for r in rows] == [(1, 1, 1, 1), (2, 3, 1, 1)]


def test_step_crossing(spark):
    s = frame(spark, [0, 1, 2, 3], [1, 1, -1, 1])
    assert ser.zero_crossing(s, 0.5, step=True).first().t == 2 and ser.zero_crossing(s, 0.5).first().t == 1.5
    assert ser.zero_crossing(s, 2.7, forward=False, step=True).first().t == 2


def test_column_tree(spark, tmp_path):
    pdf = pd.DataFrame([[1.0, 2.0]], columns=pd.MultiIndex.from_tuples([("site", "wind"), ("site", "sun")]))
    pdf.to_parquet(tmp_path / "tree.parquet")
    paths = read_column_paths(spark, f"{tmp_path}/tree.parquet")
    assert sorted(paths.values()) == [["site", "sun"], ["site", "wind"]]
    assert column_paths(None) == {} and column_paths({"column_indexes": [{}], "columns": [{"field_name": "a", "name": "a"}]}) == {}
