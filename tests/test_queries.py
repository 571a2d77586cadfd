"""Every registered time-series query against its SQL, and chunked windows against plain ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import compare
import tempora.plans.queries  # noqa: F401
from tempora.functions.formula import compile_formula
from tempora.operators import aggregates, ordering
from tempora.operators import series as ser
from tempora.plans.registry import ORACLES, QUERIES

SF = f"{compare.DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare.check(spark, name, QUERIES[name], ORACLES[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def points(spark, v, t):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(t, v, strict=True))], "_i long, t double, v double")


def values(df, c):
    return [r[c] for r in df.orderBy("_i").collect()]


def test_derivative_vectors(spark):
    s = points(spark, [0, 1, 5, 11], [0, 1, 3, 6])
    assert values(ser.derivative(s, unit=1.0), "d") == pytest.approx([1, 5 / 3, 2, 2])
    assert values(ser.derivative(s, unit=1.0, rows=2), "d") == pytest.approx([1, 5 / 3, 2, 2])


def test_integral_and_moving_average_vectors(spark):
    nan = float("nan")
    assert values(ser.integral(points(spark, [2, 4, 6], [0, 1, 3]), unit=1.0, rows=2), "integral") == pytest.approx([0, 3, 13])
    assert values(ser.integral(points(spark, [1, nan, 3], [0, 1, 2]), unit=1.0), "integral") == [0, 0, 0]
    assert values(ser.moving_average(points(spark, [1, 2, 100, 4, 5], range(5)), 3, rows=2), "ma") == pytest.approx([1.5, 103 / 3, 106 / 3, 109 / 3, 4.5])


@pytest.mark.parametrize("rows", [7, 100, 10_000])
def test_chunked_equals_plain(spark, rows):
    df = spark.range(300).select(F.col("id").alias("key"), (F.col("id") * 37 % 251).alias("t"), F.when(F.col("id") % 11 != 0, (F.col("id") % 13).cast("double")).alias("v"))
    s = ordering.indexed(df, "t", "key", rows)
    w = Window.orderBy("t", "key")
    want = df.select("key", (F.row_number().over(w) - 1).alias("i"), F.lag("t").over(w).alias("p"), F.last("v", True).over(w).alias("l")).collect()
    got = ordering.nearest_valid(ordering.with_previous(s, ["t"], rows), F.col("v"), rows).select("key", F.col("_i").alias("i"), F.col("prev_t").alias("p"), F.col("_prev.v").alias("l")).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, got))


@pytest.mark.parametrize("rows", [7, 10_000])
def test_quantiles_equal_exact_percentiles(spark, rows):
    df = spark.range(500).select(F.when(F.col("id") % 9 != 0, (F.col("id") * 37 % 101).cast("double")).alias("v"))
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = df.agg(F.percentile("v", F.array(*map(F.lit, shares))), F.count("v")).first()
    n, got = ordering.quantiles(df, F.col("v"), shares, rows)
    assert n == want[1] and got == pytest.approx(want[0])
    assert ordering.quantiles(df.limit(0), F.col("v"), [0.5]) == (0, [None])


def test_empty_and_constant(spark):
    none = spark.createDataFrame([], "x double, y double")
    assert aggregates.correlation(none, "x", "y").first().r is None
    assert aggregates.histogram(none, "x").count() == 0
    one = spark.createDataFrame([(1.0,)] * 3, "x double")
    assert [tuple(r) for r in aggregates.histogram(one, "x").select("lo", "hi", "n").collect()] == [(0.5, 1.5, 3)]


def test_formula_errors():
    for text in ("1 +", "foo(2)", "(1", "a $ b"):
        with pytest.raises(ValueError):
            compile_formula(text, {})


def test_raw_range_is_whole(spark, tmp_path):
    n = 500_002
    # all in the week of the registered query, one a second
    spark.range(n).selectExpr("id as event_id", "timestamp_millis(1704412800000 + id * 1000) as ts", "double(id) as value").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["raw_range"](spark, str(tmp_path))
    assert out.columns == ["t", "value"] and out.count() == n
    df = spark.read.parquet(f"{tmp_path}/events.parquet")
    span = ("ts", ["value"], 1704412800000, 1704412800000 + 9_000)
    assert [(r.value, r.truncated) for r in aggregates.raw_range(df, *span, limit=3).collect()] == [(0, True), (1, True), (2, True)]
    assert [r.truncated for r in aggregates.raw_range(df, *span, limit=10).collect()] == [False] * 10


@pytest.mark.parametrize("name", ["asof_interpolate", "nan_runs", "outliers_iqr_interpolate"])
def test_no_window_goes_over_the_rest_for_each_row(spark, name):
    """A frame that ends with its partition costs the square of the rows."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$()" in plan and "unboundedfollowing$()" not in plan


def test_runs_between_the_same_times_are_one_row(spark, tmp_path):
    """Events of one millisecond, of which those with key 17 and 34 are missing."""
    spark.range(10, 40).selectExpr("id as event_id", "timestamp_millis(1704412800000 + id div 20) as ts", "double(id) as value").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(40, 80).selectExpr("id as event_id", "timestamp_millis(1704412800009) as ts", "double(id) as value").write.mode("append").parquet(f"{tmp_path}/events.parquet")
    at = 1_704_412_800_000
    assert sorted(map(tuple, QUERIES["nan_runs"](spark, str(tmp_path)).collect())) == [(at, at, 1), (at + 1, at + 1, 1), (at + 9, at + 9, 2)]
