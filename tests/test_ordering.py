"""Chunks of an order: sizes with bursts, places, and one shuffle for the windows over them."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tempora.operators import ordering
from tempora.operators import series as ser


def table(spark, burst, n=6000):
    """Most rows have one time, some none, others lie far out."""
    t = F.when(F.col("id") % 10 != 0, F.lit(5000)).when(F.col("id") % 70 == 0, None).otherwise(F.col("id") * 37 % 9973) if burst else F.col("id") * 37 % 9973
    far = F.when(F.col("id") == 30, F.lit(10**12)).otherwise(t)
    return spark.range(n).select((F.col("id") * 7919 % n).alias("key"), far.cast("long").alias("t"), (F.col("id") % 13).cast("double").alias("v"))


@pytest.mark.parametrize("burst", [False, True])
@pytest.mark.parametrize("rows", [50, 700, 5000])
def test_places_and_sizes(spark, burst, rows):
    df = table(spark, burst)
    out = ordering.indexed(df, "t", "key", rows)
    want = df.select("key", (F.row_number().over(Window.orderBy(F.asc_nulls_last("t"), "key")) - 1).alias("i")).collect()
    assert sorted(tuple(r) for r in out.select("key", "_i").collect()) == sorted(map(tuple, want))
    sizes = [r["count"] for r in out.groupBy("_c").count().collect()]
    if rows < 3000:
        assert max(sizes) <= 2 * sum(sizes) / len(sizes) and max(sizes) <= rows


@pytest.mark.parametrize("rows", [60, 5000])
def test_windows_over_bursts_are_plain_ones(spark, rows):
    df = table(spark, True).filter("t is not null").withColumn("v", F.when(F.col("key") % 11 != 0, F.col("v")))
    s = ordering.indexed(df, "t", "key", rows)
    w = Window.orderBy("t", "key")
    plain = df.select("key", F.lag("t").over(w).alias("p"), F.last("v", True).over(w).alias("l"), F.sum(F.coalesce("v", F.lit(0.0))).over(w).alias("s"))
    got = ordering.running_sum(ordering.nearest_valid(ordering.with_previous(s, ["t"], rows), F.col("v"), rows), F.col("v"), "s", rows)
    assert sorted(map(tuple, got.select("key", "prev_t", "_prev.v", "s").collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_text_keys_and_empty_tables(spark):
    df = table(spark, True).withColumn("key", F.col("key").cast("string"))
    want = [r.key for r in df.orderBy(F.asc_nulls_last("t"), "key").collect()]
    assert [r.key for r in ordering.indexed(df, "t", "key", 100).orderBy("_i").collect()] == want
    assert ordering.indexed(df.limit(0), "t", "key", 100).count() == 0


def test_an_integral_has_one_shuffle(spark):
    s = ordering.indexed(table(spark, False).filter("t is not null"), "t", "key", 1000)
    out = ser.integral(s, rows=1000).select("key", "integral")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [x for x in plan.split("\n") if "Exchange hashpartitioning(_c" in x and "Reused" not in x]
    assert len(shuffles) == 1, plan
