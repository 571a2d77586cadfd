"""Exact quantiles of many series at once, by counted ranges.

A quantile is a value of a known rank. Each pass counts the values of the ranges that ranks lie
in, by cells, and keeps the cell that has the rank: first one for each sign and binary exponent, then a
4096th part of what is left. Doubles have 52 bits below their exponent, so five passes settle any
values; they end when few values are left in every range, which are then put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

#: Cells of a range, passes at most, and values of a range that are put in order by one task.
CELLS, PASSES, FEW = 4096, 6, 1 << 15


def exponent_cell(x: Column) -> Column:
    """A whole number that grows with ``x``, by its sign and binary exponent."""
    size = F.floor(F.log2(F.greatest(F.abs(x), F.lit(5e-324)))) + 1100
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("long")


def grouped_quantiles(df: DataFrame, by: str, value: str, shares: list[float], few: int = FEW) -> DataFrame:
    """by, share and value: quantiles of the finite values of each series, linear between neighbours.

    Series without finite values have no rows. No task holds more than ``few`` values of a range that has different ones.
    """
    x = F.col(value).cast("double")
    rows = df.select(F.col(by).alias("by"), x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    rows = cut(rows)
    sizes = rows.groupBy("by").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    want = sizes.select("by", "n", F.col("n").alias("left"), "lo", "hi", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    place = F.col("share") * (F.col("n") - 1)
    want = want.select("by", "share", (place - F.floor(place)).alias("part"), "lo", "hi", "left", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("rank"))
    ranges = cut(want.withColumn("rest", F.col("rank")))
    many = (F.col("lo") < F.col("hi")) & (F.col("left") > few)
    for step in range(PASSES):
        if ranges.filter(many).isEmpty():
            break
        ranges = cut(ranges.filter(~many).unionByName(_narrowed(rows, ranges.filter(many), step)))
    # what is left of a range is small, or one value
    small = _inside(rows, ranges.filter("lo < hi")).groupBy("by", "share", "part", "rank", "rest").agg(F.sort_array(F.collect_list("x")).alias("all"))
    found = small.select("by", "share", "part", "rank", F.col("all")[F.col("rest").cast("int")].alias("x")).unionByName(ranges.filter("lo = hi").select("by", "share", "part", "rank", F.col("lo").alias("x")))
    ends = found.groupBy("by", "share", "part").agg(F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"))
    return ends.select("by", "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def _inside(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    return rows.alias("r").join(ranges.alias("w"), F.col("r.by").eqNullSafe(F.col("w.by")) & F.col("r.x").between(F.col("w.lo"), F.col("w.hi"))).select("w.*", "r.x")


def _narrowed(rows: DataFrame, ranges: DataFrame, step: int) -> DataFrame:
    """The ranges cut down to the cell that has their rank."""
    # ranks of one range are counted together
    one = ranges.select("by", "lo", "hi").distinct()
    even = F.least(F.lit(CELLS - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS)).cast("long")
    cell = exponent_cell(F.col("x")) if step == 0 else F.coalesce(even, F.lit(0))
    cells = _inside(rows, one).groupBy("by", "lo", "hi", cell.alias("cell")).agg(F.count("*").alias("c"), F.min("x").alias("a"), F.max("x").alias("z"))
    before = Window.partitionBy("by", "lo", "hi").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    on = F.col("w.by").eqNullSafe(F.col("c.by")) & (F.col("w.lo") == F.col("c.lo")) & (F.col("w.hi") == F.col("c.hi")) & (F.col("w.rest") >= F.col("c.before")) & (F.col("w.rest") < F.col("c.before") + F.col("c.c"))
    met = ranges.alias("w").join(cells.alias("c"), on)
    return met.select("w.by", "w.share", "w.part", F.col("c.a").alias("lo"), F.col("c.z").alias("hi"), "w.rank", (F.col("w.rest") - F.col("c.before")).alias("rest"), F.col("c.c").alias("left"))
