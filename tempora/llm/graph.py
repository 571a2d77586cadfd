"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (src, dst); the component is the smallest id in it.

    Neighbours are only ever reduced to their minimum (combined before the
    shuffle) and joined back on a key that adaptive execution may split, so a
    node with many neighbours is not gathered in one task. Each step is written
    to the shared folder. Edges with a null end and loops are left out.
    """
    e = edges.filter("src is not null and dst is not null and src <> dst")
    e = saved(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(low, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        e = saved(small.unionByName(low.select("src", F.col("m").alias("dst"))).distinct())
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(
        e.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    )
