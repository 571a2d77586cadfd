"""Bounded, repeatable samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a sample of all classes has, about, at most; every class has one row at least.
TOTAL = 60_000


def bounded_sample(rows: DataFrame, by: str, cap: int, key: str = "doc_id", total: int = TOTAL) -> tuple[DataFrame, dict]:
    """About ``cap`` rows of each non-null value of ``by``, chosen by a hash of ``key``, and each value's weight.

    With many classes, each has ``total`` rows over their number. All classes are
    learned; more than ``total`` of them are an error. A class of few rows is taken
    whole. The weight is the number of rows that one sampled row stands for. Reruns
    choose the same rows.
    """
    counts = rows.filter(F.col(by).isNotNull()).groupBy(by).count().orderBy(by).limit(total + 1).collect()
    if len(counts) > total:
        raise ValueError(f"{by} has more than {total} different values: these are no classes")
    each = max(1, min(cap, total // max(1, len(counts))))
    weight = {r[by]: max(1.0, r["count"] / each) for r in counts}
    span = 1 << 30
    least = rows.sparkSession.createDataFrame([(v, int(span / w)) for v, w in weight.items()], rows.select(by).schema.add("_least", "long"))
    picked = rows.join(F.broadcast(least), by).filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(span)) < F.col("_least"))
    return picked.select(*rows.columns), weight
