"""Envelopes of several resolutions: least and greatest values of cells of time, each level's cells twice as wide as those below.

Cells are aligned to time 0, so that the cells of a batch merge with those of earlier ones, and a zoom
reads one level. All levels together have at most twice the rows of the finest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clean

#: Levels; cells of the last are 2 ** (LEVELS - 1) times as wide as those of the first.
LEVELS = 32


def merged(cells: DataFrame, by: list, values: list[str]) -> DataFrame:
    """Cells put together: rows, first and last time, least and greatest values."""
    ends = [a for v in values for a in (F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max"))]
    return cells.groupBy(*by).agg(F.sum("n").alias("n"), F.min("t_lo").alias("t_lo"), F.max("t_hi").alias("t_hi"), *ends)


def levels_of(df: DataFrame, t: str, values: list[str], finest: float) -> DataFrame:
    """level, cell, n, t_lo, t_hi and each value's least and greatest finite value. Rows without a time are left out.

    The finest cells are counted from the rows, the others from the finest.
    """
    time = F.col(t).cast("double")
    rows = df.filter(F.col(t).isNotNull() & ~F.isnan(time)).select(F.floor(time / finest).alias("cell"), F.col(t).alias("t_lo"), F.col(t).alias("t_hi"), F.lit(1).alias("n"), *[clean(v).alias(f"{v}_{e}") for v in values for e in ("min", "max")])
    one = merged(rows, ["cell"], values)
    all_ = one.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumn("cell", F.expr("shiftright(cell, level)"))
    return merged(all_, ["level", "cell"], values)


def level_for(lo: float, hi: float, cells: int, finest: float) -> int | None:
    """The finest level that covers [lo, hi] with ``cells`` cells (and one that is cut); None if even the first is too coarse for half as many."""
    width = (hi - lo) / max(1, cells)
    if width < finest:
        return None
    return min(LEVELS - 1, math.ceil(math.log2(width / finest) - 1e-9))


def read(stored: DataFrame, level: int, lo: float, hi: float, values: list[str], finest: float) -> DataFrame:
    """The cells of a level that overlap [lo, hi], whole."""
    width = finest * 2**level
    cells = stored.filter((F.col("level") == level) & F.col("cell").between(math.floor(lo / width), math.floor(hi / width)))
    return merged(cells, ["cell"], values)
