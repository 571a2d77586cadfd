"""How a time column is shown: as calendar time, elapsed seconds, row numbers or promoted numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Axis:
    """``kind``: calendar (ms), elapsed (seconds since ``origin``), index (row * ``step`` seconds) or promoted (``origin`` + seconds)."""

    kind: str = "calendar"
    origin: float = 0.0
    step: float = 1.0

    def shown(self, x: Column | float) -> Column | float:
        """The value that is shown for a stored one."""
        if self.kind == "elapsed":
            return (x - self.origin) / 1000.0
        if self.kind == "index":
            return x * self.step
        return x * 1000.0 + self.origin if self.kind == "promoted" else x

    def stored(self, x: Column | float) -> Column | float:
        """The stored value of a shown one."""
        if self.kind == "elapsed":
            return x * 1000.0 + self.origin
        if self.kind == "index":
            return x / self.step
        return (x - self.origin) / 1000.0 if self.kind == "promoted" else x

    @property
    def is_calendar(self) -> bool:
        return self.kind in ("calendar", "promoted")


def stored_range(axis: Axis, lo: float, hi: float, shift: float = 0.0, start: float | None = None, end: float | None = None) -> tuple[float, float] | None:
    """Bounds on the stored column for a shown range of a series that is cropped to [start, end] and shifted; None if nothing is left."""
    a, b = sorted((axis.stored(lo) - shift, axis.stored(hi) - shift))
    a, b = a if start is None else max(a, start), b if end is None else min(b, end)
    return (a, b) if a <= b else None


def mapped(x: float, a: Axis, b: Axis) -> float:
    """A time shown on axis ``a`` as one of ``b``: calendar and elapsed times by their origins; NaN where they have nothing in common."""
    if a.is_calendar == b.is_calendar and a.kind != "index" and b.kind != "index":
        return x
    if a.is_calendar and b.kind == "elapsed":
        return (x - b.origin) / 1000.0
    if a.kind == "elapsed" and b.is_calendar:
        return a.origin + x * 1000.0
    return math.nan


def elapsed(df, t: str, name: str = "elapsed"):
    """``df`` with the seconds since its own first time; one row of the least time is joined, without a driver action."""
    first = F.broadcast(df.agg(F.min(t).alias("_first")))
    return df.crossJoin(first).withColumn(name, (F.col(t) - F.col("_first")) / 1000.0).drop("_first")
