"""Series of several files on one axis: the axis and the units travel in the columns' metadata, and what doesn't belong together is an error."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axes import Axis


class Unlike(ValueError):
    """Axes or units that can't be shown together."""


def with_axis(df: DataFrame, axis: Axis, t: str = "t") -> DataFrame:
    """``df`` whose time column says how it is shown; operators that keep the column keep that."""
    return df.withColumn(t, F.col(t).alias(t, metadata=df.schema[t].metadata | {"axis": asdict(axis)}))


def axis_of(df: DataFrame, t: str = "t") -> Axis:
    """The axis that a time column says; calendar time without one."""
    return Axis(**df.schema[t].metadata.get("axis", {}))


def unit_of(df: DataFrame, column: str) -> str:
    return df.schema[column].metadata.get("unit", "")


def overlaid(files: dict[str, DataFrame], t: str = "t", columns: tuple[str, ...] | None = None) -> DataFrame:
    """``file``, the time as the first file shows it, and the columns of all files, null where a file has none.

    Calendar and elapsed axes are brought together by their origins; an index goes with indexes of the
    same step only. A column's units must be equal where files give one. Units and axis stay with the columns.
    """
    if not files:
        raise ValueError("no files")
    first = axis_of(next(iter(files.values())), t)
    units: dict[str, str] = {}
    parts = []
    for name, df in files.items():
        axis = axis_of(df, t)
        if (axis.kind == "index") != (first.kind == "index") or axis.kind == "index" and axis.step != first.step:
            raise Unlike(f"{name}: a time of kind {axis.kind} beside one of kind {first.kind}")
        # what is stored comes to the first file's stored form through what is shown
        kept = [c for c in df.columns if c != t and (columns is None or c in columns)]
        for c in kept:
            unit = unit_of(df, c)
            if unit and units.setdefault(c, unit) != unit:
                raise Unlike(f"{name}: {c} in {unit} beside {units[c]}")
        shown = axis.shown(F.col(t))
        if axis.is_calendar and first.kind == "elapsed":
            shown = (shown - first.origin) / 1000.0
        elif axis.kind == "elapsed" and first.is_calendar:
            shown = axis.origin + shown * 1000.0
        elif axis.kind == first.kind == "elapsed":
            shown = shown + (axis.origin - first.origin) / 1000.0
        parts.append(df.select(F.lit(name).alias("file"), shown.cast("double").alias(t), *kept))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    named = [F.col(c).alias(c, metadata={"unit": units[c]} if c in units else {}) for c in out.columns if c not in ("file", t)]
    return out.select("file", F.col(t).alias(t, metadata={"axis": asdict(first)}), *named)
