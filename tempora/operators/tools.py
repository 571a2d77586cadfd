"""Steps of data tools: an ordered list that is kept as JSON and replayed on the original data.

A step reads one column of an indexed frame (``_i``, ``t`` and series) and gives a new column, or changes the one it reads.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import compile_formula
from . import series as ser
from . import sliding

#: Tool -> (operator, the column it gives).
TOOLS: dict[str, tuple[Callable[..., DataFrame], str]] = {
    "derivative": (ser.derivative, "d"),
    "integral": (ser.integral, "integral"),
    "moving_average": (ser.moving_average, "ma"),
    "outliers_iqr": (lambda s, factor=1.5, how="nan": ser.replaced(ser.outliers_iqr(s, factor), how), "v"),
    "outliers_bounds": (lambda s, lo, hi, how="nan": ser.replaced(ser.outliers_bounds(s, lo, hi), how), "v"),
    "outliers_spike": (lambda s, sensitivity=6, how="nan": ser.replaced(sliding.outliers_spike(s, sensitivity), how), "v"),
    "bounds_mask": (ser.bounds_mask, "v"),
}


@dataclass(frozen=True)
class Step:
    """``tool`` on ``source``, into ``target`` (without one, ``source`` is changed); a formula has its text as parameter."""

    tool: str
    source: str = ""
    target: str | None = None
    params: dict = field(default_factory=dict)


def replay(frame: DataFrame, steps: list[Step]) -> DataFrame:
    """``frame`` with all steps applied in order; unknown tools and sources and targets that are there already are errors."""
    for step in steps:
        if step.target is not None and step.target in frame.columns:
            raise ValueError(f"{step.target} is there already")
        if step.tool == "formula":
            if step.target is None:
                raise ValueError("a formula needs a target")
            frame = frame.withColumn(step.target, compile_formula(step.params["text"], {c: F.col(f"`{c}`") for c in frame.columns}))
            continue
        if step.tool not in TOOLS:
            raise ValueError(f"no tool {step.tool}")
        if step.source not in frame.columns:
            raise ValueError(f"no column {step.source}")
        operator, made = TOOLS[step.tool]
        # the operator's own columns stand beside the frame's, whatever their names
        columns = [c for c in frame.columns if c not in ("_i", "t")]
        packed = frame.select("_i", "t", F.struct(*columns).alias("_all"), F.col(step.source).cast("double").alias("v"))
        out = operator(packed, **step.params)
        name = step.target or step.source
        kept = [F.col(made).alias(name) if c == name else F.col(f"_all.`{c}`").alias(c) for c in columns]
        frame = out.select("_i", "t", *kept, *([] if name in columns else [F.col(made).alias(name)]))
    return frame


def to_json(steps: list[Step]) -> str:
    return json.dumps({"version": 1, "steps": [asdict(s) for s in steps]})


def from_json(text: str) -> list[Step]:
    return [Step(**s) for s in json.loads(text)["steps"]]
