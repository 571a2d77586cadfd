"""A project: files with a transform each, and the columns that formulas and tools define, as one graph.

A definition reads columns of its own file, which may be defined themselves, in any order of
writing. Replaying sorts them by what they read, and builds only what the wanted columns need.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite
from ..functions.formula import FUNCTIONS, tokens
from . import tools


@dataclass(frozen=True)
class FileTransform:
    """Cropping by time [start, end], then a shift of time, and gain, sign and offset of all values; ``inverted`` columns have their sign changed."""

    gain: float = 1.0
    offset: float = 0.0
    negate: bool = False
    start: float | None = None
    end: float | None = None
    shift: float = 0.0
    inverted: tuple[str, ...] = ()

    def applied(self, frame: DataFrame, columns: list[str]) -> DataFrame:
        if self.start is not None:
            frame = frame.filter(F.col("t") >= self.start)
        if self.end is not None:
            frame = frame.filter(F.col("t") <= self.end)
        made = {"t": F.col("t") + F.lit(self.shift)} if self.shift else {}
        for c in columns:
            gain = self.gain * (-1.0 if self.negate else 1.0) * (-1.0 if c in self.inverted else 1.0)
            if gain != 1.0 or self.offset:
                v = F.col(f"`{c}`")
                made[c] = F.when(finite(f"`{c}`"), v * gain + self.offset).otherwise(v)
        return frame.withColumns(made) if made else frame


@dataclass(frozen=True)
class Definition:
    """A column that a tool makes of ``source``, or a formula of the columns that it names."""

    name: str
    tool: str = "formula"
    source: str = ""
    params: dict = field(default_factory=dict)

    def reads(self) -> list[str]:
        if self.tool != "formula":
            return [self.source]
        found = tokens(self.params["text"])
        calls = {i for i, (kind, v) in enumerate(found[:-1]) if kind == "name" and v.lower() in FUNCTIONS and found[i + 1] == ("sign", "(")}
        return list(dict.fromkeys(v for i, (kind, v) in enumerate(found) if kind == "name" and i not in calls))


@dataclass(frozen=True)
class File:
    """``columns`` are those that the file has itself."""

    columns: tuple[str, ...]
    transform: FileTransform = field(default_factory=FileTransform)
    definitions: tuple[Definition, ...] = ()

    def ordered(self, wanted: Iterable[str] | None = None) -> list[Definition]:
        """The definitions that ``wanted`` columns (all, without it) need, each after those that it reads; a ring of them is an error."""
        by_name: dict[str, Definition] = {}
        for d in self.definitions:
            if d.name in by_name or d.name in self.columns:
                raise ValueError(f"{d.name} is there already")
            by_name[d.name] = d
        out: list[Definition] = []
        done, path = set(self.columns), []
        stack = [(n, False) for n in reversed(list(by_name if wanted is None else wanted))]
        while stack:
            name, left = stack.pop()
            if left:
                path.pop()
                done.add(name)
                out.append(by_name[name])
                continue
            if name in done:
                continue
            if name in path:
                raise ValueError("definitions read each other: " + " -> ".join([*path[path.index(name) :], name]))
            if name not in by_name:
                raise ValueError(f"no column {name}" + (f", which {path[-1]} reads" if path else ""))
            path.append(name)
            stack.append((name, True))
            stack += [(r, False) for r in reversed(by_name[name].reads())]
        return out


@dataclass(frozen=True)
class Project:
    files: dict[str, File]

    def replay(self, frames: dict[str, DataFrame], wanted: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
        """The indexed frame of each file (``_i``, ``t`` and its columns) with transform and definitions; with ``wanted``, of these files only and with these columns.

        A wanted column is made of what it reads and nothing else. A file of the project without a frame, or without one of its columns, is an error.
        """
        out = {}
        for name in self.files if wanted is None else wanted:
            if name not in self.files or name not in frames:
                raise ValueError(f"no file {name}")
            file, frame = self.files[name], frames[name]
            if missing := set(file.columns) - set(frame.columns):
                raise ValueError(f"{name} has no {min(missing)}")
            steps = file.ordered(None if wanted is None else wanted[name])
            kept = list(file.columns) if wanted is None else [c for c in file.columns if c in wanted[name] or any(c in d.reads() for d in steps)]
            frame = file.transform.applied(frame.select("_i", "t", *[f"`{c}`" for c in kept]), kept)
            frame = tools.replay(frame, [tools.Step(d.tool, d.source, d.name, d.params) for d in steps])
            out[name] = frame if wanted is None else frame.select("_i", "t", *[f"`{c}`" for c in wanted[name]])
        return out

    def to_json(self) -> str:
        return json.dumps({"version": 1, "files": {k: asdict(f) for k, f in self.files.items()}})

    @staticmethod
    def from_json(text: str) -> Project:
        files = {}
        for name, f in json.loads(text)["files"].items():
            transform = FileTransform(**f["transform"] | {"inverted": tuple(f["transform"]["inverted"])})
            files[name] = File(tuple(f["columns"]), transform, tuple(Definition(**d) for d in f["definitions"]))
        return Project(files)


def matching(project: Project, frames: dict[str, DataFrame]) -> dict[str, str]:
    """For each file of a project the frame that suits it best: the same name counts most, then the share of its columns; a frame without all of them suits none."""
    out: dict[str, str] = {}
    for name, file in project.files.items():
        fits = [(n == name, len(file.columns) / max(1, len(df.columns)), n) for n, df in frames.items() if n not in out.values() and set(file.columns) <= set(df.columns)]
        if fits:
            out[name] = max(fits)[2]
    return out
