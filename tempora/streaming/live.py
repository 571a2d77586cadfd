"""A table and what is appended to it: batches are checked, then added, and read with the base as one view."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bucket, clean
from ..operators.aggregates import row_estimate
from . import pyramid
from .log import Commit, CommitLog, Conflict

#: Rows and bytes that may be appended to a table (fixed values); None is no limit.
MOST_ROWS, MOST_BYTES = 1_000_000, 256 << 20


class RejectedBatch(ValueError):
    """A batch that must not be appended."""


def check_batch(delta: DataFrame, last: float | None, t: str = "t", repeats: bool = False) -> tuple[int, float | None, float | None]:
    """Number of valid rows, the least and the greatest time of a batch whose times are new: later than ``last``, and none twice.

    Rows without a valid time are not counted. The check for repeated times is a grouped count; with ``repeats`` a
    batch may have a time more than once.
    """
    valid = delta.filter(F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double")))
    n, lo, hi = valid.agg(F.count("*"), F.min(t), F.max(t)).first()
    if not n:
        return 0, None, last
    if last is not None and lo <= last:
        raise RejectedBatch(f"time {lo} is not after {last}")
    if not repeats and not valid.groupBy(t).count().filter("count > 1").isEmpty():
        raise RejectedBatch("a time is there twice")
    return n, lo, hi


@dataclass
class LiveTable:
    """``base`` and the batches written under ``path``, a folder that the driver and all executors share; ``t`` is a number.

    A batch is written to a folder of its own, checked there, and becomes visible by a commit
    (`log.CommitLog`) that holds the totals so far: an append reads its own batch and the newest
    commit, not what was appended before. What has no commit is not part of the table. A batch
    that a stream repeats after a failure is passed over. With ``generated`` the axis is a generated index: ``t`` of new rows goes
    on from the number of rows so far. With ``repeats`` several rows of a batch may have one time, as samples of one
    millisecond do; a batch's times must be later than those before it all the same.

    With ``envelopes``, the names of series, each batch also writes its least and greatest values in
    cells of time of several widths, ``finest`` being the least, of which `zoom` reads one.
    """

    base: DataFrame
    path: str
    t: str = "t"
    generated: bool = False
    most_rows: int | None = MOST_ROWS
    most_bytes: int | None = MOST_BYTES
    envelopes: tuple[str, ...] = ()
    finest: float = 1000.0
    repeats: bool = False

    def __post_init__(self) -> None:
        self.log = CommitLog(self.base.sparkSession, f"{self.path}/_log")

    def _started(self) -> Commit:
        """The newest commit; the first one, of version 0, counts the base."""
        found = self.log.newest()
        if found is None:
            n, first, last = self.base.agg(F.count("*"), F.min(self.t), F.max(self.t)).first()
            levels = None if first is None else self._levels(self.base, "base")
            try:
                self.log.add(Commit(0, -1, None, n, 0, last, 0, 0, first, levels))
            except Conflict:  # another writer has counted it
                self._delete(levels)
            found = self.log.newest()
        return found

    def appended(self) -> DataFrame:
        """The rows of the committed batches."""
        spark = self.base.sparkSession
        paths = [f"{self.path}/{c.folder}" for c in self.log.commits(self.log.newest()) if c.folder]
        return spark.read.schema(self.base.schema).parquet(*paths) if paths else spark.createDataFrame([], self.base.schema)

    def view(self) -> DataFrame:
        return self.base.unionByName(self.appended())

    def append(self, delta: DataFrame, batch: int) -> int:
        """Checks and adds a batch and returns its rows; for ``foreachBatch``. Nothing of a rejected batch becomes visible, and its files are deleted."""
        mine, theirs = ([(f.name, f.dataType) for f in d.schema if not (self.generated and f.name == self.t)] for d in (self.base, delta))
        if mine != theirs:
            raise RejectedBatch(f"columns {theirs} instead of {mine}")
        newest = self._started()
        before = newest
        while before.batch > batch:
            before = self.log.commit(before.version - 1)
        if before.batch == batch:
            return before.rows
        if newest.batch > batch:
            raise RejectedBatch(f"batch {batch} comes after {newest.batch}")
        if self.generated:
            from ..sources.delimited import physical_number

            first = self.log.commit(0).rows + newest.total_rows
            numbered = physical_number(delta.withColumn("_row", F.monotonically_increasing_id()), "_row")
            delta = numbered.withColumn(self.t, (F.col("_n") + first).cast(self.base.schema[self.t].dataType)).select(*self.base.columns)
        folder = f"batch-{batch}-{uuid.uuid4().hex}"
        delta.filter(F.col(self.t).isNotNull() & ~F.isnan(F.col(self.t).cast("double"))).write.parquet(f"{self.path}/{folder}")
        try:
            n, lo, last = check_batch(self.base.sparkSession.read.schema(self.base.schema).parquet(f"{self.path}/{folder}"), newest.last, self.t, self.repeats)
            size = self._bytes(folder)
            if self.most_rows is not None and newest.total_rows + n > self.most_rows:
                raise RejectedBatch(f"more than {self.most_rows} rows would be appended")
            if n and self.most_bytes is not None and newest.total_bytes + size > self.most_bytes:
                raise RejectedBatch(f"more than {self.most_bytes} bytes would be appended")
            if not n:
                self._delete(folder)
                return 0
            levels = self._levels(self.base.sparkSession.read.schema(self.base.schema).parquet(f"{self.path}/{folder}"), folder)
            first = lo if newest.first is None else newest.first
            try:
                self.log.add(Commit(newest.version + 1, batch, folder, n, size, last, newest.total_rows + n, newest.total_bytes + size, first, levels))
            except Conflict:
                self._delete(levels)
                raise
        except (RejectedBatch, Conflict):
            self._delete(folder)
            raise
        return n

    def _levels(self, rows: DataFrame, name: str) -> str | None:
        """Writes the envelopes of some rows to a folder, and returns its name."""
        if not self.envelopes:
            return None
        folder = f"levels-{name}-{uuid.uuid4().hex}"
        cells = pyramid.levels_of(rows, self.t, list(self.envelopes), self.finest)
        cells.repartition("level").sortWithinPartitions("level", "cell").write.partitionBy("level").parquet(f"{self.path}/{folder}")
        return folder

    def zoom(self, lo: float, hi: float, max_points: int = 4000) -> DataFrame:
        """t_lo, t_hi and each envelope's least and greatest value over [lo, hi], two points a row and about ``max_points`` of them at most.

        If the range is estimated to have no more than 1.2 times as many samples, they are returned
        as they are, a row each. Else the rows are cells of one level: whole ones, so that those at the ends may begin
        before ``lo`` and end after ``hi``. Where even the finest cells are too wide, the samples of the range are put into buckets.
        """
        if not self.envelopes:
            raise ValueError("a table without envelopes")
        values, newest = list(self.envelopes), self._started()
        rows = self.log.commit(0).rows + newest.total_rows
        if not rows or newest.first is None or not hi > lo:
            return self._drawn(self.base.limit(0))
        if row_estimate(rows, hi - lo, newest.last - newest.first) <= math.ceil(1.2 * max_points):
            return self._drawn(self.view().filter(F.col(self.t).between(lo, hi)))
        cells = max(1, max_points // 2)
        level = pyramid.level_for(lo, hi, cells, self.finest)
        ends = [f"{v}_{e}" for v in values for e in ("min", "max")]
        if level is None:
            kept = self._drawn(self.view().filter(F.col(self.t).between(lo, hi))).withColumn("n", F.lit(1))
            return pyramid.merged(kept, [bucket(F.col("t_lo"), lo, hi - lo, cells).alias("cell")], values).select("t_lo", "t_hi", *ends)
        spark = self.base.sparkSession
        paths = [f"{self.path}/{c.levels}/level={level}" for c in self.log.commits(newest) if c.levels]
        stored = spark.read.schema(self._cells()).parquet(*paths).withColumn("level", F.lit(level))
        return pyramid.read(stored, level, lo, hi, values, self.finest).select("t_lo", "t_hi", *ends)

    def overview(self, max_points: int = 2000) -> DataFrame:
        """The whole table, as `zoom` shows it; it stays as small however much is appended."""
        newest = self._started()
        return self._drawn(self.base.limit(0)) if newest.first is None else self.zoom(newest.first, newest.last, max_points)

    def _cells(self) -> str:
        kind = self.base.schema[self.t].dataType.simpleString()
        return f"cell long, n long, t_lo {kind}, t_hi {kind}, " + ", ".join(f"`{v}_{e}` double" for v in self.envelopes for e in ("min", "max"))

    def _drawn(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col(self.t).alias("t_lo"), F.col(self.t).alias("t_hi"), *[clean(v).alias(f"{v}_{e}") for v in self.envelopes for e in ("min", "max")])

    def _bytes(self, folder: str) -> int:
        return self.log.fs.getContentSummary(self.log._fs_package.Path(f"{self.path}/{folder}")).getLength()

    def _delete(self, folder: str | None) -> None:
        if folder:
            self.log.fs.delete(self.log._fs_package.Path(f"{self.path}/{folder}"), True)
