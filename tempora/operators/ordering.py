"""Windows over one global order without one global partition.

Rows are dealt to chunks of about equal size, whose bounds come from counted cells of time; cells
with too many rows are cut again, by time or, where they have one time only, by the key. One shuffle brings a chunk's rows
together; their places follow from the counts. Windows then run inside chunks, in the same partitions, and what they need of other
chunks comes from tables of one row a chunk. Frames of more rows get copies of the neighbouring chunks' edge rows (a halo).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import INF

#: Rows of a chunk.
ROWS = 200_000
#: Cells that are counted at once, and so rows of a table that is broadcast, at most; and cells for each chunk.
CELLS, FINE = 65_536, 32
#: Times that a cell is cut again.
DEPTH = 6


@dataclass(frozen=True)
class Cell:
    """Rows whose value (time, or the key of rows of one time) lies in a range; ``path`` has the cells that it is in."""

    path: tuple[int, ...]
    n: int
    times: tuple
    keys: tuple


def _cell(x: Column, lo: Column, hi: Column, cells: Column) -> Column:
    """The cell of equal width that a value is in; greater values are in no lesser one."""
    share = F.try_divide(x.cast("double") - lo, hi - lo)
    return F.least(cells - 1, F.greatest(F.lit(0), F.floor(F.coalesce(share, F.lit(0.0)) * cells))).cast("long")


def _ends(t: str, key: str, numeric: bool) -> list[Column]:
    k = F.col(key).cast("double") if numeric else F.lit(None).cast("double")
    return [F.count("*").alias("n"), F.min(F.col(t).cast("double")), F.max(F.col(t).cast("double")), F.min(k), F.max(k)]


def _divide(df: DataFrame, t: str, key: str, rows: int) -> DataFrame:
    """``df`` with ``_c``, its chunk, and ``_start``, the rows in the chunks before; null times are in the last ones.

    Each step counts the rows of the cells that are to be cut, of which there are CELLS at most.
    """
    numeric = isinstance(df.schema[key].dataType, T.NumericType)
    n, *ends = df.agg(*_ends(t, key, numeric)).first()
    if n <= 2 * rows:
        return df.withColumns({"_c": F.lit(0).cast("long"), "_start": F.lit(0).cast("long")})
    open_, leaves, levels = [Cell((), n, tuple(ends[:2]), tuple(ends[2:]))], [], []
    spark, at = df.sparkSession, df.withColumn("_cut_node", F.lit(0).cast("long"))
    while open_:
        each = max(2, min(FINE * -(-n // rows), CELLS) // len(open_))
        params = []
        for node, c in enumerate(open_):
            by_key = c.times[0] is None or not c.times[0] < c.times[1]
            lo, hi = c.keys if by_key else c.times
            params.append((node, by_key, lo, hi, each))
        table = spark.createDataFrame(params, "_cut_node long, _cut_key boolean, _cut_lo double, _cut_hi double, _cut_cells long")
        value = F.when(F.col("_cut_key"), F.col(key).cast("double") if numeric else F.lit(0.0)).otherwise(F.col(t).cast("double"))
        # rows without a time come last: theirs is one more cell
        cell = F.when(F.col(t).isNull() & ~F.col("_cut_key"), F.col("_cut_cells")).otherwise(_cell(value, F.col("_cut_lo"), F.col("_cut_hi"), F.col("_cut_cells")))
        at = at.join(F.broadcast(table), "_cut_node", "left").withColumn("_cut_cell", cell).drop("_cut_key", "_cut_lo", "_cut_hi", "_cut_cells")
        counted = at.filter("_cut_node is not null").groupBy("_cut_node", "_cut_cell").agg(*_ends(t, key, numeric)).collect()
        following, map_ = [], []
        for node, cell_, count, t0, t1, k0, k1 in sorted(counted, key=lambda r: (r[0], r[1])):
            found = Cell((*open_[node].path, cell_), count, (t0, t1), (k0, k1))
            more = t0 is not None and t0 < t1 or k0 is not None and k0 < k1
            if count > rows and more and len(levels) < DEPTH - 1:
                map_.append((node, cell_, len(following), None))
                following.append(found)
            else:
                map_.append((node, cell_, None, len(leaves)))
                leaves.append(found)
        levels.append(map_)
        links = spark.createDataFrame(map_, "_cut_node long, _cut_cell long, _cut_next long, _cut_leaf long")
        at = at.join(F.broadcast(links), ["_cut_node", "_cut_cell"], "left").withColumn("_cut_node", F.col("_cut_next")).withColumn(f"_cut_leaf{len(levels)}", F.col("_cut_leaf")).drop("_cut_cell", "_cut_next", "_cut_leaf")
        open_ = following
    chunk, start, size, done = 0, 0, 0, []
    for leaf in sorted(range(len(leaves)), key=lambda i: leaves[i].path):
        if size and size + leaves[leaf].n > rows:
            chunk, start, size = chunk + 1, start + size, 0
        size += leaves[leaf].n
        done.append((leaf, chunk, start))
    table = F.broadcast(spark.createDataFrame(done, "_cut_leaf long, _c long, _start long"))
    leaf = F.coalesce(*[F.col(f"_cut_leaf{i + 1}") for i in range(len(levels))])
    return at.withColumn("_cut_leaf", leaf).join(table, "_cut_leaf").drop("_cut_leaf", "_cut_node", *[f"_cut_leaf{i + 1}" for i in range(len(levels))])


def indexed(df: DataFrame, t: str, key: str, rows: int = ROWS) -> DataFrame:
    """``df`` with ``_i``, the 0-based place of each row by (t, key), and ``_c``, its chunk; null times come last.

    Chunks have about ``rows`` rows, also where many rows have one time, if keys are numbers.
    """
    own = F.row_number().over(Window.partitionBy("_c").orderBy(F.asc_nulls_last(t), key)) - 1
    return _divide(df, t, key, rows).withColumn("_i", F.col("_start") + own).drop("_start")


def in_chunks(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` with ``_c``: the chunks that its places came from, or else new ones."""
    return df if "_c" in df.columns else df.withColumn("_c", F.floor(F.col("_i") / rows))


def chunked(df: DataFrame, before: int, after: int, rows: int = ROWS) -> DataFrame:
    """Indexed rows with ``_chunk``, and copies (``_halo``) of ``before`` rows of the chunk ahead and ``after`` of the next one."""
    rows = max(rows, before, after, 1)
    c, r = F.floor(F.col("_i") / rows), F.col("_i") % rows
    to = F.array_compact(F.array(c, F.when(r < after, c - 1), F.when(r >= rows - before, c + 1)))
    return df.withColumn("_home", c).withColumn("_chunk", F.explode(to)).withColumn("_halo", F.col("_chunk") != F.col("_home")).drop("_home")


def framed(df: DataFrame, before: int, after: int, made, rows: int = ROWS) -> DataFrame:
    """Indexed rows with the columns that ``made(window)`` gives; its frames reach over ``before`` and ``after`` rows at most."""
    w = Window.partitionBy("_chunk").orderBy("_i")
    return chunked(df, before, after, rows).withColumns(made(w)).filter(~F.col("_halo")).drop("_chunk", "_halo")


def with_previous(df: DataFrame, columns: list[str], rows: int = ROWS) -> DataFrame:
    """Indexed rows with ``prev_`` columns of the row before; the last row of a chunk is handed to the next."""
    df = in_chunks(df, rows)
    w = Window.partitionBy("_c").orderBy("_i")
    last = df.groupBy("_c").agg(F.max(F.struct("_i", *columns)).alias("_e"))
    following = last.select("_e", F.lead("_c").over(Window.orderBy("_c")).alias("_c")).filter("_c is not null")
    own = df.withColumns({f"_p{i}": F.lag(c).over(w) for i, c in enumerate(columns)}).withColumn("_first", F.row_number().over(w) == 1)
    met = own.join(F.broadcast(following), "_c", "left")
    return met.withColumns({f"prev_{c}": F.when(F.col("_first"), F.col(f"_e.{c}")).otherwise(F.col(f"_p{i}")) for i, c in enumerate(columns)}).drop("_e", "_first", *[f"_p{i}" for i in range(len(columns))])


def running_sum(df: DataFrame, value: Column, name: str, rows: int = ROWS) -> DataFrame:
    """Indexed rows with the sum of ``value`` up to and with each row; null values count nothing."""
    df = in_chunks(df, rows).withColumn("_v", F.coalesce(value, F.lit(0.0)))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    start = df.groupBy("_c").agg(F.sum("_v").alias("_s")).select("_c", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_from"))
    own = F.sum("_v").over(Window.partitionBy("_c").orderBy("_i"))
    # outer joins leave the plan below as it is, so that its shuffle is reused
    return df.withColumn("_own", own).join(F.broadcast(start), "_c", "left").withColumn(name, F.col("_from") + F.col("_own")).drop("_v", "_own", "_from")


def nearest_valid(df: DataFrame, value: Column, rows: int = ROWS) -> DataFrame:
    """Indexed rows with ``_prev`` and ``_next``: (i, v) of the nearest row with a non-null ``value``, itself included."""
    df = in_chunks(df, rows).withColumn("_v", F.when(value.isNotNull(), F.struct(F.col("_i").alias("i"), value.alias("v"))))
    edge = df.groupBy("_c").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_i"))).alias("_l"), F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_i"))).alias("_f"))
    by = Window.orderBy("_c")
    edge = edge.select(
        "_c",
        F.last("_l", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_pl"),
        F.last("_f", True).over(Window.orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)).alias("_nf"),
    )
    # what follows is what precedes in the other order: Spark goes over the rest of a chunk anew for each row of a frame that ends with it
    before = Window.unboundedPreceding, 0
    prev = F.last("_v", True).over(Window.partitionBy("_c").orderBy("_i").rowsBetween(*before))
    following = F.last("_v", True).over(Window.partitionBy("_c").orderBy(F.desc("_i")).rowsBetween(*before))
    df = df.withColumn("_p", prev).withColumn("_q", following).join(F.broadcast(edge), "_c", "left")
    return df.withColumn("_prev", F.coalesce("_p", "_pl")).withColumn("_next", F.coalesce("_q", "_nf")).drop("_v", "_p", "_q", "_pl", "_nf")


def quantiles(df: DataFrame, value: Column, shares: list[float], rows: int = ROWS) -> tuple[int, list[float | None]]:
    """The number of non-null values and their exact quantiles, linear between neighbours.

    Values are counted first. Few different ones are put in order in one window; more of them
    in chunks with running counts, so that no task gathers what grows with the table.
    """
    counts = df.select(value.alias("t")).filter("t is not null").groupBy("t").agg(F.count("*").cast("double").alias("n")).persist()
    try:
        several, n = counts.agg(F.count("*"), F.sum("n")).first()
        if not several:
            return 0, [None] * len(shares)
        if several <= rows:
            upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("t")))
        else:
            upto = running_sum(indexed(counts, "t", "t", rows), F.col("n"), "upto", rows)
        places = [p * (n - 1) for p in shares]
        at = lambda r: F.min(F.when(F.col("upto") > float(r), F.col("t")))
        found = upto.agg(*[at(r) for p in places for r in (p // 1, -(-p // 1))]).first()
        return int(n), [float(lo + (hi - lo) * (p % 1)) for p, lo, hi in zip(places, found[::2], found[1::2], strict=True)]
    finally:
        counts.unpersist()


def median_step(df: DataFrame, rows: int = ROWS) -> float:
    """The median positive step of the indexed column ``t``; infinite if there is none."""
    steps = with_previous(df.select("_i", "t"), ["t"], rows).filter("t > prev_t")
    m = quantiles(steps, F.col("t") - F.col("prev_t"), [0.5], rows)[1][0]
    return INF if m is None else m
