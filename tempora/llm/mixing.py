"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target number of words by weight. Its documents stand in one
order, by a hash of their id, as many times over as the target asks; the
running word count of a document in that order is its place in the source's
cumulative demand. The source's weight schedule over training time is
integrated and inverted, which turns that place into a training position, and
documents are range-sorted by position.

Running sums never gather a source in one task: sources are cut into hash
buckets, bucket totals are summed first, and windows run within a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, saved

#: A schedule is a list of (time, weight) knots on [0, 1], linear between knots.
Schedule = Sequence[tuple[float, float]]
EARLY, FLAT, LATE = [(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (1.0, 1.5)]

#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    parts = F.split(text, SPACES, -1)
    edges = (F.element_at(parts, 1) == "").cast("long") + (F.element_at(parts, -1) == "").cast("long")
    return F.coalesce(F.greatest(F.lit(0).cast("long"), F.size(parts).cast("long") - edges), F.lit(0).cast("long"))


def source_targets(sized: DataFrame, weights: Sequence[float], cap: float, share: float = 1.0) -> DataFrame:
    """One row per source: its size, rank, and target words.

    ``share`` of all words is dealt by weight; a source stops at ``cap`` times
    its own size and the excess goes to the others by weight. With sources in
    order of cap per weight, the capped ones come first, so one pass of running
    sums finds the level at which the rest is filled.
    """
    one = sized.groupBy("_src", "_null").agg(F.sum("_size").alias("_source_size"))
    by_name = Window.orderBy("_null", "_src")
    level = Window.orderBy("_full", "_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    t = one.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("_w", w)
    t = t.withColumn("_cap", F.col("_source_size") * float(cap)).withColumn("_full", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    t = t.withColumn("_total", F.sum("_source_size").over(every) * float(share))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    t = t.withColumn("_capped", left / rest > F.col("_full"))
    left = F.col("_total") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(every)
    rest = F.sum(F.when(~F.col("_capped"), F.col("_w")).otherwise(0.0)).over(every)
    fill = F.when(rest > 0, left / rest).otherwise(0.0)
    t = t.withColumn("_target", F.when(F.col("_capped"), F.col("_cap")).otherwise(fill * F.col("_w")))
    return t.select("_src", "_null", "_rank", "_source_size", "_target")


def invert(u: Column, schedule: Schedule) -> Column:
    """The time at which the schedule's normalised integral reaches ``u``."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (w0 + w1) / 2 * (t1 - t0)
        if area > 0:
            pieces.append((t0, w0, t1, w1, total, total + area))
            total += area
    if not pieces:
        raise ValueError("a schedule needs a positive weight somewhere")
    out = F.lit(float(pieces[-1][2]))
    for t0, w0, t1, w1, a0, a1 in reversed(pieces):
        need = F.greatest(u * total - a0, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        if slope:
            dt = (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0))) - w0) / slope
        else:
            dt = need / w0
        out = F.when(u * total <= a1, F.least(F.lit(float(t1)), t0 + dt)).otherwise(out)
    return out


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: int = 3,
    buckets: int = 4096,
    schedules: Sequence[Schedule] = (EARLY, FLAT, LATE),
) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    ``copies`` is an array of (copy, words, position), one per time the document
    is read; the last document at a target is read in part, so a source's taken
    words are its target rounded. Null text counts no words; a null source is a
    source of its own, ranked last; null ids stand together first. Repeated rows
    are separate documents. Input columns with the names of results are replaced,
    and names that start with ``_`` are used inside. An empty table gives no rows.
    """
    if len(schedules) % len(weights):
        raise ValueError("give one schedule per weight")
    made = {"size", "source_size", "target", "taken", "copies"}
    keep = [c for c in docs.columns if c not in made]
    at = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        word_count(F.col("text")).alias("_size"),
        F.coalesce(F.col("source"), F.lit("")).alias("_src"),
        F.col("source").isNull().alias("_null"),
    )
    targets = saved(source_targets(sized, weights, cap))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    sized = sized.withColumn("_at", at).withColumn("_bucket", F.conv(F.substring("_at", 1, 3), 16, 10).cast("int") % buckets)
    key = ["_src", "_null", "_bucket"]
    sums = sized.groupBy(*key).agg(F.sum("_size").alias("_in"))
    run = Window.partitionBy("_src", "_null").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, F.coalesce(F.sum("_in").over(run), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*key).orderBy("_at", "_size", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = placed.join(offsets, key).join(targets, ["_src", "_null"])
    start = F.col("_offset") + F.col("_before")
    goal = F.floor(F.col("_target") + 0.5).cast("long")

    def one(r: int) -> Column:
        begin = F.lit(r) * F.col("_source_size") + start
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), goal - begin))
        u = F.when(goal > 0, begin / goal).otherwise(0.0)
        time = invert(u, schedules[-1])
        for i, s in reversed(list(enumerate(schedules[:-1]))):
            time = F.when(F.col("_rank") % len(schedules) == i, invert(u, s)).otherwise(time)
        return F.struct(F.lit(r).alias("copy"), words.alias("words"), time.alias("position"))

    copies = F.filter(F.array(*[one(r) for r in range(cap)]), lambda c: c["words"] > 0)
    out = placed.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        taken.alias("taken"),
        "copies",
    )


def curriculum(docs: DataFrame, unread: bool = False, **how) -> DataFrame:
    """The training stream: a row for each read of a document, in order of ``position``, with ``copy`` and ``words`` to read.

    With ``unread``, documents that are never read follow at the end, a row each with null ``copy``, ``words`` and ``position``.
    """
    rows = plan_mix(docs, **how).withColumn("_c", F.explode_outer("copies") if unread else F.explode("copies"))
    keep = [c for c in rows.columns if c not in ("copies", "_c", "copy", "words", "position")]
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], "_c.copy", "_c.words", "_c.position")
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc(), F.col("copy").asc()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    # a row for each document, where the stream reads it first; later reads are in ``taken``
    stream = curriculum(docs, unread=True).filter("copy is null or copy = 0")
    return stream.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS nul,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT src, nul, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY nul, encode(src)) - 1 AS rnk FROM s),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap,
      CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM r),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) > cap / w AS capped
      FROM w WINDOW b AS (ORDER BY cap / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS full_words, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS open_w FROM l),
t AS (SELECT src, nul, source_size, CASE WHEN capped THEN cap WHEN open_w > 0 THEN (total - full_words) / open_w * w ELSE 0 END AS target FROM g),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
      CAST(sum(size) OVER (PARTITION BY d.src, d.nul ORDER BY h, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS bef
      FROM d JOIN t ON d.src = t.src AND d.nul = t.nul)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(greatest(0, least(size, goal - bef)) + greatest(0, least(size, goal - source_size - bef))
            + greatest(0, least(size, goal - 2 * source_size - bef)) AS BIGINT) AS taken
FROM p
"""
