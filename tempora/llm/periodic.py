"""Periodic runs of words by a scan of all lags.

The words of a text become ids, and the ids are compared with themselves
shifted by every lag up to the number of words over the least exponent. A
stretch of matches at lag q is a run of period q. Numpy compares a block of lags
at once; Spark deals the work out: a long text is scanned by many tasks, each
with a range of lags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, table

#: A run has so many words at least, and is so many times its period.
LEAST, EXPONENT = 12, 2
#: Comparisons of one task; a text that needs more is dealt out by ranges of lags.
WORK = 1 << 30
#: Comparisons that numpy does at once.
BLOCK = 1 << 22
_RUN = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_ids(words: list) -> np.ndarray:
    """A number for each word, the same for equal words."""
    of: dict = {}
    return np.fromiter((of.setdefault(w, len(of)) for w in words), np.int32, len(words))


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def primitive(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether the stretch of period ``q`` from ``start`` on has no smaller one: as it is two periods long at least, such a one would divide ``q``."""
    unit = ids[start : start + q]
    return not any(np.array_equal(unit[: q - q // p], unit[q // p :]) for p in _primes(q))


def scan(ids: np.ndarray, first: int, last: int, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) whose period is from ``first`` to ``last``."""
    n, out = len(ids), []
    last = min(last, n // exponent)
    while first <= last:
        lags = np.arange(first, min(last, first + max(1, BLOCK // n) - 1) + 1)
        padded = np.concatenate([ids, np.full(lags[-1], -1, ids.dtype)])
        # row k holds the ids shifted by first + k; one False ends each row
        shifted = np.lib.stride_tricks.sliding_window_view(padded[first:], n - first)[: len(lags)]
        same = shifted == ids[: n - first]
        need = np.maximum(least - lags, (exponent - 1) * lags)
        some = np.flatnonzero(np.fromiter(map(np.count_nonzero, same), np.int64, len(same)) >= np.maximum(1, need))
        if len(some):
            flat = np.zeros((len(some), n - first + 2), np.int8)
            flat[:, 1:-1] = same[some]
            change = np.flatnonzero(np.diff(flat.ravel()))
            row, start = np.divmod(change[::2], n - first + 2)
            size = change[1::2] - change[::2]
            enough = size >= need[some[row]]
            for q, s, m in zip(lags[some[row[enough]]].tolist(), start[enough].tolist(), size[enough].tolist(), strict=True):
                if primitive(ids, s, q):
                    out.append((s, m + q, q))
        first = int(lags[-1]) + 1
    return out


def ranges(n: Column, exponent: int = EXPONENT, work: int = WORK) -> Column:
    """Ranges of lags (from, to) that need about ``work`` comparisons of ``n`` words each; one range if that is enough for all."""
    each = F.greatest(F.lit(1), F.floor(F.lit(work) / F.greatest(n, F.lit(1)))).cast("long")
    top = F.greatest(F.floor(n / exponent), F.lit(1)).cast("long")
    return F.transform(F.sequence(F.lit(1).cast("long"), top, each), lambda a: F.struct(a.alias("first"), F.least(a + each - 1, top).alias("last")))


def _scanned(parts: DataFrame, least: int, exponent: int) -> DataFrame:
    """digest and runs for each (digest, text, first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for raw, first, last in zip(batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True):
                words = (raw.as_py() or b"").split()
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in scan(word_ids(words), first.as_py(), last.as_py(), least, exponent)] if words else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, _RUN_TYPE)], ["digest", "runs"])

    return parts.mapInArrow(run, f"digest binary, runs {_RUN}")


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for s, m, q in runs:
        edge[s + q] += 1
        edge[s + m] -= 1
    return [w for w, deep in zip(words, np.cumsum(edge[:-1]), strict=True) if not deep]


def _finished(texts: DataFrame, runs_of: Callable[[list, list | None], list[tuple[int, int, int]]]) -> DataFrame:
    """doc_id, runs in order and the collapsed text for each (doc_id, text, runs found before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = [], []
            for raw, before in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                words = (raw.as_py() or b"").split()
                mine = sorted(runs_of(words, before.as_py()), key=lambda r: (r[0], r[2]))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in mine])
                kept.append(b" ".join(collapsed(words, mine)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, _RUN_TYPE), pa.array(kept, pa.string())], ["doc_id", "runs", "collapsed"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, runs {_RUN}, collapsed string")


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, work: int = WORK) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the collapsed text of every row of ``docs`` (doc_id, text; others are ignored).

    A run is a stretch of words of smallest period q, of ``max(least, exponent * q)``
    words at least, that no neighbour extends. Collapsing drops the words that a run
    contains after its first period and joins the others by one space. Null, empty
    and wordless texts have no runs and an empty collapsed text. Repeated rows and
    null ids are rows like others; equal long texts are scanned once. An empty table gives no rows.
    """
    if least < 1 or exponent < 2:
        raise ValueError("a run has a word at least and two periods at least")
    # by about six characters a word; shorter words make a task longer, not wrong
    guess = F.floor(F.length("text") / 6) + 1
    long = F.coalesce(guess * guess * 3 / 8 > work, F.lit(False))
    rows = docs.select("doc_id", "text")
    texts = rows.filter(long).withColumn("digest", F.unhex(F.sha2("text", 256)))
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    n = F.size(F.filter(F.split("text", SPACES), lambda w: w != "")).cast("long")
    parts = distinct.withColumn("n", n).select("digest", "text", F.explode(ranges(F.col("n"), exponent, work)).alias("r")).select("digest", "text", "r.first", "r.last")
    # ranges of one text go to tasks of their own
    found = _scanned(parts.repartition(F.col("digest"), F.col("first")), least, exponent)
    found = found.groupBy("digest").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    many = _finished(texts.join(found, "digest", "left").select("doc_id", "text", "runs"), lambda _, found: [(r["start"], r["length"], r["period"]) for r in found or []])
    few = rows.filter(~long).withColumn("runs", F.lit(None).cast(_RUN))
    return _finished(few, lambda words, _: scan(word_ids(words), 1, len(words), least, exponent)).unionByName(many)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts with the tail of every tenth, by a hash of its id, made periodic; its words are joined by one space."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    planted = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    rest = rows.filter(~planted).select("doc_id", "text")
    some = rows.filter(planted).select("doc_id", words.alias("w"), F.floor(F.col("h") / 10).alias("g")).withColumn("n", F.size("w").cast("long"))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).otherwise(0))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    kept = F.slice("w", F.lit(1), F.col("a").cast("int"))
    tail = F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int"))
    full = F.slice(F.flatten(F.array_repeat(tail, F.lit(11))), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    made = some.select("doc_id", F.array_join(F.concat(kept, full), " ").alias("text"))
    return rest.unionByName(made)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and the digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    start, length, period = -F.col("b.back"), F.col("b.length"), -F.col("b.less")
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                    lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS h FROM documents),
g AS (SELECT r, doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM d),
m AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
             THEN w[1:a] || list_transform(range(0, n - a), lambda i: w[a + i % (1 + (n - a) // (3 + g % 8)) + 1]) ELSE w END AS w FROM g),
e AS (SELECT r, n, unnest(w) AS v, unnest(range(0, n)) AS i FROM m),
p AS (SELECT x.r, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.r = y.r AND x.v = y.v AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
s AS (SELECT r, q, min(i) AS b, count(*) + q AS m FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM p)
      GROUP BY r, q, k HAVING count(*) + q >= greatest(12, 2 * q)),
u AS (SELECT r, b, m, q FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.r = s.r AND o.q < s.q AND s.q % o.q = 0 AND o.b <= s.b AND o.b + o.m >= s.b + s.m)),
c AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(b + q, b + m)) AS i FROM u) GROUP BY r),
k AS (SELECT r, string_agg(v, ' ' ORDER BY i) AS kept FROM e WHERE NOT EXISTS (SELECT 1 FROM (SELECT r, unnest(gone) AS i FROM c) z WHERE z.r = e.r AND z.i = e.i) GROUP BY r),
a AS (SELECT r, count(*) AS n_runs, string_agg(b || ',' || m || ',' || q || chr(10), '' ORDER BY b, q) AS runs,
             first(b ORDER BY m DESC, b, q) AS b, first(m ORDER BY m DESC, b, q) AS m, first(q ORDER BY m DESC, b, q) AS q FROM u GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b AS "start", a.m AS length, q AS period, 1000 * a.m // q AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM m LEFT JOIN a USING (r) LEFT JOIN k USING (r)
"""
