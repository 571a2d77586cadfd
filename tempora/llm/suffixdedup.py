"""Removal of byte strings of a given length that occur earlier in the corpus.

A document's windows (its strings of ``length`` bytes) are never all moved. Every
window has one anchor, its least k-gram by hash, which equal windows share.

1. Anchors whose k-gram occurs only once in the corpus are out.
2. The surroundings of an anchor hold all windows that it may stand in. Of equal
   surroundings only the first have to be looked into; all windows of the
   others occur earlier.
3. Where one k-gram has several surroundings, their windows are hashed one by
   one; those whose hash has an earlier place are marked.
4. Marks are gathered by document and the covered bytes are cut out.

Everything is grouped by hash with the least place as the value, which Spark
combines before shuffling; joins back are on keys that it may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, mixed, saved, table

#: Bytes of a string and of an anchor.
LENGTH, GRAM = 100, 56
#: Marks up to this many bytes are broadcast to the documents; more are joined by shuffle.
BROADCAST_BYTES = 48 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = mixed(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_OTHERS = mixed(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 17)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, b & (1 << 64) - 1, _U)])) for b in (_BASE, inverse))
        return self.up[:n], self.down[:n]


class Windows:
    """Hashes of the substrings of one document, and the anchors of its windows."""

    def __init__(self, raw: bytes, powers: Powers, length: int = LENGTH, gram: int = GRAM):
        self.n, self.length, self.gram = len(raw), length, gram
        self.bytes = b = np.frombuffer(raw, np.uint8)
        self.up, self.down = powers.of(self.n + 1)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_VALUES[b] * self.up[: self.n], dtype=_U)])
        self.grams = mixed((self.sums[gram:] - self.sums[:-gram]) * self.down[: self.n - gram + 1])
        v = (self.grams & _U(0xFFFFFFFF00000000)) | np.arange(len(self.grams), dtype=_U)
        size, width = 1, length - gram + 1
        while size * 2 <= width:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        count = self.n - length + 1
        least = np.minimum(v[:count], v[width - size : width - size + count])
        #: The anchor of each window, and the distinct anchors in order.
        self.anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
        self.anchors = self.anchor[np.flatnonzero(np.diff(self.anchor, prepend=-1))]

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and stop of the surroundings of anchors: all windows that they may stand in."""
        return np.maximum(at - (self.length - self.gram), 0), np.minimum(at + self.length, self.n)

    def surroundings(self) -> np.ndarray:
        lo, hi = self.around(self.anchors)
        return mixed((self.sums[hi] - self.sums[lo]) * self.down[lo] + (self.anchors - lo).astype(_U) * _U(0xA0761D6478BD642F) + (hi - lo).astype(_U))

    def strings(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of windows, 64 bits from each of two tables of byte values."""
        others = np.concatenate([np.zeros(1, _U), np.cumsum(_OTHERS[self.bytes] * self.up[: self.n], dtype=_U)])
        one, two = (mixed((s[starts + self.length] - s[starts]) * self.down[starts] + _U(1)) for s in (self.sums, others))
        return one, two


def _each(docs: DataFrame, schema: str, work, names: list[str], length: int, gram: int) -> DataFrame:
    """``work`` (of the id, the windows and any further columns) for every document that has a window; it returns arrays of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            held = 0
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py()
                if raw is None or len(raw) < length:
                    continue
                got = work(batch.column(0)[i].as_py(), Windows(raw, powers, length, gram), [c[i].as_py() for c in batch.columns[2:]])
                for o, g in zip(out, got, strict=True):
                    o.append(g)
                held += len(got[0])
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names)
                    out, held = [[] for _ in names], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names)

    return docs.mapInArrow(run, schema)


def _with_marks(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with the arrays in ``marks`` by id; both kinds of join give the same."""
    size = marks.agg(F.sum(sum((F.coalesce(F.size(c), F.lit(0)) for c in marks.columns if c != "_id"), F.lit(0)) * 4 + 64)).first()[0] or 0
    return rows.join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks, "_id", how)


def _marks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """_id and the places of what occurs earlier: ``_whole`` (anchors whose whole surroundings do) and ``_starts`` (of windows)."""

    def grams(_id, w: Windows, _):
        return [w.grams[w.anchors].view(np.int64)]

    def anchors(i, w: Windows, _):
        return [w.grams[w.anchors].view(np.int64), w.surroundings().view(np.int64), np.full(len(w.anchors), i), w.anchors.astype(np.int32)]

    def windows(i, w: Windows, at):
        starts = np.flatnonzero(np.isin(w.anchor, at[0]))
        return [*(h.view(np.int64) for h in w.strings(starts)), np.full(len(starts), i), starts.astype(np.int32)]

    often = _each(docs, "gram long", grams, ["gram"], length, gram).groupBy("gram").agg(F.count("*").alias("n"))
    often = saved(often.filter("n > 1").select("gram"))
    every = _each(docs, "gram long, around long, _id long, at int", anchors, ["gram", "around", "_id", "at"], length, gram)
    every = saved(every.join(often, "gram"))
    first = saved(every.groupBy("gram", "around").agg(F.min(F.struct("_id", "at")).alias("first"), F.count("*").alias("n")))
    several = first.groupBy("gram").agg((F.min("around") != F.max("around")).alias("several")).filter("several").select("gram")
    opened = saved(first.join(several, "gram").select("first._id", "first.at").groupBy("_id").agg(F.collect_list("at").alias("_at")))
    again = every.join(first.filter("n > 1").select("gram", "around", "first"), ["gram", "around"])
    again = again.filter((F.col("_id") != F.col("first._id")) | (F.col("at") != F.col("first.at"))).groupBy("_id").agg(F.collect_set("at").alias("_whole"))
    again = saved(again)
    discard(often, every, first)

    # read twice below: hashing windows again costs less than keeping them
    strings = _each(_with_marks(docs, opened, "inner"), "string long, other long, _id long, start int", windows, ["string", "other", "_id", "start"], length, gram)
    least = strings.groupBy("string", "other").agg(F.min(F.struct("_id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = strings.join(least, ["string", "other"]).filter((F.col("_id") != F.col("first._id")) | (F.col("start") != F.col("first.start")))
    later = saved(later.groupBy("_id").agg(F.collect_set("start").alias("_starts")))
    return saved(again.join(later, "_id", "full"))


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``kept`` (bytes that are left), ``n_bytes``, ``n_removed`` and ``n_spans``.

    A byte goes if it is in a string of ``length`` bytes that also starts earlier: in
    a document of smaller doc_id, or before in the same one. Strings are judged
    on the input. Null text is empty; texts shorter than ``length`` stay whole.
    doc_id tells documents apart: rows that share one stand at the same places,
    and a null one comes first. Input columns with the names of results are
    replaced, and names that start with ``_`` are used inside. An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("text", "kept", "n_bytes", "n_removed", "n_spans")]
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(ident.alias("_id"), F.col("text").cast("binary").alias("_raw"))
    marks = _marks(rows, length, gram)
    out = docs.select(*[F.col(f"`{c}`") for c in keep], ident.alias("_id"), F.col("text").cast("binary").alias("_raw"))
    out = _with_marks(out, marks, "left").select(*[F.col(f"`{c}`") for c in keep], "_raw", "_whole", "_starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 3
            kept, counts = [], []
            for raw, whole, starts in zip(*batch.columns[k:], strict=True):
                raw = raw.as_py() or b""
                n = len(raw)
                if n < length or not (whole.is_valid or starts.is_valid):
                    kept.append(raw)
                    counts.append((n, 0, 0))
                    continue
                at, s = (np.array(x.as_py() or [], np.int64) for x in (whole, starts))
                # rows that share an id may be shorter than the one that a mark is for
                at, s = at[at + gram <= n], s[s + length <= n]
                edge = np.zeros(n + 1, np.int32)
                lo, hi = np.maximum(at - (length - gram), 0), np.minimum(at + length, n)
                long = hi - lo >= length
                np.add.at(edge, np.concatenate([lo[long], s]), 1)
                np.add.at(edge, np.concatenate([hi[long], s + length]), -1)
                gone = np.cumsum(edge[:n]) > 0
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
                counts.append((n, int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))))
            made = [pa.array(kept, pa.binary()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], [*keep, "kept", "n_bytes", "n_removed", "n_spans"])

    schema = T.StructType([out.schema[c] for c in keep]).add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    return out.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span
      FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, span),
p AS (SELECT doc_id, span, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS gone, count(*) AS spans FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
