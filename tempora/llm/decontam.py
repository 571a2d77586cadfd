"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is a set of windows of ``n`` words (a shorter item is one
window). A window counts only if it occurs whole, so each of its inner
shingles of five words must occur, and the rarest of them in the documents is
the one prefix token that has to be joined. A joined token gives the window's
start (positional bound), which must leave room for the whole window within the
document (length bound); the words are then compared one by one.

The benchmark's side is cut into blocks of a bounded number of words, so that
what a task holds never grows with it: documents are streamed past one block at
a time, and the hits of several blocks are put together by document.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, saved, shingle_hashes, table

#: Words of the benchmark that one block holds at most (beside its longest item).
BLOCK_WORDS = 400_000
#: Words of an inner shingle.
INNER = 5

#: Keeps 0-9, a-z and bytes of non-ASCII characters, lower-cases A-Z, and makes the rest spaces.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text with A-Z lower-cased."""
    return raw.translate(_TABLE).split()


class Block:
    """The windows of some benchmark items."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.windows: dict[bytes, tuple[int, set[str]]] = {}
        for item, raw in items:
            words = words_of(raw)
            size = min(n, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                owners = self.windows.setdefault(b" ".join(words[i : i + size]), (size, set()))[1]
                if item is not None:
                    owners.add(item)
        hashes = WordHashes()
        self.inner: dict[int, dict[bytes, np.ndarray]] = defaultdict(dict)
        for text, (size, _) in self.windows.items():
            k = min(INNER, size)
            self.inner[k][text] = shingle_hashes(hashes.of(text.split()), k)
        self.keys = {k: np.unique(np.concatenate(list(w.values()))) for k, w in self.inner.items()}

    def index(self, counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, list[list[tuple[int, int, bytes]]]]]:
        """For each shingle length: the sorted prefix tokens, and what each may start: (offset, words, window)."""
        out = {}
        for k, windows in self.inner.items():
            found = defaultdict(list)
            for text, own in windows.items():
                often = counts[k][np.searchsorted(self.keys[k], own)]
                i = int(np.lexsort((own, often))[0])
                found[int(own[i])].append((i, self.windows[text][0], text))
            keys = np.array(sorted(found), np.uint64)
            out[k] = keys, [found[int(x)] for x in keys]
        return out


def _matches(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``h`` whose value is among the sorted ``keys``, and which key."""
    if not len(h) or not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    hit = np.flatnonzero(keys[at] == h)
    return hit, at[hit]


def _counts(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """How often each inner shingle of the block stands in the documents; the result is as long as the block."""
    keys = block.keys

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHashes(), {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                if raw:
                    h = hashes.of(words_of(raw))
                    for k, v in keys.items():
                        total[k] += np.bincount(_matches(v, shingle_hashes(h, k))[1], minlength=len(v))
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int64()), pa.array(v[at], pa.int64())], ["k", "at", "n"])

    out = {k: np.zeros(len(v), np.int64) for k, v in keys.items()}
    for k, at, n in docs.select(F.col("text")).mapInArrow(count, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n")).collect():
        out[k][at] = n
    return out


def _search(docs: DataFrame, block: Block, index: dict) -> DataFrame:
    """``docs`` with n_words, spans (merged word ranges inside windows) and items."""
    owners = {text: sorted(o) for text, (_, o) in block.windows.items()}
    schema = docs.drop("_text").schema
    names = [*schema.names, "n_words", "spans", "items"]
    types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n_words, spans, items = [], [], []
            for raw in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                words = words_of(raw or b"")
                h, found, own = hashes.of(words), set(), set()
                for k, (keys, starts) in index.items():
                    for at, key in zip(*_matches(keys, shingle_hashes(h, k)), strict=True):
                        for offset, size, text in starts[key]:
                            start = int(at) - offset
                            if start >= 0 and start + size <= len(words) and (start, start + size) not in found and b" ".join(words[start : start + size]) == text:
                                found.add((start, start + size))
                                own.update(owners[text])
                merged: list[list[int]] = []
                for a, b in sorted(found):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                n_words.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                items.append(sorted(own))
            made = [pa.array(x, t) for x, t in zip((n_words, spans, items), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)

    span = T.StructType().add("start", T.LongType()).add("stop", T.LongType())
    out = T.StructType(schema.fields).add("n_words", T.LongType()).add("spans", T.ArrayType(span)).add("items", T.ArrayType(T.StringType()))
    return docs.mapInArrow(search, out)


def find_windows(docs: DataFrame, benchmark: DataFrame, n: int = 13, keep_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``n_words``, ``spans``, ``items`` and ``n_hit``.

    ``spans`` are the maximal word ranges [start, stop) covered by occurrences of
    benchmark windows, ``items`` the ids of the items with such windows, sorted as
    strings. Null or empty text has no words and no hits; null or wordless
    items have no window; an item without id covers words but is not listed;
    repeated items count once. Input columns with the names of results are
    replaced. An empty table on either side gives no rows, or rows without hits.
    """
    made = {"n_words", "spans", "items", "n_hit"}
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in made and (keep_text or c != "text")]
    rows = docs.select(*keep, F.col("text").alias("_text"))
    bench = saved(benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("raw")).filter("raw is not null"))
    words = bench.agg(F.sum(F.length("raw"))).first()[0] or 0
    n_blocks = max(1, math.ceil(words / 6 / BLOCK_WORDS))
    parts = []
    for b in range(n_blocks):
        own = bench.filter(F.pmod(F.xxhash64("raw"), F.lit(n_blocks)) == b).collect()
        block = Block([(r.item, bytes(r.raw)) for r in own], n)
        parts.append(_search(rows, block, block.index(_counts(docs.select("text"), block))))
    if n_blocks == 1:
        out = parts[0]
    else:
        out = _together(parts)
    return out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]))


def _together(parts: list[DataFrame]) -> DataFrame:
    """The hits of all blocks for each row; repeated rows get equal results, as many as there were."""
    every = parts[0].withColumn("_b", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("_b", F.lit(i)))
    key = [c for c in parts[0].columns if c not in ("spans", "items")]
    got = every.groupBy(*[F.col(f"`{c}`") for c in key]).agg(
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("_s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.sum((F.col("_b") == 0).cast("int")).alias("_n"),
    )
    grow = lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["stop"] >= s["start"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["stop"], s["stop"]).alias("stop")))),
    ).otherwise(F.concat(a, F.array(s)))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    got = got.withColumn("spans", F.aggregate("_s", none, grow)).withColumn("_r", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))))
    return got.select(*[F.col(f"`{c}`") for c in parts[0].columns])


def contaminated() -> F.Column:
    """At least one word in twenty is inside a benchmark window."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def query(spark, sf_dir: str) -> DataFrame:
    hits = find_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT row, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
       FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM b) WHERE len(w) >= size)),
h AS (SELECT row, i, dw.size AS size, item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT row, i, size FROM h)) GROUP BY row),
it AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h WHERE item IS NOT NULL) GROUP BY row)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN it USING (row)
"""
