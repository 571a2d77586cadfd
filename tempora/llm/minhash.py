"""MinHash near-duplicates with odd sketches.

1. Every text becomes a set of word shingles; its MinHash samples are cut into
   bands, and the same samples are folded into an odd sketch: a bitmap whose
   bits are the parities of the samples that fall on them. The XOR of two odd
   sketches has the bits of the samples that differ, so its population count
   estimates high similarities precisely.
2. Texts with equal sets are one class. Only classes are compared.
3. Classes that share a band are candidates. In a first round each is paired
   with the smallest member of the band's bucket only. Sketches sort out what
   is too far, full sets confirm the rest, and components are formed.
4. In a second round, members of one bucket that are still in different
   components are paired: directly in small buckets, in others if their sets
   share one of their rarest items, as sets of enough similarity must, at
   places that leave room for the overlap. All pairs of a bucket are thus
   settled, by a test or by being connected already, while texts that share a
   long common passage but are otherwise different are not paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, mixed, saved, scratch, shingle_hashes, table, words_of
from .graph import components

#: 40 bands of 5 samples miss a pair of similarity 0.8 with probability 1.3e-7.
BANDS, ROWS = 40, 5
#: Longs of an odd sketch (512 bits).
SKETCH = 8
#: Buckets with more members (but for the hub) are paired by rare items in the second round.
SMALL = 8
#: Up to so many numeric ids are broadcast to fetch their texts; more, or other ids, are joined as Spark decides.
BROADCAST_NODES = 1_000_000
_ODD = [f"o{i}" for i in range(SKETCH)]


def shingle_set(raw: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; fewer words are one shingle, no words none."""
    words = words_of(raw or b"")
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(hashes.of(words), min(k, len(words))) + np.uint64(min(k, len(words))))


def min_samples(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each factor the smallest product with a member of ``s``, modulo 2^64."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(low, (factors[:, None] * s[None, i : i + 1024]).min(1), out=low)
    return low


def fold(samples: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """The odd sketch of the samples: each toggles one bit, chosen by its value and place."""
    bit = mixed(samples + np.arange(1, len(samples) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * longs)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def farthest(threshold: float, n: int = BANDS * ROWS, longs: int = SKETCH, sigmas: float = 6) -> int:
    """The population count that sketches of sets of similarity ``threshold`` stay below but for ``sigmas`` deviations."""
    bits = 64 * longs

    def odd(flips: float) -> float:
        return bits / 2 * (1 - (1 - 2 / bits) ** flips)

    flips = 2 * n * (1 - threshold)
    spread = math.sqrt(n * threshold * (1 - threshold)) * 2
    noise = math.sqrt(bits / 4 * (1 - (1 - 2 / bits) ** (2 * flips)))
    return math.ceil(odd(flips) + sigmas * math.hypot(odd(flips + spread) - odd(flips), noise))


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and odd sketch of each text."""
    factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            n, digest, keys, odd = [], [], [], np.zeros((batch.num_rows, SKETCH), np.int64)
            for i, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                s = shingle_set(raw, k, hashes)
                n.append(len(s))
                if not len(s):
                    digest.append(None)
                    keys.append(None)
                    continue
                low = min_samples(s, factors)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(shingle_hashes_of_rows(low.reshape(bands, rows), salt).view(np.int64))
                odd[i] = fold(low)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, odd.T.copy())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "digest", "bands", *_ODD])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"{o} long" for o in _ODD))


def shingle_hashes_of_rows(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """One hash for each row of samples, different for each band."""
    out = salt.copy()
    for i in range(x.shape[1]):
        out = mixed(out + x[:, i])
    return out


def full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node and the whole sorted set of shingle hashes of its text, for the documents that ``nodes`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(raw, k, hashes).view(np.int64) for raw in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])

    nodes = saved(nodes)
    if isinstance(docs.schema["doc_id"].dataType, T.NumericType) and nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)  # else every text would be shuffled to find a few
    kind = docs.schema["doc_id"].dataType.simpleString()
    some = docs.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi")
    return some.mapInArrow(run, f"node {kind}, items array<long>")


def _near(limit: int) -> Column:
    far = F.lit(0)
    for o in _ODD:
        far = far + F.bit_count(F.col(f"a.{o}").bitwiseXOR(F.col(f"b.{o}")))
    return far <= limit


def _confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (src, dst) whose full sets reach ``percent`` per cent of similarity."""
    ends = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
    sets = saved(full_sets(docs, ends, k))
    a = sets.select(F.col("node").alias("src"), F.col("items").alias("x"))
    b = sets.select(F.col("node").alias("dst"), F.col("items").alias("y"))
    both = pairs.join(a, "src").join(b, "dst").withColumn("inter", F.size(F.array_intersect("x", "y")).cast("long"))
    return both.filter(100 * F.col("inter") >= percent * (F.size("x") + F.size("y") - F.col("inter"))).select("src", "dst").distinct()


def _pairs(rows: DataFrame, key: str, also: Column | None = None) -> DataFrame:
    """Distinct pairs (src, dst) of rows that share ``key`` but no component, and for which ``also`` holds."""
    a, b = (rows.select(*[F.col(c).alias(c + x) for c in rows.columns]) for x in "ab")
    on = (F.col(f"{key}a") == F.col(f"{key}b")) & (F.col("componenta") < F.col("componentb"))
    met = a.join(b, on if also is None else on & also)
    return met.select(F.greatest("nodea", "nodeb").alias("src"), F.least("nodea", "nodeb").alias("dst")).distinct()


def _split(rows: DataFrame, key: str) -> DataFrame:
    """The keys of ``rows`` that have several components, and how many rows."""
    got = rows.groupBy(key).agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    return got.filter("lo <> hi").select(key, "size")


def _prefixes(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """node, n (size of the set), item and place of the rarest items of each set: sets of enough similarity share one of them."""
    items = saved(full_sets(docs, nodes, k).select("node", F.size("items").alias("n"), F.explode("items").alias("item")))
    often = items.groupBy("item").agg(F.count("*").alias("c")).filter("c > 1")
    ranked = items.join(often, "item", "left").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "item"))).alias("all"))
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    rare = ranked.select("node", "n", F.posexplode(F.slice("all", 1, F.col("n") - need + 1)).alias("place", "x"))
    return rare.filter("x.c > 1").select("node", "n", F.col("x.item").alias("item"), "place")


def _unsettled(docs: DataFrame, shared: DataFrame, comp: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of nodes that share a bucket but no component, other than with its hub, which have been tried."""
    comp = comp.withColumnRenamed("id", "node")
    of = shared.filter("node <> hub").select("key", "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = saved(of)
    rest = saved(of.join(_split(of, "key"), "key"))
    few = _pairs(rest.filter(F.col("size") <= SMALL).select("key", "node", "component"), "key")
    many = saved(rest.filter(F.col("size") > SMALL).select("node", "component").distinct())
    if many.isEmpty():
        return few
    rare = saved(_prefixes(docs, many.select("node"), k, percent).join(many, "node"))
    rare = rare.join(_split(rare, "item").select("item"), "item")
    left = F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb"))
    return few.unionByName(_pairs(rare, "item", (100 + percent) * left >= percent * (F.col("na") + F.col("nb")))).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents are linked if ``100 * intersection >= percent * union`` of
    their sets of ``k``-word shingles; component_id is the smallest doc_id
    reachable. Null, empty and wordless texts have empty sets and are linked with
    nothing. Rows that share a doc_id count as one document with the links of
    them all. A null id takes the smallest id it is linked with, or null, and is
    never kept. An empty table gives no rows.
    """
    with scratch() as keep:
        return keep(_grouped(docs, k, percent))


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    sk = saved(sketches(docs, k))
    limit = farthest(percent / 100)
    one = [F.first(c).alias(c) for c in ("bands", *_ODD)]
    classes = saved(sk.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), *one).filter("node is not null"))
    spread = classes.select("node", F.explode("bands").alias("key"))
    hubs = spread.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub <> last").select("key", "hub")
    shared = saved(spread.join(hubs, "key"))
    odd = classes.select("node", *_ODD)

    def close(pairs: DataFrame) -> DataFrame:
        a = odd.select(F.col("node").alias("src"), *_ODD).alias("a")
        b = odd.select(F.col("node").alias("dst"), *_ODD).alias("b")
        got = pairs.alias("p").join(a, F.col("p.src") == F.col("a.src")).join(b, F.col("p.dst") == F.col("b.dst"))
        return got.filter(_near(limit)).select("p.src", "p.dst")

    star = saved(close(shared.filter("node <> hub").select(F.col("node").alias("src"), F.col("hub").alias("dst")).distinct()))
    links = saved(_confirmed(docs, star, k, percent))
    comp = saved(components(links))

    pairs = saved(close(_unsettled(docs, shared, comp, k, percent)))
    if not pairs.isEmpty():
        more = saved(_confirmed(docs, pairs, k, percent))
        if not more.isEmpty():
            comp = saved(components(links.unionByName(more)))

    own = classes.select("digest", "node").join(comp.withColumnRenamed("id", "node"), "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = sk.select("doc_id", "n_shingles", "digest").join(own, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
r AS (SELECT doc_id, e.g, row_number() OVER (PARTITION BY doc_id ORDER BY c, e.g) AS k FROM e JOIN (SELECT g, count(*) AS c FROM e GROUP BY g) f ON e.g = f.g),
x AS (SELECT doc_id, r.g, n FROM r JOIN n USING (doc_id) WHERE 100 * (k - 1) <= 20 * n),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i AS (SELECT a, b, count(*) AS inter FROM c JOIN e p ON p.doc_id = a JOIN e q ON q.doc_id = b AND q.g = p.g GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * inter >= 80 * (p.n + q.n - inter)),
sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(min(b), n.doc_id)) AS component_id,
       n.doc_id = least(n.doc_id, coalesce(min(b), n.doc_id)) AS kept
FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n
"""
