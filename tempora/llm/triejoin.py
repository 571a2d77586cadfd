"""Near-duplicates by a join over prefix trees of n-gram sets.

1. Sets of enough similarity share an item of their prefixes, which are the first items, in any one
   order for all sets, that one of them has to have in common with the other. Texts with equal sets are one class. The order
   begins with the items whose hashes are low, a third of all: these are counted over all classes, and
   rare ones come first. A class with items of its own has these in its prefix, and few or none of others.
2. Classes are dealt to shards by the most frequent of these items and by their size, so that
   near copies meet; what would be too much for a task is salted. A class is a query to the
   shards that share enough of its prefix: where the shorter prefix ends, a set of enough similarity
   lacks few of the items so far, so most of them are common. It is sent once to a shard however many items they share.
3. In a task, a shard's whole sets become a prefix tree, the shard's frequent
   items first, so that near copies share long paths. One traversal serves many
   queries: the overlap of a path with each query is counted once for all sets below it, and
   a subtree is left as soon as what remains of its sets, or of the query, cannot make up the
   similarity. At the end of a set, the overlap is exact, and only links that join two components are returned.
4. A first round asks a class's own shard and, of each of its items, the first shard. Where
   an item's classes are still in several components, a second round asks
   the others. All pairs are thus tested or connected already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, discard, saved, scratch, table
from .graph import components
from .minhash import BROADCAST_NODES, shingle_set

#: A shard has about so many sets, and so many items of sets, at most; a task so many queries.
SETS, ITEMS, QUERIES = 1000, 1 << 21, 1000
#: Sizes of the sets of a shard differ by this factor at most.
BAND = 1.08
#: Hashes below this are low: the items that are counted, and put in order by their counts.
LOW = (1 << 64) // 3
#: Items that a traversal goes through before it looks at the bounds again, at first.
STEP = 32
#: Cells of the table of items and queries that one traversal uses.
CELLS = 1 << 26


def needed(n: int, percent: int) -> int:
    """The length of a set's prefix: it shares one of these items with all sets of enough similarity."""
    return n + (-percent * n // 100) + 1


def first_items(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, lows (its low items) and items: these by hash, and as many of the next as its prefix still needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in batches:
            n, digest, lows, items = [], [], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(raw, k, hashes)
                low = int(np.searchsorted(s, np.uint64(LOW)))
                n.append(len(s))
                lows.append(low)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                items.append(s[: max(low, needed(len(s), percent))].view(np.int64) if len(s) else None)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(lows, pa.int32()), pa.array(items, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "digest", "lows", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, lows int, items array<long>")


class PrefixTree:
    """Sets of numbers as paths of one tree; its branches are cut into steps of a growing number of items."""

    def __init__(self, sets: list[np.ndarray], groups: list):
        """``sets`` in ascending order within; ``groups`` are the sets' components."""
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        rows = [sets[i] for i in self.order]
        sizes = np.array([len(r) for r in rows])
        groups = [groups[i] for i in self.order]
        common = np.zeros(len(rows), np.int64)
        for i in range(1, len(rows)):
            m = min(len(rows[i - 1]), len(rows[i]))
            differ = rows[i - 1][:m] != rows[i][:m]
            common[i] = differ.argmax() if differ.any() else m
        #: of each branch: items, depth at its end, sets below from and to, least and greatest size, component if there is only one, sets that end here
        self.branches: list[tuple] = []
        #: the branch that follows the subtree of each
        self.after: list[int] = []
        stack = [(0, len(rows), 0, STEP)]
        open_: list[tuple[int, int]] = []
        while stack:
            lo, hi, depth, step = stack.pop()
            while open_ and open_[-1][1] <= lo:
                self.after[open_.pop()[0]] = len(self.branches)
            fork = int(common[lo + 1 : hi].min()) if hi - lo > 1 else len(rows[lo])
            end = min(fork, depth + step)
            below = set(groups[lo:hi])
            ends = [lo] if len(rows[lo]) == end else []
            self.branches.append((rows[lo][depth:end], end, lo, hi, int(sizes[lo:hi].min()), int(sizes[lo:hi].max()), below.pop() if len(below) == 1 else None, ends))
            self.after.append(0)
            open_.append((len(self.branches) - 1, hi))
            if end < fork:
                stack.append((lo, hi, end, 2 * step))
                continue
            start, parts = lo + len(ends), []
            for i in range(start + 1, hi):
                if common[i] == end:
                    parts.append((start, i, end, STEP))
                    start = i
            if start < hi:
                parts.append((start, hi, end, STEP))
            stack.extend(reversed(parts))
        for i, _ in open_:
            self.after[i] = len(self.branches)
        self.last = np.array([b[0][-1] if len(b[0]) else -1 for b in self.branches])

    def matches(self, queries: list[np.ndarray], sizes: np.ndarray, groups: list, before: np.ndarray, width: int, percent: int) -> Iterator[tuple[int, int]]:
        """(query, set) of enough similarity, for sets at places smaller than ``before``; sets of a query's own component may be left out.

        ``sizes`` are those of the whole queries, of which ``queries`` hold the items that the tree has, of ``width`` different ones.
        """
        have = np.zeros((width, len(queries)), np.uint8)
        past = np.zeros((len(self.branches), len(queries)), np.int32)
        for j, q in enumerate(queries):
            have[q, j] = 1
            past[:, j] = np.searchsorted(q, self.last, side="right")
        held = np.array([len(q) for q in queries])
        groups = np.array(groups, dtype=object)
        path: list[tuple[int, np.ndarray, np.ndarray]] = [(len(self.branches), np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        i = 0
        while i < len(self.branches):
            while path[-1][0] <= i:
                path.pop()
            _, who, overlap = path[-1]
            items, depth, lo, _, least, most, group, ends = self.branches[i]
            if len(items):
                overlap = overlap + (have[items].sum(0, dtype=np.int64) if len(who) == len(queries) else have[items[:, None], who].sum(0, dtype=np.int64))
            size = sizes[who]
            open_ = (before[who] > lo) & ((100 + percent) * (overlap + most - depth) >= percent * (size + most))
            # nothing of a query is left beyond its last item, and before a branch ends nothing is known of what follows
            open_ &= (100 + percent) * (overlap + held[who] - past[i, who]) >= percent * (size + least)
            if group is not None:
                open_ &= groups[who] != group
            if not open_.all():
                who, overlap, size = who[open_], overlap[open_], size[open_]
            if not len(who):
                i = self.after[i]
                continue
            for e in ends:
                for j in who[((100 + percent) * overlap >= percent * (size + depth)) & (before[who] > e)]:
                    yield int(j), self.order[e]
            path.append((self.after[i], who, overlap))
            i += 1


def joined(members: list[tuple], queries: list[tuple], own: bool, percent: int) -> list[tuple]:
    """Links (src, dst) that join components, of the queries with the members and, if ``own``, among these; each a (node, items, component)."""
    flat = np.concatenate([m[1] for m in members])
    items, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(items), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(items))
    ends = np.cumsum([len(m[1]) for m in members])
    sets = [np.sort(x) for x in np.split(rank[inverse], ends[:-1])]
    tree = PrefixTree(sets, [m[2] for m in members])

    def known(s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(items, s), len(items) - 1)
        return np.sort(rank[at[items[at] == s]])

    asked = [(m, sets[i], place) for place, i in enumerate(tree.order) for m in [members[i]]] if own else []
    asked += [(q, known(q[1]), len(members)) for q in queries]
    top: dict = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    links, each = [], max(1, min(CELLS // len(items), CELLS // 4 // len(tree.branches)))
    for i in range(0, len(asked), each):
        some = asked[i : i + each]
        args = [q for _, q, _ in some], np.array([len(m[1]) for m, _, _ in some]), [m[2] for m, _, _ in some], np.array([p for _, _, p in some])
        for j, e in tree.matches(*args, len(items), percent):
            (a, _, ga), (b, _, gb) = some[j][0], members[e]
            ga, gb = find(ga), find(gb)
            if ga != gb:
                top[ga] = gb
                links.append((a, b))
    return links


def _linked(rows: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(src, dst) found in the shards of ``rows`` (shard, block, member, node, component).

    Texts travel to the shards and become sets there: they are smaller than their hashes.
    """
    kind = rows.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, queries, hashes, links, kind = None, [], [], WordHashes(), [], None

        def done() -> list[tuple]:
            if not members or len(members) + len(queries) < 2:
                return []
            return joined(members, queries, key[1] == 0, percent)

        for batch in batches:
            shard, block, member, node, component = (batch.column(i).to_pylist() for i in range(5))
            texts, kind = batch.column(5).cast(pa.binary()), batch.schema.field(3).type
            for i in range(batch.num_rows):
                if (shard[i], block[i]) != key:
                    links += done()
                    key, members, queries = (shard[i], block[i]), [], []
                (members if member[i] else queries).append((node[i], shingle_set(texts[i].as_py(), k, hashes), component[i]))
            if links:
                yield _edges(links, kind)
                links = []
        links += done()
        if links:
            yield _edges(links, kind)

    met = _of(docs, rows).select("shard", "block", "member", "node", "component", "text")
    return met.repartition("shard", "block").sortWithinPartitions("shard", "block").mapInArrow(run, f"src {kind}, dst {kind}")


def _edges(links: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], kind), pa.array([y for _, y in links], kind)], ["src", "dst"])


def _asked(members: DataFrame, own: DataFrame, routes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links that the shards of ``members`` (node, shard, component) return to the queries of ``routes`` (node, shard), and of those of ``own`` (node) among themselves."""
    blocks = routes.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    here = members.join(own, "node").select("shard", F.lit(0).alias("block"), F.lit(True).alias("member"), "node", "component")
    at = members.join(blocks, "shard")
    at = at.select("shard", F.explode(F.sequence(F.lit(1), F.col("blocks"))).alias("block"), F.lit(True).alias("member"), "node", "component")
    ask = routes.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int") + 1)
    ask = ask.join(members.select("node", "component"), "node").select("shard", "block", F.lit(False).alias("member"), "node", "component")
    rows = saved(here.unionByName(at).unionByName(ask))
    met = rows.groupBy("shard", "block").agg(F.count("*").alias("c")).filter("c > 1").select("shard", "block")
    return saved(_linked(saved(rows.join(met, ["shard", "block"])), docs, k, percent))


def _held(at: DataFrame, *more) -> DataFrame:
    """What each shard has of an item: its sets, the least and greatest sizes, and how much of a set there is from the item on at most."""
    return at.groupBy("item", F.col("shard").alias("to")).agg(F.count("*").alias("sets"), F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("rest"), *more)


def _routes(at: DataFrame, held: DataFrame, percent: int, also) -> DataFrame:
    """(node, shard) of the classes of ``at`` that may be similar to one that a shard holds.

    With one size m of the shard's, 1. the sizes fit, 2. what both have from their
    first common item on is enough, and 3. so is the number of common prefix items: where the first of the two prefixes
    ends, the set whose prefix it is lacks n - a items at most, a being the least overlap.
    """
    sizes = (100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n"))
    left = F.least(F.col("n") - F.col("place"), F.col("rest"))
    some = at.join(held, "item").filter(also & sizes)
    first = F.max((100 + percent) * left >= percent * (F.col("n") + F.col("least")))
    some = some.groupBy("node", "to").agg(first.alias("first"), F.count("*").alias("common"), F.first("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))

    def enough(m):
        return F.col("common") >= percent * (F.col("n") + m) / (100 + percent) - percent * F.greatest("n", m) / 100 - 1e-6

    # the bound falls on either side of the class's own size
    low, high = F.greatest("least", percent * F.col("n") / 100), F.least("most", 100 * F.col("n") / percent)
    return some.filter(F.col("first") & (enough(low) | enough(high))).select("node", F.col("to").alias("shard"))


def _shards(tokens: DataFrame) -> DataFrame:
    """node, n and shard of each class, by its size and the most frequent of its items (node, n, item, c)."""
    of = tokens.groupBy("node").agg(F.first("n").alias("n"), F.max(F.struct("c", "item"))["item"].alias("item"))
    of = of.withColumn("item", F.xxhash64("item", F.floor(F.log(F.col("n")) / math.log(BAND))))
    sizes = of.groupBy("item").agg(F.ceil(F.greatest(F.count("*") / SETS, F.sum("n") / ITEMS)).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(1), F.col("node")), F.col("parts"))
    return of.join(sizes, "item").select("node", "n", F.when(F.col("parts") <= 1, F.col("item")).otherwise(F.xxhash64("item", part)).alias("shard"))


def _of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the text of their node."""
    if isinstance(docs.schema["doc_id"].dataType, T.NumericType) and rows.count() <= BROADCAST_NODES:
        rows = F.broadcast(rows)  # else every text would be shuffled to find those that are asked for
    return docs.select(F.col("doc_id").alias("node"), "text").join(rows, "node")


def _tokens(classes: DataFrame, percent: int) -> DataFrame:
    """item, node, n, place and c: the prefix items that several classes (node, n, lows, items) have.

    The classes of several texts of one id are ordered together: items then stand
    further ahead than in one of them, so that none is lost.
    """
    spread = classes.select("node", F.col("n").cast("int").alias("n"), "lows", F.posexplode("items").alias("at", "item"))
    several = saved(spread.groupBy("item").agg(F.count("*").alias("c")).filter("c > 1"))
    met = spread.join(several, "item")
    high = F.col("at") >= F.col("lows")
    own = Window.partitionBy("node", high)
    # low items of one class only come first, then those of few; the others follow by hash
    rank = F.col("lows") - F.count("*").over(own) + F.dense_rank().over(own.orderBy("c", "item")) - 1
    met = met.withColumn("place", F.when(high, F.col("at")).otherwise(rank))
    kept = saved(met.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("item", "node", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place")))
    discard(several)
    # what several prefixes have
    shared = kept.groupBy("item").agg(F.count("*").alias("c")).filter("c > 1")
    out = saved(kept.join(shared, "item"))
    discard(kept)
    return out


def _components(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component) of the classes (node, n, lows, items) that have links."""
    tokens = _tokens(classes, percent)
    discard(classes)
    members = saved(_shards(tokens).withColumn("component", F.col("node")))
    at = saved(tokens.select("item", "node", "n", "place").join(members.select("node", "shard"), "node"))
    discard(tokens)

    held = saved(_held(at))
    first = held.groupBy("item").agg(F.min("to").alias("to"))
    routes = saved(_routes(at, held.join(first, ["item", "to"]), percent, F.col("to") < F.col("shard")))
    own = saved(_routes(at, held.filter("sets > 1"), percent, F.col("to") == F.col("shard")).select("node"))
    discard(held)
    links = _asked(members, own, routes, docs, k, percent)
    found = saved(components(links))

    now = found.withColumnRenamed("id", "node")
    members = saved(members.drop("component").join(now, "node", "left").withColumn("component", F.coalesce("component", "node")))
    at = at.join(members.select("node", "component"), "node")
    several = at.groupBy("item").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("shard").alias("s"), F.max("shard").alias("t"))
    rest = saved(at.join(several.filter("lo <> hi and s <> t").select("item"), "item"))
    held = _held(rest, F.min("component").alias("lo"), F.max("component").alias("hi"))
    apart = (F.col("lo") != F.col("component")) | (F.col("hi") != F.col("component"))
    more = _routes(rest, held, percent, (F.col("to") < F.col("shard")) & apart)
    more = saved(more.join(routes, ["node", "shard"], "left_anti"))
    if more.isEmpty():
        return found
    again = _asked(members, own.limit(0), more, docs, k, percent)
    return found if again.isEmpty() else saved(components(links.unionByName(again)))


def similar_sets(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents are linked if ``100 * intersection >= percent * union`` of
    their sets of ``k``-word shingles; component_id is the smallest doc_id
    reachable. Null, empty and wordless texts have empty sets and are linked with
    nothing. Rows that share a doc_id count as one document with the links of
    them all. A null id takes the smallest id it is linked with, or null. An empty table gives no rows.
    """
    with scratch() as keep:
        sets = saved(first_items(docs, k, percent))
        some = sets.filter("digest is not null").groupBy("digest")
        classes = saved(some.agg(F.min("doc_id").alias("node"), *[F.first(c).alias(n) for c, n in (("n_shingles", "n"), ("lows", "lows"), ("items", "items"))]).filter("node is not null"))
        ids, own = saved(sets.drop("lows", "items")), saved(classes.select("digest", "node"))
        discard(sets)
        found = _components(docs, classes, k, percent)
        own = own.join(found.withColumnRenamed("id", "node"), "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
        out = ids.join(own, "digest", "left")
        return keep(out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
r AS (SELECT doc_id, e.g, row_number() OVER (PARTITION BY doc_id ORDER BY c, e.g) AS k FROM e JOIN (SELECT g, count(*) AS c FROM e GROUP BY g) f ON e.g = f.g),
x AS (SELECT doc_id, r.g, n FROM r JOIN n USING (doc_id) WHERE 100 * (k - 1) <= 20 * n),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
i AS (SELECT a, b, count(*) AS inter FROM c JOIN e p ON p.doc_id = a JOIN e q ON q.doc_id = b AND q.g = p.g GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * inter >= 80 * (p.n + q.n - inter)),
sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(min(b), n.doc_id)) AS component_id
FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n
"""
