"""SpotSigs document fingerprints, with DataFrame functions only.

A spot signature is an anchor, which is a common word, and the chain of the two
content words that follow it. Common words are the short ones (three letters at
most) and some longer ones; the start of a text is an anchor too, and in a text
without common words every word is one. The fingerprint of a text is the set
of its signatures' hashes, of which the string shows the sorted smallest and a
digest of all; its likeness to another one is the exact Jaccard of the whole sets.
Near duplicates among all texts are found by set length: only sets of about the
same length can be alike, and they must share a rare signature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table
from .graph import components

#: Hashes that a fingerprint shows, and hex digits of each.
SIZE, DIGITS = 64, 16
#: Content words of a chain.
CHAIN = 2
#: Longer common words of English, French, German and Spanish (fixed values).
COMMON = (
    "that this with from have which were their there been would they will what when your some them then than into only also "
    "dans pour avec mais plus cette sont nous vous elle leur comme tout être "
    "nicht eine einen einer sich auch wird oder noch über nach wenn sind dass dieser "
    "para como pero más esta este todo también entre cuando hasta desde sobre"
).split()
#: Ranges of document ids that neighbours are looked for in, of about equal numbers of rows: at least, at most, and rows that each should have.
LEAST_RANGES, MOST_RANGES, RANGE_ROWS = 800, 40_000, 5000


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, whatever later expressions refer to it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the sorted distinct hashes of the spot signatures of ``text`` (null and wordless: none)."""
    common = lambda w: (F.char_length(w) <= 3) | w.isin(COMMON)
    df = held(df, "_w", F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1), ""))
    some = F.exists("_w", common)
    anchor = lambda i: F.when(i == 0, "^").otherwise(F.get("_w", i - 1))
    content = F.filter(
        F.transform("_w", lambda w, i: F.struct(anchor(i).alias("a"), w.alias("w"))),
        lambda s: ~common(s["w"]),
    )
    df = held(held(df, "_some", some), "_c", content)
    # a text of common words only is one chain
    df = held(df, "_k", F.when((F.size("_c") == 0) & (F.size("_w") > 0), F.array(F.struct(F.lit("^").alias("a"), F.array_join("_w", " ").alias("w")))).otherwise(F.col("_c")))
    chain = lambda s, i: F.when(
        (s["a"] == "^") | ~F.col("_some") | common(s["a"]),
        F.substring(F.md5(F.concat_ws(" ", s["a"], s["w"], F.get("_k", i + 1)["w"]).cast("binary")), 1, DIGITS),
    )
    sigs = F.sort_array(F.array_distinct(F.array_compact(F.transform("_k", chain))))
    return df.withColumn(name, sigs).drop("_w", "_some", "_c", "_k")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard of two sets, 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))).cast("double")


def shown(sigs: Column, size: int = SIZE) -> Column:
    """The fingerprint: the ``size`` smallest hashes in order and, of a larger set, a digest of all."""
    rest = F.when(F.size(sigs) > size, F.concat(F.lit("+"), F.md5(F.array_join(sigs, "").cast("binary")))).otherwise("")
    return F.concat(F.array_join(F.slice(sigs, 1, size), ""), rest)


def ranged(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_range``, and with copies (``_halo`` = 1) of the first rows of each range in the range above it.

    Ranges of ids are cut by approximate quantiles; null ids are in the lowest. By
    descending doc_id, what follows the last row of a range is the first of the
    range below it, or of the highest after the lowest: its copy is at hand.
    """
    ids = docs.select(F.col("doc_id").cast("double").alias("i")).filter("i is not null")
    n = min(MOST_RANGES, max(LEAST_RANGES, ids.count() // RANGE_ROWS))
    bounds = sorted(set(ids.approxQuantile("i", [k / n for k in range(1, n)], 0.2 / n)))
    # two steps: the block of bounds, then the bound in it
    step = max(1, math.isqrt(len(bounds)))
    ident = F.col("doc_id").cast("double")
    below = lambda a: F.size(F.filter(a, lambda b: b < ident))
    blocks = below(F.lit(bounds[::step]).cast("array<double>"))
    above = F.greatest(F.lit(0), blocks - 1) * step + below(F.slice(F.lit(bounds).cast("array<double>"), F.greatest(F.lit(0), blocks - 1) * step + 1, F.lit(step)))
    rows = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(above)).withColumn("_halo", F.lit(0))
    tops = sorted((r._range, r.top) for r in rows.groupBy("_range").agg(F.max("doc_id").alias("top")).collect())
    if not tops:
        return rows
    pairs = [(tops[i - 1][1], tops[i][0]) for i in range(len(tops))]
    to = F.broadcast(docs.sparkSession.createDataFrame(pairs, f"_top {docs.schema['doc_id'].dataType.simpleString()}, _to int"))
    halo = rows.join(to, F.col("doc_id").eqNullSafe(F.col("_top"))).withColumn("_range", F.col("_to")).withColumn("_halo", F.lit(1))
    return rows.unionByName(halo.drop("_top", "_to"))


def compared(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    ``docs`` has doc_id and text; other columns are left out. Null text is empty. A
    text without words has no signatures and is alike only to another such text.
    Repeated rows stand next to each other. An empty table gives no rows.
    """
    # texts are brought side by side first: their signatures would take more room in the shuffle
    rows = ranged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("_range").orderBy("_halo", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    near = rows.withColumn("next", F.lead("text").over(order)).filter("_halo = 0")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))
    near = near.select("doc_id", n.cast("long").alias("n_chars"), "text", "next", edited.alias("edited"))
    for text, name in (("text", "sigs"), ("next", "next_sigs"), ("edited", "edited_sigs")):
        near = with_signatures(near, text, name)
    return near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("sigs"), size).alias("fingerprint"), shown(F.col("edited_sigs"), size).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id and ``class_id``, the smallest doc_id reachable by pairs whose signature sets reach ``percent`` per cent of Jaccard.

    Equal sets are one node. Sets are ordered by the rarity of their signatures;
    alike sets share one of the first ``n - ceil(t n) + 1``, and their lengths differ
    by a factor of t at most, so sets meet only in a (length class, signature) that
    both have, where a set takes its own class and the one above it.
    Texts without signatures are in no class but their own.
    """
    t = percent / 100
    sets = with_signatures(docs.select("doc_id", "text"), "text", "sigs").select("doc_id", "sigs", F.md5(F.array_join("sigs", "").cast("binary")).alias("digest"))
    sets = saved(sets.withColumn("digest", F.when(F.size("sigs") > 0, F.col("digest"))))
    nodes = saved(sets.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("sigs").alias("sigs")).filter("node is not null"))
    each = nodes.select("node", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("times")).filter("times > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("times", "sig"))
    # signatures of one set only can't be shared; they come first in its order and count as places
    alone = F.col("n") - F.count("*").over(Window.partitionBy("node"))
    prefix = each.join(often, "sig").withColumn("place", rank + alone).filter(F.col("place") <= F.col("n") - F.ceil(F.lit(t) * F.col("n")) + 1)
    length = F.floor(F.log("n") / F.lit(-1.0) / F.log(F.lit(t))).cast("int")
    own = prefix.select("node", "n", "sig", "place", length.alias("cls"))
    up = own.withColumn("cls", F.explode(F.array(F.col("cls"), F.col("cls") + 1)))
    a, b = own.alias("a"), up.alias("b")
    fit = (F.col("a.node") != F.col("b.node")) & (F.col("b.n") >= t * F.col("a.n")) & (F.col("a.n") >= t * F.col("b.n"))
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.cls") == F.col("b.cls")) & fit)
    pairs = saved(pairs.select(F.greatest("a.node", "b.node").alias("src"), F.least("a.node", "b.node").alias("dst")).distinct())
    x, y = nodes.select(F.col("node").alias("src"), F.col("sigs").alias("x")), nodes.select(F.col("node").alias("dst"), F.col("sigs").alias("y"))
    both = pairs.join(x, "src").join(y, "dst").withColumn("inter", F.size(F.array_intersect("x", "y")).cast("long"))
    links = both.filter(100 * F.col("inter") >= percent * (F.size("x") + F.size("y") - F.col("inter"))).select("src", "dst")
    comp = components(links).withColumnRenamed("id", "node")
    of = nodes.select("digest", "node").join(comp, "node", "left").select("digest", F.coalesce("component", "node").alias("class_id"))
    return sets.select("doc_id", "digest").join(of, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents").select("doc_id", "text"))


_COMMON = ", ".join(f"'{w}'" for w in COMMON)
_SIGS = f"""
  SELECT *, coalesce(list_sort(list_distinct(list_filter(
           list_transform(range(1, len(k) + 1), lambda i: CASE WHEN k[i].a = '^' OR NOT any_common OR len(k[i].a) <= 3 OR k[i].a IN ({_COMMON})
             THEN substr(md5(k[i].a || ' ' || k[i].w || coalesce(' ' || k[i + 1].w, '')), 1, {DIGITS}) END), lambda x: x IS NOT NULL))), []) AS sigs
  FROM (SELECT *, CASE WHEN len(c) = 0 AND len(w) > 0 THEN [{{'a': '^', 'w': array_to_string(w, ' ')}}] ELSE c END AS k
  FROM (SELECT *, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'a': CASE WHEN i = 1 THEN '^' ELSE w[i - 1] END, 'w': w[i]}}),
                              lambda s: NOT (len(s.w) <= 3 OR s.w IN ({_COMMON}))) AS c,
        len(list_filter(w, lambda x: len(x) <= 3 OR x IN ({_COMMON}))) > 0 AS any_common
  FROM (SELECT *, regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}]+') AS w FROM"""
_SHOWN = f"array_to_string(list_slice({{0}}, 1, {SIZE}), '') || CASE WHEN len({{0}}) > {SIZE} THEN '+' || md5(array_to_string({{0}}, '')) ELSE '' END"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
n AS (SELECT doc_id, txt, coalesce(lead(txt) OVER o, first_value(txt) OVER o) AS nxt, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS nid FROM d WINDOW o AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(txt, length(txt) - length(txt) // 3) || left(nxt, length(txt) // 3) AS edited FROM n),
f AS ({_SIGS} d)))),
g AS ({_SIGS} (SELECT doc_id, edited AS txt FROM e))))),
s AS (SELECT e.doc_id, length(e.txt) AS n_chars, e.edited, f.sigs AS a, g.sigs AS b, x.sigs AS c
      FROM e JOIN f ON f.doc_id = e.doc_id JOIN g ON g.doc_id = e.doc_id JOIN f x ON x.doc_id = e.nid),
u AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM s)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {_SHOWN.format("a")} AS fingerprint, {_SHOWN.format("b")} AS edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE ab / (len(a) + len(b) - ab)::DOUBLE END AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE ac / (len(a) + len(c) - ac)::DOUBLE END AS near_next
FROM u
"""
