"""Fill-in-the-middle and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import fillmiddle, periodic

ODD = ["", None, "one two", "a1b2  c\n\nd", "é𝒳𝒴ab𝒵", "𐀀𐀀", "x" * 5000, "no <P> mark", "1", " \t", "<S", "Z-z_" * 300, "日本語 text here", "\x00a\x7f"]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def middle_by_hand(i, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n, seed = len(units), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(seed[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, text
    if h[3] % 100 < 20:
        return n, "spm", mid, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", mid, f"<P>{pre}<S>{suf}<M>{mid}"


def test_middle_is_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD * 4)] + [(None, "no id", "x", 1), (0, "twice", "x", 1), (0, "twice", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    out = fillmiddle.fill_in_middle(docs).withColumn("back", fillmiddle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.middle, r.output) for r in out), key=repr)
    assert got == sorted(((i, *middle_by_hand(i, t)) for i, t, *_ in rows), key=repr)
    assert all(r.back == r.text for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}
    assert fillmiddle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("grammar", [r"[A-Za-z]+|[^A-Za-z]", r"[a-z]+|[0-9]+|[^a-z0-9]", r"[|]+|[^|]", r"[ab]|[^ab]+"])
def test_units_are_matches_of_the_grammar(spark, grammar):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcZ09|. \n𝒳é") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fillmiddle.units(F.col("t"), grammar).alias("u")).collect()
    assert all(r.u == re.findall(grammar, r.t) for r in out)


def test_grammars_that_are_none():
    for g in ("", "a+", "[a]+|b", "([a]+)"):
        with pytest.raises(ValueError):
            fillmiddle.boundary(g)


def runs_by_hand(w, least=12, exponent=2):
    n, out = len(w), []
    for s in range(n):
        for e in range(s + least, n + 1):
            size = e - s
            q = next(p for p in range(1, size + 1) if all(w[i] == w[i + p] for i in range(s, e - p)))
            if size >= exponent * q and not (s and w[s - 1] == w[s - 1 + q]) and not (e < n and w[e] == w[e - q]):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n = rng.randrange(0, 50)
    w = [f"w{rng.randrange(rng.choice((1, 2, 3, 9)))}" for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randrange(1, 12)
        w[a:] = [w[a + (i - a) % min(p, n - a)] for i in range(a, n)]
    return w


@pytest.mark.parametrize("work", [1, 200, 1 << 30])
def test_runs_are_brute_force(spark, work):
    """With little work a task, every text is dealt out by ranges of lags."""
    rng = random.Random(7)
    texts = [" ".join(some_words(rng)) for _ in range(60)] + [None, "", " \n", "a " * 40]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "b c " * 9, 5), (0, texts[0], 5)]
    out = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int"), work=work).collect()
    want = []
    for i, t, _ in rows:
        w = (t or "").split()
        runs = runs_by_hand(w)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        want.append((i, runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in out), key=repr) == sorted(want, key=repr)
    assert any(r for _, r, _ in want)


def test_other_lengths_and_exponents():
    rng = random.Random(9)
    for least, exponent in ((1, 2), (5, 3), (20, 2)):
        for _ in range(60):
            w = some_words(rng)
            got = periodic.scan(periodic.word_ids(w), 1, len(w), least, exponent) if w else []
            assert sorted(got, key=lambda r: (r[0], r[2])) == runs_by_hand(w, least, exponent)


def test_long_texts_of_one_word():
    ids = np.zeros(20_000, np.int32)
    assert periodic.scan(ids, 1, len(ids)) == [(0, 20_000, 1)]


def test_planted_tails(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(0, 80)))) for i in range(300)] + [(None, "a  b")]
    got = {r.doc_id: r.text for r in periodic.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    changed = 0
    for i, t in rows:
        w, h = t.split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, changed = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)], changed + 1
        assert got[i].split() == w
    assert changed > 10


def test_digests_of_ties(spark):
    rows = [(1, " ".join(["a"] * 12 + ["b"] + ["c"] * 12)), (2, "x")]
    got = {r.doc_id: r for r in periodic.digests(periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert tuple(got[1])[1:6] == (2, 0, 12, 1, 12000) and got[1].runs_sha256 == sha("0,12,1\n13,12,1\n") and got[1].collapsed_sha256 == sha("a b c")
    assert tuple(got[2])[1:6] == (0, None, None, None, None) and got[2].runs_sha256 == sha("") and got[2].collapsed_sha256 == sha("x")
