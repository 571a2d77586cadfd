"""Line dedup and MinHash groups against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tempora.llm import linededup, minhash
from tempora.llm.common import saved

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "so", "ti") for b in ("ba", "den", "fir", "gol", "hum", "jat")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def grouped(nodes, linked):
    """Smallest node reachable, by closing links one by one."""
    top = dict.fromkeys(nodes)
    for n in nodes:
        top[n] = n
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if top[b] < top[a] and linked(a, b):
                    top[a], changed = top[b], True
    return top


def varied(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


def normal(line):
    return re.sub(r"[^a-z0-9]+", " ", line.lower()).strip()


def limit(a, b):
    return int(0.2 * max(len(a), len(b)) + 1e-9)


@pytest.mark.parametrize("words", [6, 12, 30])
def test_lines_with_a_changed_word_are_found(spark, words):
    """Recall against edit similarity alone, and no line removed that brute force keeps."""
    rng = random.Random(words)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    texts = []
    for _ in range(150):
        line = [rng.choice(names) for _ in range(words)]
        other = list(line)
        other[rng.randrange(words)] = rng.choice(names)
        texts += [" ".join(line), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(docs).collect()}
    near = [i for i in range(1, len(texts), 2) if edits(texts[i - 1], texts[i]) <= limit(texts[i - 1], texts[i])]
    assert len(near) > 60 and sum(got[i] for i in near) >= 0.9 * len(near)
    assert not sum(n for i, n in got.items() if i not in near)


def test_mistyped_lines_are_found(spark):
    """One of 25 characters is another one; recall against edit similarity alone."""
    rng = random.Random(20)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = []
    for words in (12, 20, 30):
        for _ in range(60):
            line = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(words))
            texts += [line, "".join(rng.choice(letters) if c != " " and rng.random() < 0.04 else c for c in line)]
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    near = [i for i in range(1, len(texts), 2) if edits(texts[i - 1], texts[i]) <= limit(texts[i - 1], texts[i])]
    assert len(near) == 180 and sum(got[i] for i in near) >= 0.9 * len(near)
    assert not sum(n for i, n in got.items() if i not in near)


def test_first_of_each_group_stays(spark):
    texts = ["Page one of the long report about rivers\n--\nother words here that nobody has", "x\nPAGE ONE, of the long report about rivers!\n", "page two of the long report about rivers", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(docs).collect()}
    assert got == {0: (texts[0], 3, 0), 1: ("x\n", 3, 1), 2: ("", 1, 1), 3: (None, 0, 0), 4: ("", 1, 0)}


@pytest.mark.parametrize("small", [0, 8])
def test_near_groups_are_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    rng = random.Random(5 + small)
    bases = [[rng.choice(WORDS) for _ in range(rng.choice((1, 4, 40, 150)))] for _ in range(8)]
    rows = [(i, " ".join(varied(rng, rng.choice(bases), rng.choice((0, 1, 2, 4))))) for i in range(60)]

    def shingles(t):
        w = t.split()
        k = min(2, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = {i: shingles(t) for i, t in rows}
    top = grouped(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == {i: (len(s), top[i], top[i] == i) for i, s in sets.items()}


def test_simhash_has_the_bits_of_most_features(spark):
    for n in (5, 19, 40):
        words = [f"wor{i}d" for i in range(n)]
        docs = spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string")
        sims = {r.sim for r in linededup.signatures(docs).filter("kind >= 0 and kind < 99").collect()}
        hashes = [r[0] & (1 << 64) - 1 for r in docs.select(F.explode(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)))).collect()]
        want = sum(1 << b for b in range(linededup.BITS) if 2 * sum(h >> b & 1 for h in hashes) > n)
        assert want in sims


def test_edit_similarity_is_exact_for_candidates(spark):
    rng = random.Random(11)
    pairs = []
    for n in (1, 3, 8, 20, 40, 90):
        for _ in range(25):
            a = [rng.choice(WORDS) for _ in range(n)]
            b = varied(rng, a, rng.choice((0, 1, n // 8, n // 4)))
            b = b[: rng.randrange(len(b) + 1)] + b[rng.randrange(len(b)) :] if rng.random() < 0.3 else b
            pairs.append((" ".join(a), " ".join(b)))
    texts = list(dict.fromkeys(t for p in pairs for t in p))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    at = {t: i for i, t in enumerate(texts)}
    # lengths are compared before
    want = {(at[a], at[b]): edits(a, b) <= limit(a, b) for a, b in pairs if a != b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b))}
    nodes = docs.select(F.col("doc_id").alias("h"), F.xxhash64("doc_id", "text").alias("row"), F.lit(0).alias("line"))
    got = {tuple(r) for r in linededup._confirmed(docs, spark.createDataFrame(list(want), "src long, dst long"), nodes, 0.8).collect()}
    assert got == {p for p, near in want.items() if near}


def test_pairs_are_compared_in_parts(spark, monkeypatch):
    """The texts of all pairs are not in one shuffle, and every pair is compared once."""
    monkeypatch.setattr(linededup, "PAIRS_AT_ONCE", 10)
    monkeypatch.setattr(linededup, "PAIRS_A_TEXT", 0)
    rng, parts, compared = random.Random(4), [], linededup._compared
    texts = [" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [t + " x" for t in texts])], "doc_id long, text string")
    nodes = docs.select(F.col("doc_id").alias("h"), F.xxhash64("doc_id", "text").alias("row"), F.lit(0).alias("line"))
    pairs = spark.createDataFrame([(i, i + 12) for i in range(12)] + [(i, i + 13) for i in range(11)], "src long, dst long")
    monkeypatch.setattr(linededup, "_compared", lambda some, *rest: parts.append({tuple(r) for r in some.collect()}) or compared(some, *rest))
    assert sorted(map(tuple, linededup._confirmed(docs, pairs, nodes, 0.8).collect())) == [(i, i + 12) for i in range(12)]
    assert len(parts) == 3 and sum(map(len, parts)) == len(set.union(*parts)) == 23


def test_large_buckets_are_not_cut(spark):
    """200 nodes have two equal representatives, and others of their own."""
    m = [f"cast({'7' if i < 2 else f'1000 * id + {i}'} as bigint) m{i}" for i in range(14)]
    nodes = spark.range(1, 201).selectExpr("id h", "40 n", "0 kind", "1L step", "xxhash64(id) sim", "id row", "0 line", *m)
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string")
    sizes = [r["count"] for r in linededup._buckets(docs, nodes).groupBy("key").count().collect()]
    assert max(sizes, default=0) == 200


def test_near_lines_of_a_large_bucket_meet_in_later_rounds(spark, monkeypatch):
    monkeypatch.setattr(linededup, "CHOSEN", 2, raising=False)
    monkeypatch.setattr(linededup, "GROWTH", 2, raising=False)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = []
    for i in range(90):
        words = [word(rng.randint(3, 5)) for _ in range(12)] + ["internationalisation", "characteristically"]
        texts.append(" ".join(words))
        if i % 3 == 0:
            texts.append(" ".join([w[:-1] + "0" if k % 4 == 1 else w for k, w in enumerate(words[:-2])] + words[-2:]))
    near = [i for i in range(1, len(texts)) if edits(texts[i - 1], texts[i]) <= limit(texts[i - 1], texts[i])]
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = {i for i, n in got.items() if n}
    assert len(near) == 30 and found <= set(near) and len(found) >= 27


def test_unlike_lines_with_a_common_phrase_are_not_all_compared(spark, monkeypatch):
    """150 lines have three long words in a row in common and nothing else, and one has a mistyped copy."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrase = ["internationalisation", "characteristically", "misunderstandings"]
    texts = [" ".join([*(word(rng.randint(3, 5)) for _ in range(24)), *phrase, *(word(4) for _ in range(6))]) for _ in range(150)]
    texts.append(texts[77][:40] + "q" + texts[77][41:])
    compared, confirmed = [], linededup._confirmed
    monkeypatch.setattr(linededup, "_confirmed", lambda docs, pairs, *rest: compared.append(pairs.count()) or confirmed(docs, pairs, *rest))
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i for i, n in got.items() if n} == {150} and sum(compared) <= 10


def test_long_unlike_lines_with_a_phrase_in_one_place_are_not_all_compared(spark, monkeypatch):
    """150 lines have nine words in common in the same place; mistyped copies of ten of them are found."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda _: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    phrase = [word(0) for _ in range(9)]
    texts = [" ".join([*map(word, range(28)), *phrase, *map(word, range(28))]) for _ in range(150)]
    texts += ["".join(rng.choice(letters) if c != " " and rng.random() < 0.04 else c for c in t) for t in texts[:10]]
    compared, confirmed = [], linededup._confirmed
    monkeypatch.setattr(linededup, "_confirmed", lambda docs, pairs, *rest: compared.append(pairs.count()) or confirmed(docs, pairs, *rest))
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = {i for i, n in got.items() if n}
    assert found <= set(range(150, 160)) and len(found) >= 9 and sum(compared) <= 40


def test_lines_that_share_two_representatives_are_compared(spark):
    """15 of 18 words have another letter, so 2 of 14 pairs of words agree; the edit similarity is 0.88."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    same = [word(16) for _ in range(3)]
    short = [word(4) for _ in range(15)]
    texts = [" ".join(short[:8] + same + short[8:]), " ".join([w[:2] + "7" + w[3:] for w in short[:8]] + same + [w[:1] + "7" + w[2:] for w in short[8:]])]
    assert edits(*texts) == 15 <= limit(*texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in linededup.dedup_lines(docs).collect()} == {0: 0, 1: 1}


def test_numbers_of_letters_drop_no_similar_line(spark):
    rng = random.Random(9)
    pairs = []
    for n in (20, 60, 150):
        for k in range(40):
            a = "".join(rng.choice("aaeenntiors hludc") for _ in range(n))
            b = list(a)
            for i in rng.sample(range(n), n // 5 if k % 2 else n // 3):
                b[i] = rng.choice(["", "e", "q", b[i] + "e"])
            pairs.append((a, "".join(b)))
    rows = spark.createDataFrame(pairs, "x string, y string")
    cols = [c.alias(f"{c_name}{end}") for end in ("x", "y") for c_name, c in zip(linededup.LETTERS, linededup._letters(F.col(end)), strict=True)]
    longer = F.greatest(F.char_length("x"), F.char_length("y"))
    kept = {(r.x, r.y) for r in rows.select("x", "y", *cols).filter(linededup._possible("x", "y", longer, 0.8)).collect()}
    near = {p for p in pairs if edits(*p) <= limit(*p)}
    assert len(near) >= 60 and near <= kept and len(kept) < len(pairs)
