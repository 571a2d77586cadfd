"""The join over prefix trees against brute force."""

import random

import numpy as np
import pytest

from tempora.llm import triejoin
from tests.llm.test_brute_force import WORDS, grouped, varied


def similar(a, b, percent=80):
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def some_sets(rng, n):
    bases = [rng.sample(range(500), rng.choice((1, 2, 5, 30, 90))) for _ in range(6)]
    out = []
    for _ in range(n):
        s = set(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 3, 10))):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(500))
        out.append(s)
    return list({frozenset(s) for s in out})


@pytest.mark.parametrize("step,cells", [(1, 64), (4, 1 << 12), (32, 1 << 26)])
def test_tree_finds_all_pairs(monkeypatch, step, cells):
    monkeypatch.setattr(triejoin, "STEP", step)
    monkeypatch.setattr(triejoin, "CELLS", cells)
    rng = random.Random(step)
    for percent in (50, 80, 100):
        sets = some_sets(rng, 60)
        rows = [(i, np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15), i) for i, s in enumerate(sets)]
        rows = [(i, np.sort(s), g) for i, s, g in rows]
        for own, cut in ((True, len(rows)), (False, 25), (True, 25)):
            links = triejoin.joined(rows[:cut], rows[cut:], own, percent)
            asked = range(len(rows)) if own else range(cut, len(rows))
            want = grouped(range(len(rows)), lambda a, b: (a < cut and b in asked or b < cut and a in asked) and similar(sets[a], sets[b], percent))
            assert all(similar(sets[a], sets[b], percent) for a, b in links)
            have = {frozenset(x) for x in links}
            assert grouped(range(len(rows)), lambda a, b: frozenset((a, b)) in have) == want and len(links) <= len(rows)


def test_sets_of_one_component_are_not_asked_again():
    s = np.arange(10, dtype=np.uint64)
    assert triejoin.joined([(1, s, 7), (2, s[1:], 7)], [(3, s[:9], 7)], True, 80) == []
    assert triejoin.joined([(1, s, 7), (2, s[1:], 7)], [(3, s[:9], 3)], False, 80) in ([(3, 1)], [(3, 2)])


@pytest.mark.parametrize("size,low", [((1000, 1 << 21, 2000), (1 << 64) // 3), ((2, 50, 3), (1 << 64) - 1), ((1, 1, 1), 0)])
def test_groups_are_brute_force(spark, monkeypatch, size, low):
    """With small shards and blocks too, so that groups are salted and the second round is needed."""
    for name, v in zip(("SETS", "ITEMS", "QUERIES"), size, strict=True):
        monkeypatch.setattr(triejoin, name, v)
    monkeypatch.setattr(triejoin, "LOW", low)
    rng = random.Random(6)
    bases = [[rng.choice(WORDS) for _ in range(rng.choice((1, 3, 6, 40, 150)))] for _ in range(9)]
    passage = [rng.choice(WORDS) for _ in range(60)]
    bases += [passage + [rng.choice(WORDS) for _ in range(12)] for _ in range(6)]
    texts = [" ".join(varied(rng, rng.choice(bases), rng.choice((0, 0, 1, 1, 2)))) for _ in range(110)] + ["", None, " \n "]
    rows = [(i, t, 3) for i, t in enumerate(texts)]

    def shingles(t):
        w = (t or "").lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: shingles(t) for i, t, _ in rows}
    top = grouped(list(sets), lambda a, b: bool(sets[a]) and similar(sets[a], sets[b]))
    docs = spark.createDataFrame([*rows, rows[0], (None, texts[0].upper(), 3)], "doc_id long, text string, n int")
    got = triejoin.similar_sets(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: (len(s), top[i]) for i, s in sets.items()}
    assert len(got) == len(rows) + 2 and [r.component_id for r in got if r.doc_id is None] == [top[0]]
    assert len(set(top.values())) < 80


def test_ids_as_text_and_empty_tables(spark):
    line = " ".join(WORDS[:30])
    docs = spark.createDataFrame([("b", line), ("a", line + " end"), ("c", "x")], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in triejoin.similar_sets(docs).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert triejoin.similar_sets(docs.limit(0)).count() == 0
