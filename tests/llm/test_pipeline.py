"""Each stage of the pipeline against brute force on a small table with nulls, copies, repeated rows and benchmark passages."""

import random

import pytest

import corpus_pipeline as cp
from tempora.llm import quality

COLS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(cp.STAGES)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(8)
    bench = [sentence(rng, 20) for _ in range(3)]
    shared = sentence(rng, 12)
    texts = [sentence(rng, 60) + "\n" + sentence(rng, 30) for _ in range(24)]
    texts[3] = texts[2]  # an exact copy
    texts[5] = texts[4] + " more words"  # a near copy
    texts[7] = " ".join([sentence(rng, 5), bench[0], sentence(rng, 5)])
    texts[8] = sentence(rng, 400) + " " + bench[1]  # less than a twentieth of it
    texts[9] += "\n" + shared
    texts[10] += "\n" + shared.upper() + "!"
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [(30, None, None, None, None), (31, "", "en", "a", 0), rows[12]]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(str(i), b) for i, b in enumerate(bench)], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return spark.createDataFrame(rows, COLS), rows, sf


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mix"]


def test_quality_keeps_what_the_model_accepts(spark, made):
    docs, rows, sf = made
    out = STAGES["quality"](spark, docs, sf)
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")), 1.0)
    want = sorted((tuple(r)[:5] for r in scored.collect() if r.tail >= 0.5), key=str)
    assert out.columns == docs.columns and rows_of(out) == want and 0 < len(want) < len(rows)


def test_repeated_lines_go(spark, made):
    docs, rows, sf = made
    out = STAGES["line_dedup"](spark, docs, sf)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert out.columns == docs.columns and sum(map(len, got.values())) == len(rows)
    seen, want = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        if text is None or i in want:
            want.setdefault(i, text)
            continue
        lines = text.split("\n")
        normal = [x.lower().rstrip("!") for x in lines]
        kept = [x for x, n in zip(lines, normal, strict=True) if not n or n not in seen and not any(n.startswith(s) and len(n) - len(s) < 0.2 * len(n) for s in seen if len(s) > 50)]
        seen |= set(normal) - {""}
        want[i] = "\n".join(kept)
    assert {i: t[0] for i, t in got.items()} == want
    assert want[3] == "" and want[10] == rows[10][1].split("\n")[0] + "\n" + rows[10][1].split("\n")[1]


def test_one_of_each_near_group_stays(spark, made):
    docs, rows, sf = made

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    gone, sets = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        s = shingles(t)
        if s and any(len(s & o) >= 0.8 * len(s | o) for k, o in sets.items() if k != i and o):
            gone.add(i)
        sets[i] = s
    out = STAGES["near_dedup"](spark, docs, sf)
    assert out.columns == docs.columns and rows_of(out) == sorted((r for r in rows if r[0] not in gone), key=str) and gone == {3, 5}


def test_copies_without_id_leave_one(spark):
    text = sentence(random.Random(3), 60)
    rows = [(None, text), (None, text), (None, text + " more"), (7, sentence(random.Random(4), 40)), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], COLS)
    got = [(r.doc_id, r.text) for r in STAGES["near_dedup"](spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([*rows[3:], next(g for g in got if g[1] in (text, text + " more"))], key=str)
    named = docs.unionByName(spark.createDataFrame([(9, text, "en", "a", None)], COLS))
    assert {r.doc_id for r in STAGES["near_dedup"](spark, named, "").collect() if r.text and r.text.startswith(text)} == {9}


def test_contaminated_documents_go(spark, made):
    docs, rows, sf = made
    out = STAGES["decontamination"](spark, docs, sf)
    assert out.columns == docs.columns and rows_of(out) == sorted((r for r in rows if r[0] != 7), key=str)


def test_the_mix_reads_near_its_targets_in_order(spark, made):
    docs, rows, sf = made
    out = STAGES["mix"](spark, docs, sf).collect()
    reads = [r for r in out if r.copy is not None]
    assert [r.position for r in reads] == sorted(r.position for r in reads) and {r.doc_id for r in out} == {r[0] for r in rows}
    for source in {r.source for r in out}:
        mine = [r for r in reads if r.source == source]
        size = sum(len((r[1] or "").split()) for r in rows if r[3] == source)
        assert {r.source_size for r in mine} == {size} and abs(sum(r.words for r in mine) - mine[0].target) <= 1
    assert abs(sum(r.words for r in reads) - sum(len((r[1] or "").split()) for r in rows)) <= 3


def test_stages_take_empty_tables(spark, made):
    docs, _, sf = made
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, docs.limit(0), sf).count() == 0
