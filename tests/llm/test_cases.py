"""Small cases of the text operators: nulls, empty tables, ties, long texts, extra columns, and brute force."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import decontam, htmltext, langid, linededup, minhash, mixing, quality, spotsigs, suffixdedup, toxicity

COLS = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "the cat sat on the mat while the old dog slept near the warm fire and dreamt of the green fields beyond the river"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [TEXT, TEXT, None, "", " \n ", TEXT + " at last", "x", "Ein Hund und eine Katze sind nicht hier", "word " * 30_000, TEXT.upper()]
    rows = [(i, t, "de" if i == 7 else "en", None if i == 3 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, TEXT, None, None, 1), rows[0]], COLS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(10)], "doc_id long, quality int, toxic int")


def test_every_operator_takes_odd_rows(spark, docs, labels):
    n = docs.count()
    clash = docs.withColumns({c: F.lit(1) for c in ("spans", "tail", "score", "taken", "kept", "n_removed", "lang_pred")})
    bench = spark.createDataFrame([("a", TEXT), (None, TEXT), ("b", None), ("c", "")], "item_id string, text string")
    assert decontam.find_windows(clash, bench).count() == n
    assert mixing.plan_mix(clash).count() == n
    assert linededup.dedup_lines(clash).count() == n
    assert minhash.near_duplicates(clash).count() == n
    assert suffixdedup.cut_repeats(clash).count() == n
    assert spotsigs.compared(clash).count() == n
    assert langid.identify(clash, langid.fit(clash)).count() == n
    assert toxicity.score(clash, toxicity.fit(clash, labels)).count() == n
    assert quality.score(clash, quality.fit(clash, labels), 1.0).count() == n


def test_empty_tables(spark, docs, labels):
    none, no_labels = docs.limit(0), labels.limit(0)
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontam.find_windows(docs, bench).agg(F.sum("n_hit")).first()[0] == 0
    for out in (mixing.plan_mix(none), linededup.dedup_lines(none), minhash.near_duplicates(none), suffixdedup.cut_repeats(none), spotsigs.compared(none), langid.identify(none, langid.fit(none))):
        assert out.count() == 0
    assert quality.score(docs, quality.fit(docs, no_labels), 1.0).count() == docs.count()
    assert toxicity.score(docs, toxicity.fit(docs, no_labels)).count() == docs.count()


def brute_cut(texts, length):
    seen, out = set(), []
    for t in texts:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            gone[i : i + length] |= w in seen
            seen.add(w)
        out.append(bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("length,gram", [(20, 6), (20, 12)])
def test_cut_repeats_is_brute_force(spark, length, gram):
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("abé "), 120)) for _ in range(4)]
    texts = [base[0], base[1][:60] + base[0][30:90], base[2] + base[2], "ab" * 40, base[3] + "ab" * 15, base[0], "a" * 19]
    out = suffixdedup.cut_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length, gram)
    assert [bytes(r.kept) for r in out.orderBy("doc_id").collect()] == brute_cut(texts, length)


def test_spotsigs_neighbours_and_classes(spark):
    texts = {5: TEXT, 3: TEXT + " now", 9: "nothing here resembles anything", 1: ""}
    out = {r.doc_id: r for r in spotsigs.compared(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    order = sorted(texts, reverse=True)
    for d, nxt in zip(order, order[1:] + order[:1], strict=True):
        t = texts[d]
        cut = len(t) // 3
        assert out[d].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + texts[nxt][:cut]).encode()).hexdigest()
    assert out[5].near_next > 0.5 > out[9].near_next
    got = {r.doc_id: r.class_id for r in spotsigs.near_duplicates(spark.createDataFrame([(1, TEXT), (2, TEXT), (3, "quite another thing altogether")], "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_main_text():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>Four</p>'
        '<div class="comments"><p>Nice!</p></div><form>x</form></article><aside>side</aside><footer>&copy; me</footer><script>var t="</p>";</script></body></html>'
    )
    assert htmltext.main_text(page) == "A & B One two three Four"
    assert htmltext.main_text(None) == "" and htmltext.main_text("plain  text") == "plain text"


def test_style_tree_drops_what_all_pages_share(spark):
    rows = [(i, "http://h.example/x", f"<body><div class='top'><p>Same words on all pages</p></div><div class='text'><p>Story number {i} is long</p></div></body>") for i in range(30)]
    out = htmltext.extract_text(spark.createDataFrame([*rows, (99, None, None)], "page_id long, url string, html string"))
    got = {r.page_id: r.text for r in out.collect()}
    assert got[99] == "" and all(got[i] == f"Story number {i} is long" for i in range(30))


def test_isotonic_is_monotone():
    x, p = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert list(p) == sorted(p) and p[0] == 0 and p[-1] == 1 and list(x) == sorted(x)


def test_missing_letters_are_unknown(spark):
    rows = spark.createDataFrame([(i, "12 34 !!" if i == 0 else TEXT, "en") for i in range(20)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(rows, langid.fit(rows)).collect()}
    assert got[0] == ("und", 0.0) and got[1][0] == "en"


def test_reads_come_in_order_of_position(spark, tmp_path):
    rows = [(i, "w " * (1 + i * 7 % 11), f"s{i % 3}") for i in range(400)] + [(400, "", "s0"), (401, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    plan = {r.doc_id: r for r in mixing.plan_mix(docs).collect()}
    reads = sorted((c.position, i, c.copy, c.words) for i, r in plan.items() for c in r.copies)
    assert len(reads) > len(plan)

    stream = corpus_pipeline.mix(spark, docs, "").collect()
    assert [(r.position, r.doc_id, r.copy, r.words) for r in stream if r.copy is not None] == reads
    unread = sorted(i for i, r in plan.items() if not r.copies)
    assert unread and [r.doc_id for r in stream[len(reads) :]] == unread

    out = mixing.query(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in out] == [i for _, i, copy, _ in reads if copy == 0] + unread
    assert all(r.taken == plan[r.doc_id].taken == sum(c.words for c in plan[r.doc_id].copies) for r in out)


def test_content_is_not_judged_by_words_of_its_names():
    assert htmltext.main_text('<article><h2 id="social-impact">Impact</h2><p>One</p><table class="share prices"><tr><td>7</td></tr></table></article>') == "Impact One 7"
    assert htmltext.main_text("<main><h1>Title</h1><p>Lead</p><article><p>Text of the article</p></article></main>") == "Title Lead Text of the article"
    post = "A long post that stands in no article at all and is the page's text"
    assert htmltext.main_text(f"<div class='post'><p>{post}</p></div><article><p>Other story</p></article>") == f"{post} Other story"
    assert htmltext.main_text('<div class="comment-list"><p>Nice</p></div><ul class="nav"><li>Home</ul><article><p>One</p></article>') == "One"


def test_pages_with_text_do_not_end_empty():
    text = "An essay about rivers and the sea, and what lies between"
    p = f"<p>{text}</p>"
    for page in (f'<form id="aspnetForm"><div class="content">{p}</div></form>', f'<div class="social body">{p}</div>', f'<div id="main-content" class="related content">{p}</div>', f'<section class="cookies">{p}</section>'):
        assert htmltext.main_text(f"<body><nav>Menu</nav>{page}<footer>Foot</footer></body>") == text
    assert htmltext.main_text("<nav>Menu</nav><script>x</script>") == ""
    assert htmltext.main_text(f"<body><h1>Title of the post</h1><div><p>The lead</p></div><article>{p}</article><div>More stories</div></body>") == f"Title of the post The lead {text}"
    for name in ("ad-slot-300x250", "user-comments-v2", "cc-window", "site-nav-primary", "footer-copyright"):
        assert htmltext.main_text(f'<div class="{name}">Not this</div><div class="text">{p}</div>') == text


def test_broken_and_deep_pages_take_linear_time():
    start = time.perf_counter()
    assert htmltext.main_text("<a " * 350_000 + "x") != ""
    assert htmltext.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert htmltext.main_text("<i>x<hr>" * 20_000).count("x") == 20_000
    assert htmltext.main_text("<i></em>" * 20_000 + "y") == "y"
    assert time.perf_counter() - start < 5


def test_small_sites_lose_what_their_pages_share(spark):
    def got(n):
        rows = [(i, "http://h.example/x", f"<body><div class='x'><p>Same words on all pages</p></div><div class='y'><p>Story number {i} is long</p></div></body>") for i in range(n)]
        out = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
        return {r.page_id: (r.text, r.n_chars) for r in out.collect()}

    assert got(2)[0][0] == "Same words on all pages Story number 0 is long"
    assert got(5) == {i: (f"Story number {i} is long", 22) for i in range(5)}


def test_html_of_empty_and_clashing_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.extract_text(none).count() == 0
    one = spark.createDataFrame([(1, None, "<p>a&amp;b", "old", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in htmltext.extract_text(one).collect()] == [(1, None, "a&b", 3)]


def test_importance_is_brute_force(spark):
    rng = np.random.default_rng(4)
    pages = []
    for i in range(12):
        words = ["menu one", f"story {i}", ["red", "blue"][int(rng.integers(2))], "note" if i < 6 else f"note {i}"]
        pages.append((i, "http://s.example/", "<body>" + "".join(f"<div class='c{k}'>{w}</div>" for k, w in enumerate(words)) + "</body>"))
    low = {r.place for r in htmltext.unimportant_places(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    places = {}
    for _, _, page in pages:
        for _, p, s in htmltext.blocks(page)[0]:
            places.setdefault(p, []).append(s)
    want = set()
    for p, texts in places.items():
        counts = [texts.count(t) for t in set(texts)]
        importance = htmltext.CONTENT_SHARE * max(0.0, 1 - np.log(counts).mean() / np.log(len(texts)))  # one presentation each
        sure = (len(texts) - 1) / len(texts)
        if 1 - sure * (1 - importance) <= htmltext.LEAST_IMPORTANCE:
            want.add(p)
    assert low == want and 0 < len(want) < len(places)


def test_long_words_are_counted_whole():
    codes = toxicity.WordCodes({})
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    x = toxicity.features("a" * 100 + "B" * 300 + "!" * 50, codes)
    assert x[at["exclaim_rate"]] == 50 and x[at["capital_rate"]] == 0.75


def test_many_classes_are_all_sampled(spark):
    from tempora.llm.samples import bounded_sample

    rows = spark.range(3000).selectExpr("id as doc_id", "id % 300 as y")
    some, weight = bounded_sample(rows, "y", 5, total=600)
    got = {r.y: r["count"] for r in some.groupBy("y").count().collect()}
    assert len(weight) == 300 and set(weight.values()) == {5.0} and 300 < sum(got.values()) < 900
    with pytest.raises(ValueError):
        bounded_sample(rows, "y", 5, total=100)


def test_grades_in_order(spark):
    words = ["dull", "plain", "good", "great"]
    rows = [(i, " ".join(words[min(3, max(0, i % 4 + d))] for d in (0, 0, 0, 1, -1) for _ in range(3)), i % 4) for i in range(400)]
    docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(a, c) for a, _, c in rows], "doc_id long, quality int"))
    assert model.grades == [0, 1, 2, 3] and list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r.expected_grade for r in quality.score(docs, model, 2.0).collect()}
    mean = [np.mean([got[i] for i in range(g, 400, 4)]) for g in range(4)]
    assert mean == sorted(mean) and all(abs(m - g) < 0.6 for g, m in enumerate(mean))


def test_plain_words_have_the_codes_of_all_words(monkeypatch):
    words = "you idiots. Idiots idioots idiooots you, .you a z.,. it's café 1d10t x".split() + ["a" * 63, "ab" * 40]
    quick = {w: toxicity.WordCodes({"idiots": 1.5, "idio-": 1.0})[w] for w in words}
    monkeypatch.setattr(toxicity, "PLAIN", False)
    assert quick == {w: toxicity.WordCodes({"idiots": 1.5, "idio-": 1.0})[w] for w in words}
