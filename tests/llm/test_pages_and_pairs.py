from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from cartulary.llm import html_extract as H, jaccard_join as J

# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a = "</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><div id="cookie-notice">We use cookies</div>
<div class="layout"><{box}><h1>Title &amp; {n}</h1><p>First   <b>bold</b>{n}<br>second&#33;<p>Third
 line<div class="advert">Buy {n}</div><ul><li>item</ul><form>name <input></form><section class="comments"><p>nice {n}</section></{box}>
<aside>More</aside></div><footer>&copy; all {n}</footer></body></html>"""


def test_main_text():
    want = lambda n: f"Title & {n}\nFirst bold{n}\nsecond!\nThird line\nitem"
    for box in ("article", "main"):
        pages = [PAGE.format(box=box, n=k) for k in ("aa", "bb", "cc", "dd")]
        assert H.extract(pages) == [want(k) for k in ("aa", "bb", "cc", "dd")]
    assert H.extract([PAGE.format(box="article", n="z")]) == [want("z")]


def test_template_words_are_not_text():
    pages = [f"<div><p>Always the same words here</p><p>own {k} words of page {k * 7}</p></div>" for k in range(6)]
    assert H.extract(pages) == [f"own {k} words of page {k * 7}" for k in range(6)]


def test_classes():
    names = H.Names()
    pages = [H.Page(f"<html><body><h1>{k}</h1><ul>{'<li>x</li>' * (k + 1)}</ul></body></html>", names) for k in range(5)]
    tokens, classes = H.valid_classes(pages, 0.8, 3)
    found = {(names.tokens[t][0], *names.signs(names.tokens[t][1])) for t in tokens}
    assert {("</", "html", "body", "h1"), ("<", "html", "body", "ul", "li"), ("x", "html", "body", "ul", "li")} <= found
    inner = [c for c in classes if c.parent is not None]
    assert len(inner) == 1 and names.tokens[inner[0].parent.tokens[inner[0].gap]][0] == "<"


def _brute_classes(sequences, support, size):
    """Sets of tokens with equal counts in every page, in one order wherever they stand."""
    vectors = defaultdict(set)
    for t in {t for s in sequences for t in s}:
        v = tuple(s.count(t) for s in sequences)
        if sum(map(bool, v)) >= support * len(sequences):
            vectors[v].add(t)
    out = set()
    for v, tokens in vectors.items():
        if len(tokens) >= size:
            runs = [[t for t in s if t in tokens] for s in sequences]
            first = next(r for r in runs if r)[: len(tokens)]
            if all(r == first * (len(r) // len(first)) for r in runs):
                out.add(frozenset(tokens))
    return out


@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=14), min_size=2, max_size=5))
@settings(max_examples=300, deadline=None)
def test_classes_against_brute_force(words):
    names = H.Names()
    pages = [H.Page(" ".join(w), names) for w in words]
    _, classes = H.valid_classes(pages, 0.5, 2)
    brute = _brute_classes([p.tokens for p in pages], 0.5, 2)
    found = {frozenset(c.tokens) for c in classes}
    assert found <= brute and bool(found) == bool(brute)
    for c in classes:  # nested: no class crosses another
        for d in classes:
            assert c is d or d.gap_of(c) is not None or c.gap_of(d) is not None


def test_names_inside_an_article():
    page = """<body><div class="site-header">Site {n}</div><div class="share-bar share">Share {n}</div><article><h1 class="entry-header">Title {n}</h1><p class="share-price">price {n}</p>
<div class="form-guide">guide {n}</div><div class="comments-area">nice {n}</div><div class="social-share">tweet {n}</div><header>By {n}</header><footer>tags {n}</footer></article></body>"""
    for k in (1, 5):
        assert H.extract([page.format(n=n) for n in range(k)]) == [f"Title {n}\nprice {n}\nguide {n}\nBy {n}" for n in range(k)]


def test_the_template_decides(monkeypatch):
    """An element is the main one where the template has it, not where one page's text happens to have it; without classes other text comes out."""
    page = '<body><div class="x1">{a}</div><div class="content"><h2>Own {n}</h2><p>{w}</p><p class="zz">Printed on each page of the site</p></div></body>'
    odd = '<div class="content">quoted {n}</div>'
    pages = [page.format(a=odd.format(n=n) if n == 3 else f"top {n}", n=n, w=" ".join(f"w{n}x{k}" for k in range(30))) for n in range(12)]
    want = [f"Own {n}\n" + " ".join(f"w{n}x{k}" for k in range(30)) + "\nPrinted on each page of the site" for n in range(12)]
    assert H.extract(pages) == want
    # names that say nothing: only what the pages share tells the article from the rest
    soup = '<body><div class="q1"><a href="/">Start</a> <a href="/n">News of the day</a></div><div class="q2"><h1>Own {n}</h1><p>{w}</p></div><div class="q3"><p>All rights with the makers of this site</p><p>Made with care</p></div></body>'
    mute = [soup.format(n=n, w=" ".join(f"w{n}x{k}" for k in range(30))) for n in range(12)]
    own = [f"{n}\n" + " ".join(f"w{n}x{k}" for k in range(30)) for n in range(12)]
    assert [t.removeprefix("Own ") for t in H.extract(mute)] == own
    monkeypatch.setattr(H, "valid_classes", lambda *_: (set(), []))
    assert H.extract(pages)[3] != want[3]
    assert all("rights" in t or "News" in t for t in H.extract(mute))


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    def peak(depth):
        tracemalloc.start()
        H.extract(["<div>" * depth + "x" + "</div>" * depth])
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return size

    assert peak(8000) < 3 * peak(4000)


def test_broken_pages():
    assert H.extract(["", "<", "<p>a<!-- open", "<p>1 < 2 &lt; 3</p>", "<article>x<script>never closed"]) == ["", "<", "a", "1 < 2 < 3", "x"]


def test_page_edges(spark):
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/b", "<article><p>x</article>"), (3, "http://h/b", "<article><p>x</article>"), (None, "http://h/c", "<article>y</article>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in H.extract_pages(pages).collect()))
    assert got == [(0, "y", 1), (1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1)]
    assert H.extract_pages(pages.limit(0)).count() == 0


def test_groups_do_not_lose_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = {r.page_id: r.text for r in H.extract_pages(pages).collect()}
    few = {r.page_id: r.text for r in H.extract_pages(pages.repartition(5), group_pages=3).collect()}
    assert len(one) == pages.count() and one == few


# ---- pairs ----


def _brute(rows):
    """component by row, for (id, text) rows."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in lists[g] if j > i}:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return [(key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows)]


def _sorted(rows):
    return sorted(rows, key=repr)


def test_components_of_documents(spark, sf_dir, texts):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.op5_jaccard_join(spark, sf_dir).collect()]
    assert _sorted(got) == _sorted(_brute(list(texts.items())))


@pytest.mark.parametrize("cross", [0, 1000])
def test_near_copies_with_leaders(spark, monkeypatch, cross):
    """A large group of near copies and a passage that many texts share, with the leaders' rounds forced."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(copy)))
    for i in range(60, 110):
        rows.append((i, " ".join([rng.choice(words) for _ in range(rng.randint(2, 40))] + passage)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE  two"), (None, "one two"), (204, rows[3][1]), (204, rows[3][1])]
    monkeypatch.setattr(J, "CROSS_PER_ROW", cross)
    monkeypatch.setattr(J, "BLOCK_BYTES", 300)
    monkeypatch.setattr(J, "HUB", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()]
    want = [(k, n, c if n else k) for k, n, c in _brute(rows)]
    assert _sorted(got) == _sorted(want)


def test_pair_edges(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(odd_docs).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4)} <= got
    assert J.jaccard_components(no_docs).count() == 0


@given(st.lists(st.text(alphabet="aB \n\t\x0b\u00e9\u65e5", max_size=60), max_size=8), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_shingle_sets(texts, block):
    """Equal sets of word windows have equal hashes, others don't."""
    was, J.BLOCK_BYTES = J.BLOCK_BYTES, block
    try:
        got = [tuple(h.tolist()) for h in J.shingle_sets([t.encode() for t in texts])]
    finally:
        J.BLOCK_BYTES = was
    want = []
    for t in texts:
        w = t.encode().lower().split()
        want.append(frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(got[i]) & set(got[j])) == len(want[i] & want[j])


def test_long_words():
    a, b = "x" * 40 + "y", "x" * 40 + "z"
    one, two = J.shingle_sets([a.encode(), b.encode()])
    assert one.tolist() != two.tolist()


# ---- pipeline ----


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _good string, _t string, _text string, _whole string, _lang string, _m string, kept boolean, key string, c0 string, d string, digest string"


def _clashing(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6, True, *["x"] * 4) for r in rows], CLASH)


def test_stages_with_clashing_columns_nulls_and_repeats(spark, sf_dir):
    import corpus_pipeline

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").limit(40).collect()}
    rows = [(i, t, "en", "s", len(t)) for i, t in text.items()]
    rows += [(None, None, None, None, None), (7, "", "en", None, 0), *rows[:3], (None, rows[0][1], None, "s", None)]
    docs = _clashing(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.count() <= len(rows) and out.where("_good <> 'x' or c0 <> 'x'").count() == 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == len({r[0] for r in rows})


def test_one_of_each_group_stays(spark, sf_dir):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(7, words + " end", "a"), (7, " ".join(f"other{k}" for k in range(30)), "b"), (3, words, "c"), (3, words, "c"), (9, words.upper(), "d"), (None, words, "e"), (None, "one two", "f"), (4, None, "g"), (4, None, "g"), (5, " ", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(4)
    kept = sorted(r.tag for r in J.keep_one_each(spark, docs, sf_dir).collect())
    assert kept == ["b", "c", "f", "g", "g", "h"]


def test_near_duplicate_stage_against_brute_force(spark, sf_dir, texts):
    rows = list(texts.items())
    groups = {}
    for (i, _, c), (_, t) in zip(_brute(rows), rows, strict=True):
        if (t or "").split():
            groups.setdefault(c, []).append(i)
    want = sorted([min(g) for g in groups.values()] + [i for i, t in rows if not (t or "").split()])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = J.keep_one_each(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == want
    assert got.exceptAll(docs).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from cartulary.scratch import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert docs.where("text rlike 'token = .[0-9a-f]{40}'").count() == 0
