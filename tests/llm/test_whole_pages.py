"""Pages without a main element, and what a template prints inside one."""

from cartulary.llm import html_extract as H

A = '<body><div class="top"><h1>Head {n}</h1></div><div class="left" id="a-{n}"><p>first {n} of the long part, {w}</p></div><div class="right"><p>second {n}</p></div><ul class="more"><li><a href="#">link {n}</a></ul></body>'
B = '<body><table><tr><td>cell {n} of the other template {w}</td></tr></table></body>'


def test_two_templates_of_a_host_keep_their_text():
    words = [" ".join(f"w{n}x{k}" for k in range(12)) for n in range(10)]
    got = H.extract([(A if n < 7 else B).format(n=n, w=words[n]) for n in range(10)])
    assert got[:7] == [f"Head {n}\nfirst {n} of the long part, {words[n]}\nsecond {n}" for n in range(7)]
    assert got[7:] == [f"cell {n} of the other template {words[n]}" for n in range(7, 10)]


def test_one_long_page_does_not_empty_the_others():
    pages = [f'<div id="item-{n}"><p>{" ".join(f"t{n}y{k}" for k in range(2000 if n == 17 else 5))}</p></div>' for n in range(15, 20)]
    assert [len(t.split()) for t in H.extract(pages)] == [5, 5, 2000, 5, 5]


def test_lines_of_the_article_stay_though_every_page_has_them():
    words = [" ".join(f"w{n}x{k}" for k in range(60)) for n in range(10)]
    page = '<article><h1>Head {n}</h1><p>{w}</p><h2 class="part-title">Conclusion</h2><table><tr><td>Population</td><td>{n}m</td></tr></table><p>By <b>writer {n}</b></p></article>'
    pages = [page.format(n=n, w=w) for n, w in enumerate(words)]
    for size in (1, 3, 7, 8, 10):
        assert H.extract(pages[:size]) == [f"Head {n}\n{w}\nConclusion\nPopulation\n{n}m\nBy writer {n}" for n, w in enumerate(words[:size])]


def test_names_inside_the_article():
    prose = ["ad-hoc", "promo-code", "related-work", "share-price", "form-guide", "comment-free", "sponsor-facts"]
    other = ["ad-slot", "comments-area", "related-posts", "promo-box", "newsletter-signup", "ad-1", "cookie-banner-box", "comment"]
    page = "<article>" + "".join(f'<div class="{c}">text of {c}</div>' for c in prose + other) + "</article>"
    assert H.extract([page]) == ["\n".join(f"text of {c}" for c in prose)]


def test_copies_of_one_article_keep_their_text():
    pages = [f"<article><p>{' '.join(f'word{k}' for k in range(80))}</p><p>copy {n}</p></article>" for n in range(10)]
    assert all(len(t.split()) == 82 for t in H.extract(pages) + H.extract(pages[:1] * 20))
