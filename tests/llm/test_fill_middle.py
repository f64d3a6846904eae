import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from cartulary.llm import fill_middle as M

TEXTS = st.text(alphabet=st.sampled_from("ab<PSM>é日😀́\n"), max_size=60)


def _plain(doc_id, text):
    """The contract over a list of code points."""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_index_converts_both_ways(text):
    index = M.ExceptionIndex(text.encode())
    assert index.n == len(text)
    cuts = np.arange(len(text) + 1)
    starts = [len(text[:c].encode()) for c in cuts]
    assert index.to_bytes(cuts).tolist() == starts
    owner = [k for k, c in enumerate(text) for _ in c.encode()] + [len(text)]
    assert index.to_points(np.arange(len(owner))).tolist() == owner
    assert len(index.points) == sum(ord(c) > 127 for c in text)


def test_index_across_blocks(monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 3)
    test_index_converts_both_ways.hypothesis.inner_test("aé日b😀😀c" * 5)


@given(st.integers(0, 10**12), TEXTS)
@settings(max_examples=500, deadline=None)
def test_against_plain_code_points(doc_id, text):
    n, form, prefix, middle, output = M.transformed(doc_id, text.encode())
    assert (n, form, prefix, middle, output.decode()) == _plain(doc_id, text)
    assert M.restored(output, form) == text.encode()


@given(st.integers(0, 10**12), TEXTS)
@settings(max_examples=300, deadline=None)
def test_byte_cuts_split_no_character(doc_id, text):
    n, form, prefix, middle, output = M.transformed(doc_id, text.encode(), unit="bytes")
    assert M.restored(output, form) == text.encode()
    output.decode()
    if form != "plain":
        assert 0 <= prefix <= prefix + middle <= n


def test_long_text_of_wide_characters():
    text = "日本語😀" * 300_000 + "tail"
    n, form, prefix, middle, output = M.transformed(3, text.encode())
    assert (n, form, prefix, middle, output.decode()) == _plain(3, text)


def test_operator_and_its_way_back(spark, documents, texts):
    for unit in ("chars", "bytes"):
        done = M.fill_in_middle(documents, unit=unit)
        assert done.count() == len(texts) and done.where("form = 'spm'").count() and done.where("form = 'psm'").count()
        assert {r.doc_id: r.text for r in M.restore(done).collect()} == {k: v or "" for k, v in texts.items()}


def test_edges(spark, odd_docs, no_docs):
    rows = M.fill_in_middle(odd_docs).collect()
    assert len(rows) == 8
    byid = {r.doc_id: r for r in rows}
    assert (byid[1].n, byid[1].form, byid[1].output, byid[1].prefix_chars) == (0, "plain", "", None)
    assert byid[None].n == 19 and byid[5].n > 400_000 and byid[6].n == len("日本語 emoji 😀 café")
    assert len({r.output for r in rows if r.doc_id == 4}) == 1
    assert M.fill_in_middle(no_docs).collect() == []
