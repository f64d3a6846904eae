import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cartulary.llm import source_divergence as D


def _f(p, q):
    return (p - q) ** 2 // (p + q)


def _plain(docs, least=10, top=10):
    """The contract over dictionaries."""
    docs = [(lang or "", source or "", "".join(c.lower() if c.isascii() else c for c in text or "")) for lang, source, text in docs]
    holders, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        holders[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in holders[lang].items() if n >= least]
        v = len(kept)

        def rates(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: rates(counts[lang, s]) for s in sources}
        q = rates(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(_f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(_f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])}
    return out


def _got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("first", [1, 3, 10])
def test_every_first_level_gives_the_plain_result(spark, monkeypatch, first):
    rng = np.random.default_rng(first)
    bits = ["a", "b", "é", "日", "stem", "Prefix", "ization", "x" * 40]
    docs = []
    for k in range(160):
        words = ["".join(rng.choice(bits, rng.integers(1, 4))) for _ in range(rng.integers(0, 25))]
        docs.append((["en", "fr", None][k % 3], f"s{rng.integers(7)}" if k % 11 else None, " ".join(words) if k % 13 else None))
    rows = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    monkeypatch.setattr(D, "HELD", 50)
    monkeypatch.setattr(D, "PIECE", 7)
    binary = rows.selectExpr("coalesce(cast(lang as binary), X'') lang", "coalesce(cast(source as binary), X'') source", "coalesce(cast(text as binary), X'') text")
    kept = {(r.lang.decode(), r.source.decode(), r.term.decode()): r.n for r in D.iceberg_terms(binary, 10, first).collect()}
    plain = _plain(docs)
    assert {(k[0], k[1], k[2]) for k in kept} >= {(x[0], x[1], x[3]) for x in plain if x[2] == "term"}
    assert _got(D.divergence(rows)) == plain


def test_blocks_and_ranges_change_nothing(spark, documents):
    rows = documents.selectExpr("cast(lang as binary) lang", "cast(source as binary) source", "cast(text as binary) text").where("lang is not null and source is not null and text is not null")
    kept = D.iceberg_terms(rows)
    counts = {(r.lang, r.source): r.n for r in kept.groupBy("lang", "source").agg({"n": "sum"}).toDF("lang", "source", "n").collect()}
    kinds = Counter(r.lang for r in kept.select("lang", "term").distinct().collect())
    pairs = [(r.lang, r.source) for r in rows.select("lang", "source").distinct().collect()]
    peers = Counter(p[0] for p in pairs)
    groups = spark.createDataFrame([(a, b, counts.get((a, b), 0), kinds[a], peers[a]) for a, b in pairs], "lang binary, source binary, total long, kinds long, peers long")
    one = {tuple(map(bytes, r[:3])) + (r[3],) for r in D.pair_values(kept, groups).collect()}
    other = {tuple(map(bytes, r[:3])) + (r[3],) for r in D.pair_values(kept, groups, block_sources=3, range_terms=50).collect()}
    assert one == other and len(one) == sum(n * (n - 1) for n in peers.values())


def test_two_sources_are_one_pair_whatever_the_order_of_rows():
    import pyarrow as pa

    def table(sources):
        k = len(sources)
        columns = {"lang": [b"en"] * k, "bi": [0] * k, "bj": [0] * k, "block": [0] * k, "source": sources, "divisor": [50] * k, "term": [b"t"] * k, "n": [len(s) for s in sources]}
        return pa.table({c: pa.array(v, pa.binary() if isinstance(v[0], bytes) else pa.int64()) for c, v in columns.items()})

    rows = [sorted(map(tuple, (r.values() for r in D._compared(table(s)).to_pylist()))) for s in ([b"a", b"bb", b"ccc"], [b"ccc", b"a", b"bb"], [b"bb", b"ccc", b"a"])]
    assert rows[0] == rows[1] == rows[2] and {r[1:3] for r in rows[0]} == {(b"a", b"bb"), (b"a", b"ccc"), (b"bb", b"ccc")}


@given(st.lists(st.tuples(st.integers(0, 10**12), st.integers(1, 8 * 10**15)), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_exact_rates(pairs):
    counts, divisors = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    divisors = np.maximum(divisors, counts + 2)
    assert D.exact_p(counts, divisors).tolist() == [1 + 10**9 * (c + 2) // d for c, d in zip(counts.tolist(), divisors.tolist(), strict=True)]


def test_edges(spark, odd_docs, no_docs):
    assert _got(D.divergence(odd_docs)) == _plain([(r.lang, r.source, r.text) for r in odd_docs.collect()])
    assert _got(D.divergence(odd_docs, least=1)) == _plain([(r.lang, r.source, r.text) for r in odd_docs.collect()], least=1)
    assert _got(D.divergence(no_docs)) == set()
