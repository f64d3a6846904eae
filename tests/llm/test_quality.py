import math
import re
from collections import Counter

import xxhash

from cartulary.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def _cells(text, buckets):
    def h(*words):
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
        return (seed - (1 << 64) if seed >> 63 else seed) % buckets

    words = WORD.findall(text or "")
    return [h(w) for w in words] + [h(a, b) for a, b in zip(words, words[1:], strict=False)]


def test_against_brute_force(spark, sf_dir, texts):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        cells = _cells(t, Q.BUCKETS)
        raw.update(cells)
        if i in good:
            target.update(cells)
    nr, nt = sum(raw.values()), sum(target.values())
    got = {r.doc_id: r for r in Q.op1_quality_rules(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        r = got[i]
        base = _base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base, i
        cells = _cells(t, Q.BUCKETS)
        score = sum(math.log(target[c] + Q.ALPHA) - math.log(nt * raw[c] / nr + Q.ALPHA) for c in cells) / len(cells)
        assert abs(score - r.score) < 1e-9
        assert r.kept == (not base[-1] and r.score >= Q.THRESHOLD)


def test_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    rows = Q.quality_rules(odd_docs, labels).collect()
    assert len(rows) == 8
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 50)
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert Q.quality_rules(no_docs, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0 for r in Q.quality_rules(odd_docs, none).collect() if r.n_words)


def test_repeats(spark):
    text = "a b c d a b c e f a b c d\n" * 2 + "x y"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    r = Q.quality_rules(rows, labels).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(text)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = Q.op1_quality_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
