import binascii

import numpy as np
import pytest

from cartulary.llm import toxicity as T

STEMS = {"en": "lout", "de": "flegelhaft", "fr": "goujate"}


def _held_out(doc_id):
    return binascii.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def corpus():
    """Made-up words; toxic texts hold two to four words that begin with their language's stem. Every third text is unlabelled."""
    rng = np.random.default_rng(7)
    parts = ["ka", "ri", "mo", "ten", "sul", "ba", "dor", "vi", "né", "ox"]
    docs, labels = [], []
    for k in range(3000):
        lang = ["en", "de", "fr"][k % 3]
        words = ["".join(rng.choice(parts, rng.integers(2, 5))) for _ in range(rng.integers(5, 120))]
        toxic = bool(rng.random() < 0.12)
        if toxic:
            for _ in range(rng.integers(2, 5)):
                words.insert(int(rng.integers(len(words))), STEMS[lang] + rng.choice(parts))
        docs.append((k, " ".join(words), lang))
        if k % 3 != 1 or k % 2:
            labels.append((k, int(toxic)))
    return docs, labels, {d[0]: STEMS[d[2]] in d[1] for d in docs}


def _frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(6), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_no_look_at_held_labels(spark, corpus):
    docs, labels, truth = corpus
    frame, table = _frames(spark, docs, labels)
    model = T.learn(frame, table)
    got = {r.doc_id: r for r in T.score(frame, model).collect()}
    held = [k for k in truth if _held_out(k)]
    toxic = [k for k in held if truth[k]]
    assert np.mean([got[k].predicted for k in toxic]) >= 0.97
    assert np.mean([got[k].predicted for k in held if not truth[k]]) <= 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    # labels of held-out rows turned round, and a new partitioning: the same model
    turned = [(k, 1 - y if _held_out(k) else y) for k, y in labels]
    again = T.learn(*_frames(spark, docs[::-1], turned))
    assert again.bins == model.bins and again.prior == model.prior and np.allclose(again.weights, model.weights)


def test_counts_are_those_of_all_documents(spark, corpus):
    docs, _, _ = corpus
    frame, _ = _frames(spark, docs, [(0, 0)])
    vocabulary = ["<lout", "<flegelh", "<kari>", "nowhere"]
    rows = T._counted(frame.selectExpr("text", "case when doc_id < 3 then 'p0' end role"), vocabulary).collect()
    counts = {}
    for r in rows:
        if r.role is None:
            counts[r.place] = counts.get(r.place, 0) + r.n
    own = [{f for w in T.words_of(d[1]) for f in T.features_of(w)} for d in docs]
    assert counts == {-1: len(docs)} | {k: n for k, f in enumerate(vocabulary) if (n := sum(f in o for o in own))}
    assert sum(r.role == "p0" for r in rows) == 3


def test_risk_of_negatives_is_kept_from_falling_below_zero():
    """With a prior far too large the plain corrected risk has no minimum; the non-negative one stays bounded and still ranks."""
    rng = np.random.default_rng(1)
    p = np.column_stack([rng.normal(2, 1, 300), np.ones(300)])
    u = np.column_stack([np.concatenate([rng.normal(2, 1, 100), rng.normal(-2, 1, 900)]), np.ones(1000)])
    for prior in (0.1, 0.3):
        w = T.fit(p, u, prior)
        assert np.isfinite(w).all() and abs(w).max() < 20 and w[0] > 0.5
    w = T.fit(p, u, 0.1)
    scores = 1 / (1 + np.exp(-u @ w))
    assert (scores[:100] > 0.3).mean() > 0.9 and (scores[100:] > 0.3).mean() < 0.05


def test_words_across_pieces(monkeypatch):
    text = "alpha βeta gamma'delta 漢字漢字 " * 50
    whole = T.words_of(text)
    monkeypatch.setattr(T, "PIECE", 7)
    assert T.words_of(text) == whole and b"delta" in whole and "漢字漢字".encode() in whole


def test_edges(spark, corpus, odd_docs, no_docs):
    docs, labels, _ = corpus
    model = T.learn(*_frames(spark, docs, labels))
    rows = T.score(odd_docs, model).collect()
    assert len(rows) == 8
    byid = {r.doc_id: r for r in rows}
    assert byid[1].score == byid[2].score == byid[3].score < 0.3 and byid[1].n_features == 0 and byid[None].predicted in (0, 1)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert T.score(no_docs, model).collect() == []
    # nothing to learn from: no labels, only zeros, labels of ids that no document has, nulls
    for own in ([], [(4, 0), (5, 0)], [(99, 1)], [(None, 1), (4, None)]):
        none = T.learn(odd_docs, spark.createDataFrame(own, "doc_id long, toxic int"))
        assert {r.score for r in T.score(odd_docs, none).collect()} == {0.0}
    assert T.learn(no_docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).bins == {}
    # positives only: the prior comes from frequencies
    assert 0 < T.learn(*_frames(spark, docs, [x for x in labels if x[1]])).prior < 0.5
