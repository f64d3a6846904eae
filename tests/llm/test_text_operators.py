import base64
import gzip
import hashlib
import re
import time
import urllib.parse
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cartulary.llm import avi, bpe, language_id as L, license_scan, packing, secret_scan as S, sharding

SECRET = 'token = "abcdefghijkl12345"'


# ---- secrets ----


def _plain_scan(text):
    kinds = [
        (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
        (r"AKIA[A-Z0-9]+", 0, 18),
        (r"[0-9a-f]+", 0, 16),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= n)


@given(st.text(alphabet="tokenTOKEN=:\"' abcdef0123AKIAZ_%&;", max_size=120))
@settings(max_examples=300, deadline=None)
def test_base_rules(text):
    assert S.scan(text) == _plain_scan(text)


def test_base_columns(spark, sf_dir, texts):
    for r in S.op2_secret_scan(spark, sf_dir).collect():
        hits = _plain_scan(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in hits) for j in range(3)]
        line = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in hits)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(
    ("wrapped", "name"),
    [
        (urllib.parse.quote(SECRET), "url.assign"),
        (base64.b64encode(SECRET.encode()).decode(), "base64.assign"),
        (base64.b64encode(gzip.compress(SECRET.encode(), mtime=0)).decode(), "base64.gzip.assign"),
        (base64.urlsafe_b64encode(zlib.compress(SECRET.encode())).decode(), "base64.zlib.assign"),
        (base64.b64encode(urllib.parse.quote(urllib.parse.quote(SECRET)).encode()).decode(), "base64.url.url.assign"),
        ("".join(f"\\u{ord(c):04x}" for c in SECRET), "unicode.assign"),
    ],
)
def test_layers(wrapped, name):
    text = f"é before {wrapped} after"
    hits, layers, refused = S.unwrap(text)
    found = [h for h in hits if h[1] == name]
    assert found and layers >= 1 and not refused
    start, _, end = found[0]
    at = text.index(wrapped)
    assert at <= start < end <= at + len(wrapped)
    assert "12345" not in S.masked(text) or "assign" not in " ".join(h[1] for h in S.unwrap(S.masked(text))[0])


WRAPS = {
    "url": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "base64.gzip": lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(),
    "base64.zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
}


@given(st.lists(st.lists(st.sampled_from(sorted(WRAPS)), min_size=1, max_size=4), min_size=1, max_size=3), st.text(alphabet="aé日 ", max_size=8))
@settings(max_examples=120, deadline=None)
def test_every_chain_of_layers_is_unwrapped(chains, between):
    """Secrets in known chains of layers: each is found under the chain's name, within the characters that hold it."""
    text, want = between + " ", []
    for chain in chains:
        run = SECRET
        for kind in reversed(chain):
            run = WRAPS[kind](run)
        want.append((len(text), ".".join([*chain, "assign"]), len(text) + len(run)))
        text += run + " " + between + " "
    hits, _, refused = S.unwrap(text)
    assert not refused
    for start, name, end in want:
        assert any(s == start and n == name and start < e <= end for s, n, e in hits)
    # nothing decoded is found outside the runs
    assert all(any(a <= s and e <= b for a, _, b in want) for s, n, e in hits if "." in n)


def test_bomb_and_cycle():
    bomb = base64.b64encode(gzip.compress(b"a" * 100_000)).decode()
    assert S.unwrap(bomb, limit=1000)[2] == 1
    assert S.unwrap("%25%32%35" * 50)[1] < 200


@pytest.mark.parametrize("unit", ["base64", "%41", "\\u0041", "Ab1/", "usr/lib/python3/", "deadbeef", "token = "])
def test_long_runs_take_time_in_proportion(unit):
    """Ten million characters without a line break: every expression reads a run once."""
    rng = np.random.default_rng(5)
    text = base64.b64encode(rng.bytes(7_500_000)).decode() if unit == "base64" else unit * (10_000_000 // len(unit))
    began = time.process_time()
    S.unwrap(text)
    assert time.process_time() - began < 90


def test_secret_edges(odd_docs, no_docs):
    assert S.secret_scan(odd_docs).count() == 8
    assert S.secret_scan(no_docs).count() == 0


# ---- byte BPE ----


@pytest.fixture(scope="module")
def codec():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        raw = f.read()
    return bpe.Codec(raw, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(raw), special_tokens={})


@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n\t's\x85\xa0\x1c-=1é日😀", max_size=80), st.text(alphabet="etaoinshr", max_size=80)))
@settings(max_examples=400, deadline=None)
def test_bpe_equals_the_library(codec, text):
    ours, theirs = codec
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    packed = ours.encode(text)
    ids = np.frombuffer(packed, dtype="<u4")
    assert ids.tolist() == theirs.encode_ordinary(text)
    assert ours.decode(ids) == (text.encode(), True)


def test_bpe_when_states_are_made_anew(codec, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 5)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    for text in ("internationalization of unbelievableness", "aaaab" * 50, "\u65e5\u672c\u8a9e" * 40):
        fresh = bpe.Transducer(codec[0].machine.ranks)
        assert [t for p in codec[0].pattern.findall(text) for t in fresh.encode(p.encode())] == codec[1].encode_ordinary(text)


def test_bpe_query_equals_the_library(codec, spark, sf_dir, texts):
    for r in bpe.op4_byte_bpe(spark, sf_dir).collect():
        ids = codec[1].encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() and r.valid_utf8


def test_bytes_that_are_not_utf8_are_seen(codec):
    ranks = codec[0].machine.ranks
    for raw, good in ((b"\xc3", False), (b"a\xc3\xa9b", True), (b"\xa9", False), (b"\xc3a", False)):
        assert codec[0].decode(np.array([ranks[raw[k : k + 1]] for k in range(len(raw))])) == (raw, good)


def test_bpe_long_runs(codec):
    ours, theirs = codec
    for text in ("a" * 3000, "=-" * 2000, " " * 500 + "x", "\n" * 300, "é" * 700):
        assert np.frombuffer(ours.encode(text), dtype="<u4").tolist() == theirs.encode_ordinary(text)


def test_utf8_machine(codec):
    machine = codec[0].utf8
    for raw in (b"\xff", b"\xc3", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe0\x80\x80"):
        state = machine.advance(machine.START, raw)
        assert state != machine.START


def test_bpe_edges(odd_docs, no_docs):
    rows = bpe.bpe_round_trip(odd_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == 8 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert bpe.bpe_round_trip(no_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# ---- packing ----


def _check_pieces(pieces, ids):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for doc, parts in by_doc.items():
        at, own = 0, ids[doc]
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(own) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(own[at : at + p.length].tobytes())
            at += p.length
        assert at == len(own)
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
    return sum(map(len, ids.values())), len(by_seq)


def test_packing(spark, sf_dir, texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, x in texts.items()}
    tokens, sequences = _check_pieces(packing.op6_pack_windows(spark, sf_dir).collect(), ids)
    assert tokens >= 0.97 * sequences * packing.WINDOW


def test_packing_many_partitions(spark, documents, texts):
    pieces = packing.pack(documents.repartition(23), P.path("word_bpe_49k.json"), merge_span=4).collect()
    assert {p.doc_id for p in pieces} == set(texts)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_packing_edges(odd_docs, no_docs):
    pieces = packing.pack(odd_docs, P.path("word_bpe_49k.json")).collect()
    assert sorted(p.length for p in pieces if p.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert sum(p.doc_id == 4 for p in pieces) == 2 and sum(p.doc_id is None for p in pieces) == 1
    assert packing.pack(no_docs, P.path("word_bpe_49k.json")).count() == 0


@pytest.fixture(scope="module")
def words():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return packing.WordTokenizer(f.read())


def test_special_tokens_as_the_library(words, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ["hello <|startoftext|> world", "<|endoftext|>x", "a < | b", "don't 'S 3\xb2\xbd \xc0\xc9 \xdf\xd7\xf7 x\x1cy", "", " \n ", "x y\x85z", "\u03a3\u03c2 \u0130 e\u0301 \u65e5\u672c"] * 2
    assert [e.tolist() for e in words.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.one_of(st.text(max_size=80), st.text(alphabet="aB'sStTrReEvVmMlLdD 0\xb2\xbd\xdf\xc9\xd7\xaa\t.\xad\xa1\xff", max_size=60)))
@settings(max_examples=400, deadline=None)
def test_word_tokens_equal_whole_texts(words, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert words.encode([text])[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


# ---- language ----


def test_language_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in found)
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def _phrases(word, text):
    at = n = 0
    while at < len(word):
        k = 1
        while at + k < len(word) and word[at : at + k + 1] in text:
            k += 1
        at, n = at + k, n + 1
    return n


@given(st.text(alphabet="abc", max_size=40), st.text(alphabet="abcd", max_size=30))
@settings(max_examples=300, deadline=None)
def test_cross_parsing(text, word):
    assert L.SuffixAutomaton(text).phrases(word) == _phrases(word, text)


def test_language_edges(odd_docs, no_docs):
    samples = L.learn(odd_docs, "text", "lang", "doc_id")
    rows = L.language_id(odd_docs, samples).collect()
    assert len(rows) == 8
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert L.language_id(odd_docs, L.learn(no_docs, "text", "lang", "doc_id")).where("lang_pred <> 'und'").count() == 0
    assert L.language_id(no_docs, samples).count() == 0
    assert all(len(t) <= L.SAMPLE_CHARS + 100 for _, t in samples)


# ---- media ----


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_avi_round_trip(data):
    media = avi.store(data)
    video = avi.read_avi(media)
    _, fixed = avi.histograms(video.frames)
    assert avi.payload_of(fixed) == avi.padded(data)
    general, quant, width, height = avi.frame_coefficients(video.frames[-1])
    assert (general == fixed[-1]).all() and (width, height) == (32, 24) and (quant == 1).all()


def test_avi_without_index_and_broken(spark):
    media = avi.store(b"x" * 3000)
    cut = media[: media.rindex(b"idx1")]
    cut = cut[:4] + (len(cut) - 8).to_bytes(4, "little") + cut[8:]
    assert avi.read_avi(cut).frames == avi.read_avi(media).frames
    rows = spark.createDataFrame([(1, media), (2, b"RIFF"), (3, None), (4, media[:-40])], "id long, content binary")
    got = avi.clips(rows, "id", "content").collect()
    assert {r.id for r in got if r.error} == {2, 4} and {r.id for r in got if r.error is None} == {1}


def test_shots():
    dark, light = np.eye(avi.BINS)[0], np.eye(avi.BINS)[9]
    hists = np.array([dark] * 5 + [light] * 4 + [dark] * 3)
    assert avi.shots(hists) == [(0, 5), (5, 9), (9, 12)]
    assert avi.shots(np.empty((0, avi.BINS))) == []


def test_media_columns(spark, sf_dir, texts):
    for r in avi.op7_avi_media(spark, sf_dir).collect():
        payload = avi.padded(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id].encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])


def test_media_edges(odd_docs, no_docs):
    rows = avi.stored_texts(odd_docs).collect()
    assert len(rows) == 8 and {r.payload_bytes for r in rows if r.doc_id in (1, 2)} == {576}
    assert avi.stored_texts(no_docs).count() == 0


# ---- shards ----


def test_shards(spark, sf_dir, documents, texts):
    rows = sharding.op9_stratified_shards(spark, sf_dir).collect()
    source = {r.doc_id: r.source for r in documents.collect()}
    counts, mixture = {}, {}
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        counts.setdefault(r.shard, []).append(r.slot)
        mixture[source[r.doc_id], r.shard] = mixture.get((source[r.doc_id], r.shard), 0) + 1
    assert len(rows) == len(texts) and sorted(counts) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    for s in set(source.values()):
        each = [mixture.get((s, k), 0) for k in range(16)]
        assert max(each) - min(each) <= 2


def test_shard_ranges_do_not_matter(documents):
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(documents, rows_per_range=10_000).collect()}
    many = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(documents.repartition(9), rows_per_range=7).collect()}
    assert one == many


def test_shard_edges(odd_docs, no_docs):
    rows = sharding.shard(odd_docs).collect()
    assert len(rows) == 8 and all(r.slot == 0 for r in rows) and len({r.shard for r in rows}) == 8
    assert sharding.shard(no_docs).count() == 0


def test_shards_without_python(documents):
    assert not re.search("Python|Pandas|Arrow", sharding.shard(documents)._jdf.queryExecution().toString())


# ---- licences ----


def _phrase_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return len(words), sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


@given(st.lists(st.sampled_from("under the mit license apache version 2 cc by nc x é".split()), max_size=40), st.sampled_from([" ", ", ", "\n"]))
@settings(max_examples=300, deadline=None)
def test_licence_phrases(words, sep):
    text = sep.join(words)
    got = license_scan._scanner(4, 12, 0.8).scan(text.encode())
    n, places = _phrase_places(text)
    assert got[:2] == (n, len(places))
    assert got[2:4] == ((places[0][0], places[-1][0]) if places else (None, None))
    assert got[4] == ",".join(sorted({label for _, label in places}))
    assert set(filter(None, got[4].split(","))) <= set(got[5].split(",")) and 0 <= got[6] <= 1


def test_matching_statistics():
    auto = license_scan.Scanner({"a b c": "x"}, {"y": ["a b a b d"]}, 2, 5, 0.8)
    runs, places = auto.statistics(b"a b c z a b d".split())
    assert places == [(0, 0)]
    assert [(end, n) for end, n, _ in runs] == [(2, 3), (6, 3)]


def test_licence_templates():
    text = "// " + license_scan.TEMPLATES["mit"][0].replace("copy, modify", "copy, really modify")
    got = license_scan._scanner(4, 12, 0.8).scan(text.encode())
    assert "mit" in got[5].split(",") and got[6] > 0.9


def test_licence_edges(odd_docs, no_docs):
    rows = license_scan.license_scan(odd_docs).collect()
    assert len(rows) == 8 and {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert license_scan.license_scan(no_docs).count() == 0
