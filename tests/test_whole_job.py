"""Work that was once left out: long lists, long texts, large name families."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cartulary.functions import names as fn_names
from cartulary.operators import duplicates, naming, ranks, similar_names
from cartulary.plans import registry
from cartulary.schema import as_files
from cartulary.scratch import cut
from cartulary.sources import archives


def _files(spark, rows):
    return as_files(spark.createDataFrame(rows, "id long, path string, size long, modified double, source_root string, content string, visual_hash string"))


def test_long_hash_lists_are_compared_whole(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(duplicates, "TILE", 40)
    values = [0xA << 60 | rng.getrandbits(60) for _ in range(150)]
    values += [v ^ 1 << rng.randrange(60) ^ 1 << rng.randrange(60) for v in values[:60]] + values[:5] + values[:5]
    rows = [(i, f"/p/{i}.jpg", 1, float(i), "/p", None, f"{v:016x}") for i, v in enumerate(values)]
    want = {(i, j): (values[i] ^ values[j]).bit_count() for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 20}
    files = _files(spark, rows)
    assert {(r.a, r.b): r.distance for r in duplicates.near_edges(files, prefix=1, distance=20, most=None).collect()} == want
    root = list(range(len(values)))
    for i, j in want:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    hashes = {r: {v for v, q in zip(values, root, strict=True) if q == r} for r in root}
    got = sorted((r.gid, r.id) for r in duplicates.near_look(files, prefix=1, distance=20, most=None).collect())
    assert got == sorted((f"near:{r}", i) for i, r in enumerate(root) if len(hashes[r]) > 1)


def test_near_queries_have_no_list_limit(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [float(rng.random() < 0.5) for _ in range(60)] + [1.0] * 4) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.QUERIES["near_edges"](spark, str(tmp_path)).count() > 0
    assert registry.QUERIES["near_look"](spark, str(tmp_path)).count() > 0


def test_long_texts_are_compared_whole(spark):
    word = lambda who, k: f"{who}{k:05d}"
    same = [word("same", k) for k in range(2500)]
    texts = [same + [word("mine", k) for k in range(2500)], same + [word("yours", k) for k in range(2500)], [word("front", k) for k in range(2000)] + same * 2 + [word("last", k) for k in range(5500)], [word("last", k) for k in range(5500)]]
    files = _files(spark, [(i, f"/r/{i}.txt", 50_000_000, float(i), "/r", " ".join(t), None) for i, t in enumerate(texts)] + [(9, "/r/9.txt", 50_000_000, 9.0, "/r", " ".join(texts[0]), None)])
    found = {(r.a, r.b): r.overlap for r in duplicates.token_overlap(files).collect()}
    assert found == {(2, 3): 1.0}
    classes = {r.id: (r.class_id, r.members) for r in duplicates.token_classes(files).collect()}
    assert classes == {0: (0, 2), 9: (0, 2), 1: (1, 1), 2: (2, 1), 3: (3, 1)}
    assert sorted(r.id for r in duplicates.by_text(files).collect()) == [0, 9]


def test_token_overlap_equals_all_pairs(spark):
    rng = random.Random(4)
    common = [f"word{k}" for k in range(60)]
    texts = []
    for k in range(150):
        own = rng.sample(common, rng.randint(0, 30)) + [f"rare{rng.randint(0, 40)}" for _ in range(rng.randint(0, 8))]
        texts.append(" ".join(own))
        if k % 5 == 0:
            texts.append(" ".join(reversed(own)))
        if k % 4 == 0:
            texts.append(" ".join(own[: len(own) * 3 // 4] + ["more"] * (k % 3)))
    files = _files(spark, [(i, f"/r/{i}.txt", 1, 0.0, "/r", t, None) for i, t in enumerate(texts)] + [(900, "/r/n", 1, 0.0, "/r", None, None)])
    first, members = {}, {}
    for i, t in enumerate(texts):
        key = frozenset(w for w in t.split() if len(w) >= 4)
        if key:
            first.setdefault(key, i)
            members[first[key]] = members.get(first[key], 0) + 1
    want = {}
    for x, i in first.items():
        for y, j in first.items():
            if i < j and (v := len(x & y) / min(len(x), len(y))) >= 0.72:
                want[i, j] = (v, members[i], members[j])
    for common_tokens in (1, 6):
        rows = duplicates.token_overlap(files, common=common_tokens).collect()
        assert {(r.a, r.b): (r.overlap, r.members_a, r.members_b) for r in rows} == want and len(rows) == len(want) > 20


def test_text_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ab " * 3_000_000)
    assert len(archives.read_texts(spark, str(tmp_path)).first().text) == 9_000_000


def _sequential(wanted, taken):
    """The rule itself, one row after another."""
    used, finals = set(taken), []
    for path in wanted:
        final, k = path, 0
        folder, name = path.rsplit("/", 1)
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
        while final in used:
            k += 1
            final = f"{folder}/{stem}_{k}{ext}"
        used.add(final)
        finals.append(final)
    return finals


def _unique(spark, wanted, taken=(), hot=1 << 18):
    plan = spark.createDataFrame([(i, i, d) for i, d in enumerate(wanted)], "ord long, id long, destination string").repartition(3)
    existing = spark.createDataFrame([(t,) for t in taken], "destination string") if taken else None
    got = {r.ord: r.final_destination for r in naming.unique_names(plan, existing, hot).collect()}
    return [got[i] for i in range(len(wanted))]


def test_numbers_between_numbered_names(spark):
    roll = [f"/d/IMG_{k}.jpg" for k in range(1, 41)] * 3 + ["/d/IMG.jpg", "/d/a.jpg", "/d/a.jpg", "/d/a_1.jpg", "/d/a_1_1.jpg", "/d/a_7.jpg"]
    got = _unique(spark, roll)
    assert got == _sequential(roll, [])
    assert got[40] == "/d/IMG_1_1.jpg" and got[80] == "/d/IMG_1_2.jpg" and len(set(got)) == len(roll)
    assert got[121:126] == ["/d/a.jpg", "/d/a_1.jpg", "/d/a_1_1.jpg", "/d/a_1_1_1.jpg", "/d/a_7.jpg"]


def test_names_equal_the_sequential_rule(spark):
    """Families whose numbered names are wanted before, between and after those that number onto them, with and without files there, hot keys and not."""
    for seed in range(4):
        rng = random.Random(seed)
        pool = ["/d/a.x", "/d/a_1.x", "/d/a_2.x", "/d/a_3.x", "/d/a_1_1.x", "/d/a_2_1.x", "/d/b.", "/d/b._1", "/d/b_1.", "/d/b_1._1", "/d/b_2._1", "/d/c", "/d/c_1", "/d/c_01", "/e/a.x"]
        wanted = rng.choices(pool, k=120)
        taken = rng.sample([*pool, "/d/a_5.x", "/d/c_2", "/d/c_4"], 5) if seed % 2 else []
        assert _unique(spark, wanted, taken, hot=3 if seed > 1 else 1 << 18) == _sequential(wanted, taken)


def test_no_task_holds_a_hot_key(spark, tmp_path, monkeypatch):
    """One name that nearly all rows want: the ranges of its rows are many, and none is most of them."""
    made = {}
    monkeypatch.setattr(ranks, "cut", lambda df, name: made.setdefault(name, cut(df, name)))
    rows = spark.range(60_000).selectExpr("id as ord", "case when id % 100 = 0 then 'other' else 'hot' end as key")
    rows.write.parquet(f"{tmp_path}/rows")
    ranked = ranks.running(spark.read.parquet(f"{tmp_path}/rows"), ["key"], [F.col("ord")], "r", hot=1000)
    per = [r["count"] for r in made["ranges"].groupBy("key", "_range").count().collect()]
    assert sum(per) == 59_400 and len(per) >= 4 and max(per) < 30_000
    got = sorted((r.key, r.ord, r.r) for r in ranked.collect())
    want, seen = [], {}
    for k in range(60_000):
        key = "other" if k % 100 == 0 else "hot"
        want.append((key, k, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + 1
    assert got == sorted(want)


def test_similar_names_equal_all_pairs(spark):
    rng = random.Random(11)
    syllables = ["ka", "ri", "mo", "ten", "su", "ba", "do", "vi", "ne", "ox", "1", "20", "77"]
    names_ = {"".join(rng.choices(syllables, k=rng.randint(1, 9)))[:20] for _ in range(1400)}
    for n in sorted(names_)[:400]:
        k = rng.randrange(len(n))
        names_ |= {n[:k] + rng.choice("abz9") + n[k:], n[:k] + n[k + 1 :]}
    names_ = sorted(n for n in names_ if n)[:2000]
    files = _files(spark, [(i, f"/r/{n}.txt", 1, 0.0, "/r", None, None) for i, n in enumerate(names_)])
    normal = sorted({r.a for r in files.select(fn_names.normalised(fn_names.basename(F.col("path"))).alias("a")).collect() if r.a})
    want = set()
    for j, y in enumerate(normal):
        matcher = SequenceMatcher(None, "", y)
        for x in normal[:j]:
            matcher.set_seq1(x)
            if matcher.real_quick_ratio() >= 0.82 and matcher.quick_ratio() >= 0.82 and matcher.ratio() >= 0.82:
                want.add((x, y))
    got = [(r.a, r.b) for r in similar_names.similar_names(files).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_close_hashes_meet_in_bands(spark):
    """The default distance, over 2,000 photos of few lists: equal to all pairs."""
    rng = random.Random(12)
    values = [rng.randrange(3) << 48 | rng.getrandbits(48) for _ in range(1200)]
    for v in values[:800]:
        for _ in range(rng.randint(0, 9)):
            v ^= 1 << rng.randrange(48)
        values.append(v)
    files = _files(spark, [(i, f"/p/{i}.jpg", 1, float(i), "/p", None, f"{v:016x}") for i, v in enumerate(values)])
    want = {(i, j): d for j in range(len(values)) for i in range(j) if values[i] >> 48 == values[j] >> 48 and (d := (values[i] ^ values[j]).bit_count()) <= 8}
    rows = duplicates.near_edges(files).collect()
    assert {(r.a, r.b): r.distance for r in rows} == want and len(rows) == len(want) > 300


def test_groups_of_a_hot_key_are_ranked_in_ranges(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(ranks, "cut", lambda df, name: made.setdefault(name, cut(df, name)))
    rows = [(i, f"/r/{i:04d}.txt", 0, float(i % 7), "/r", "", None) for i in range(3000)] + [(9000 + i, f"/r/x{i % 2}", 5, 0.0, "/r", "abcde", None) for i in range(2)]
    members = duplicates.grouped(_files(spark, rows), F.col("size").cast("string"), "exact", "", hot=500)
    got = {r.id: r.keep_rank for r in members.collect()}
    order = sorted(range(3000), key=lambda i: (float(i % 7), f"/r/{i:04d}.txt", i))
    assert got == {i: k for k, i in enumerate(order)} | {9000: 0, 9001: 1}
    per = [r["count"] for r in made["ranges"].groupBy("_range").count().collect()]
    assert sum(per) == 3000 and max(per) < 1500


def test_ranks_that_nothing_else_reads_are_not_written(spark, monkeypatch):
    written = []
    for module in (naming, ranks):
        monkeypatch.setattr(module, "cut", lambda df, name, cut=module.cut: written.append(name) or cut(df, name))
    rows = [(i, f"/d/{'abc'[i % 3]}.x/n{i % 4}{['.jpg', ''][i % 2]}") for i in range(60)]
    plan = spark.createDataFrame([(i, i, d) for i, d in rows], "ord long, id long, destination string")
    there = ["/d/a.x/n0.jpg", "/d/z"]
    for have in (None, there):
        written.clear()
        taken = None if have is None else spark.createDataFrame([(x,) for x in have], "destination string")
        got = {r.ord: (r.final_destination, r.renamed) for r in naming.unique_names(plan, taken, 3).collect()}
        want = _sequential([d for _, d in rows], set(have or []))
        assert got == {i: (w, w != d) for (i, d), w in zip(rows, want, strict=True)}
        assert "ranked" not in written and written.count("hot_keys") == 1
