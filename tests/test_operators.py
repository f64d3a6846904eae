import os
import random
import re
import zipfile

from pyspark.sql import functions as F

from cartulary.functions import names
from cartulary.operators import duplicates, index, layout, naming
from cartulary.schema import as_files
from cartulary.sources import archives, listing


def _files(spark, rows):
    return as_files(spark.createDataFrame(rows, "id long, path string, size long, modified double, source_root string, content string, visual_hash string"))


def test_exact_groups_and_extras(spark):
    rows = [(1, "/r/a.txt", 3, 5.0, "/r", "abc", None), (2, "/r/b.txt", 3, 1.0, "/r", "abc", None), (3, "/r/c.txt", 3, 2.0, "/r", "abd", None), (4, "/r/d.txt", 4, 2.0, "/r", "abcd", None)]
    found = duplicates.exact(_files(spark, rows))
    assert [(r.id, r.keep_rank) for r in found.orderBy("keep_rank").collect()] == [(2, 0), (1, 1)]
    assert [r.path for r in duplicates.extras(found).collect()] == ["/r/a.txt"]
    assert duplicates.groups(found).first().wasted == 3
    assert duplicates.prune(found, spark.createDataFrame([("/r/a.txt",)], "path string")).count() == 0


def test_near_hashes(spark):
    base = 0xABCD << 48
    flip = lambda n, start=0: f"{base ^ sum(1 << (start + i) for i in range(n)):016x}"
    rows = [(1, flip(0)), (2, flip(8)), (3, flip(16)), (4, f"{(0xFFFF << 48):016x}"), (5, f"{(0xFFFF << 48) ^ (1 << 60):016x}"), (6, flip(9, 30))]
    files = _files(spark, [(i, f"/p/{i}.jpg", 1, float(i), "/p", None, h) for i, h in rows])
    edges = {(r.a, r.b): r.distance for r in duplicates.near_edges(files).collect()}
    assert edges == {(1, 2): 8, (2, 3): 8}
    assert sorted(r.id for r in duplicates.near_look(files).collect()) == [1, 2, 3]


def test_large_lists_are_left_out_only_where_asked(spark):
    files = _files(spark, [(i, f"/p/{i}.jpg", 1, float(i), "/p", None, f"abcd{i:012x}") for i in range(81)])
    assert duplicates.near_edges(files, most=80).count() == 0
    assert duplicates.near_edges(files).count() == sum((i ^ j).bit_count() <= 8 for j in range(81) for i in range(j))


def test_contained_groups_go(spark):
    rows = [(1, "/r/a.txt", 3, 1.0, "/r", "same text that is long enough", None), (2, "/r/a (1).txt", 3, 2.0, "/r", "same text that is long enough", None), (3, "/r/b.md", 9, 2.0, "/r", "same  text that is LONG enough", None)]
    found = duplicates.report(_files(spark, rows), documents=True)
    assert sorted((r.kind, r.reason, r.id) for r in found.collect()) == [("exact", "", 1), ("exact", "", 2), ("similar_document", "content", 1), ("similar_document", "content", 2), ("similar_document", "content", 3)]


def _sequential(plan, existing):
    used, out = set(existing), []
    for dest in plan:
        folder, name = dest.rsplit("/", 1)
        m = re.match(r"^(.+)(\.[^.]+)$", name)
        stem, ext = (m[1], m[2]) if m else (name, "")
        final, k = dest, 0
        while final in used:
            k += 1
            final = f"{folder}/{stem}_{k}{ext}"
        used.add(final)
        out.append(final)
    return out


def test_unique_names_equal_the_sequential_rule(spark):
    rng = random.Random(3)
    pool = ["a.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg", "foo.", "foo._1", "b", "b_1", ".x", "c.tar.gz", "c.tar_1.gz"]
    dests = [f"/d/{rng.choice('xy')}/{rng.choice(pool)}" for _ in range(300)]
    existing = sorted({f"/d/x/{rng.choice(pool)}" for _ in range(4)})
    plan = spark.createDataFrame([(i, i, d) for i, d in enumerate(dests)], "ord long, id long, destination string")
    for taken in ([], existing):
        have = spark.createDataFrame([(t,) for t in taken], "destination string")
        for n in (1, 7):
            got = [r.final_destination for r in naming.unique_names(plan.repartition(n), have).orderBy("ord").collect()]
            assert got == _sequential(dests, taken)


def test_custom_rules(spark):
    text = "# note\n\n- a = b\nPhotos = X/{year}\nPhotos = Y/{month}/\n* = Rest/{name}\nTree/\n = z"
    rules = layout.parse_rules(spark.createDataFrame([(1, text)], "owner int, rules string"))
    assert {r.category: r.template for r in rules.collect()} == {"Photos": "Y/{month}", "*": "Rest/{name}"}
    files = _files(spark, [(1, "/r/a.jpg", 1, 0.0, "/r", None, None), (2, "/r/b?.pdf", 1, 0.0, "/r", None, None)])
    options = layout.LayoutOptions(as_of=0.0, rules_text=text)
    got = {r.id: r.destination for r in layout.plan(files, ["custom"], "/d", options).collect()}
    assert got == {1: "/d/Y/01/a.jpg", 2: "/d/Rest/b?.pdf"}


def test_unsafe_template_is_skipped(spark):
    files = _files(spark, [(1, "/r/a.jpg", 1, 0.0, "/r", None, None)])
    row = layout.plan(files, ["custom"], "/d", layout.LayoutOptions(as_of=0.0, rules_text="* = ../x")).first()
    assert row.destination is None and row.skip_reason == "leaves destination"


def test_skip_reasons(spark):
    rows = [(1, "/d/x/a.jpg", 1, 0.0, "/r", None, None), (2, f"/r/{names.QUARANTINE}/s/b.jpg", 1, 0.0, "/r", None, None), (3, "/r/c.jpg", 1, 0.0, "/r", None, None), (4, "/r/d.jpg", 1, 0.0, "/r", None, None)]
    present = spark.createDataFrame([("/r/d.jpg",)], "path string")
    got = {r.id: r.skip_reason for r in layout.plan(_files(spark, rows), ["by_type"], "/d", layout.LayoutOptions(as_of=0.0), present=present).collect()}
    assert got == {1: "already under destination", 2: "in quarantine", 3: "missing", 4: None}


def test_age_limit_is_strict(spark):
    day = 86400.0
    rows = [(i, f"/r/{i}.bin", 1, 1000 * day - age * day, "/r", None, None) for i, age in enumerate((364.9, 365.0, 365.1))]
    got = [r.destination for r in layout.plan(_files(spark, rows), ["active_archive"], "/d", layout.LayoutOptions(as_of=1000 * day)).orderBy("id").collect()]
    assert got == ["/d/Active/Other/0.bin", "/d/Active/Other/1.bin", "/d/Archive/Other/2.bin"]


def test_cache_takes_nearest(spark):
    files = _files(spark, [(1, "/a", 1, 10.0, "/", None, None)])
    cache = spark.createDataFrame([("/a", 1, 10.00005, "h1"), ("/a", 1, 11.0, "h2")], "path string, size long, modified double, hash_value string")
    assert index.cache_hits(files, cache).first().hash_value == "h1"
    new = spark.createDataFrame([("/a", 1, 11.0, "h3")], "path string, size long, modified double, hash_value string")
    assert sorted(r.hash_value for r in index.cache_upsert(cache, new).collect()) == ["h1", "h3"]


def test_listing_and_zip(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub" / ".git").mkdir(parents=True)
    (root / "sub" / "deep").mkdir()
    (root / "a.txt").write_text("hello")
    (root / "sub" / ".hidden").write_text("")
    (root / "sub" / ".git" / "x").write_text("x")
    os.symlink(root / "a.txt", root / "sub" / "link")
    with zipfile.ZipFile(root / "sub" / "deep" / "z.zip", "w") as z:
        z.writestr("in/one.txt", "one")
        z.writestr("dir/", "")
    (root / "bad.zip").write_bytes(b"no zip")
    listing.register(spark)
    rows = spark.read.format("file_listing").option("roots", f"{root},{tmp_path}/none").load()
    got = {(os.path.relpath(r.path, tmp_path), r.outcome) for r in rows.collect()}
    assert got == {("root/a.txt", "file"), ("root/bad.zip", "file"), ("root/sub/.hidden", "file"), ("root/sub/link", "symlink"), ("root/sub/deep/z.zip", "file"), ("none", "missing")}
    zips = rows.where("endswith(path, '.zip')")
    members = {(os.path.basename(r.archive_container), r.archive_member, r.size, r.outcome) for r in archives.zip_members(zips).collect()}
    assert members == {("z.zip", "in/one.txt", 3, "file"), ("bad.zip", None, None, "unreadable")}
    ids = rows.where("outcome = 'file' and endswith(path, 'a.txt')").withColumn("id", F.lit(1).cast("long"))
    assert archives.digests_by_path(ids, "crc32").first().digest == "crc32:5:3610a686"


def test_partitions_do_not_matter(spark, sf_dir):
    from cartulary.sources import fixtures

    files = fixtures.files_docs(spark, sf_dir)
    results = [sorted((r.gid, r.id, r.keep_rank) for r in duplicates.exact(files.repartition(n)).select("gid", "id", "keep_rank").collect()) for n in (1, 7, 50)]
    assert results[0] == results[1] == results[2]


def test_member_copies_and_marks(spark):
    from cartulary.functions import contents
    from cartulary.operators import duplicates
    from cartulary.schema import as_files

    files = as_files(spark.createDataFrame([(1, "/v/a.txt", 3, 1.0, "abc"), (2, "/v/b.txt", 3, 2.0, None), (3, "/v/c.txt", 0, 3.0, None)], "id long, path string, size long, modified double, content string"))
    crc = spark.range(1).select(contents.F.crc32(contents.F.lit("abc").cast("binary"))).first()[0]
    members = as_files(
        spark.createDataFrame(
            [(9, "/v/z.zip", "/v/z.zip", "in.txt", 3, 0.5, crc), (10, "/v/z.zip", "/v/z.zip", "no.txt", 3, 0.5, None)],
            "id long, path string, archive_container string, archive_member string, size long, modified double, zip_crc long",
        )
    )
    found = duplicates.exact_with_members(files, members)
    assert [(r["id"], r["keep_rank"]) for r in found.orderBy("keep_rank").collect()] == [(9, 0), (1, 1)]
    marks = spark.createDataFrame([("/v/a.txt",), ("/v/a.txt",), ("/v/z.zip",), ("/v/none",)], "path string")
    assert [r["path"] for r in duplicates.marked_files(found, marks).collect()] == ["/v/a.txt"]


def test_members_with_equal_checksums_are_judged_by_their_content(spark):
    from cartulary.operators import duplicates
    from cartulary.schema import as_files

    files = as_files(spark.createDataFrame([(1, "/v/a.txt", 8, 1.0, "plumless"), (2, "/v/b.txt", 0, 2.0, None)], "id long, path string, size long, modified double, content string"))
    inner = [(9, "in.txt", 8, 0.5, "buckeroo"), (10, "also.txt", 8, 0.5, "buckeroo"), (11, "more.txt", 8, 0.6, "plumless"), (12, "null.txt", 0, 0.7, None)]
    members = spark.createDataFrame(inner, "id long, archive_member string, size long, modified double, content string").selectExpr(
        "*", "'/v/z.zip' path", "'/v/z.zip' archive_container", "crc32(cast(content as binary)) zip_crc"
    )
    assert members.where("content is not null").select("zip_crc").distinct().count() == 1
    found = duplicates.exact_with_members(files, as_files(members)).collect()
    assert len({r["gid"] for r in found}) == 2
    assert sorted((r["id"], r["keep_rank"]) for r in found) == [(1, 1), (9, 1), (10, 0), (11, 0)]


def test_two_phase_digest_nulls(spark):
    from cartulary.operators import duplicates

    rows = spark.createDataFrame([(1, 9, "123456789"), (2, 9, "1234zzzzz"), (3, 9, "9999zzzzz"), (4, None, None), (5, 2, "ab")], "id long, size long, content string")
    got = {r["id"]: r["digest"] for r in duplicates.two_phase_digest(rows, 4).collect()}
    assert got[1] and got[2] and got[1] != got[2] and got[3] is None and got[4] is None and got[5]


def test_two_phase_digest_counts_characters_of_text_and_bytes_of_others(spark):
    from cartulary.operators import duplicates

    rows = spark.createDataFrame([(1, 9, "éé34xxxxx"), (2, 9, "éé39yyyyy"), (3, 9, "plumlessA"), (4, 9, "buckerooB")], "id long, size long, content string")
    assert {r["id"] for r in duplicates.two_phase_digest(rows, 4).where("digest is not null").collect()} == set()
    assert {r["id"] for r in duplicates.two_phase_digest(rows, 3).where("digest is not null").collect()} == {1, 2}
    # equal CRC-32 of the first 8
    assert {r["id"] for r in duplicates.two_phase_digest(rows, 8).where("digest is not null").collect()} == set()
    raw = rows.withColumn("content", rows["content"].cast("binary"))
    assert {r["id"] for r in duplicates.two_phase_digest(raw, 5).where("digest is not null").collect()} == {1, 2}


def test_listing_orders(spark):
    from cartulary.operators import layout

    tree = spark.createDataFrame([("b",), ("B/z",), ("a b",), ("a/Z",), ("a",)], "folder string")
    assert [r[0] for r in layout.tree_order(tree).collect()] == ["a", "a/Z", "a b", "b", "B/z"]
    kids = spark.createDataFrame([("a", "z", True, None), ("a", "B", False, "/x"), ("a", "a", False, "/y"), ("", "k", False, "/k")], "parent string, name string, is_dir boolean, source string")
    assert [r["name"] for r in layout.child_order(kids).collect()] == ["k", "z", "a", "B"]


def test_first_bytes_of_texts_and_others(spark):
    from cartulary.sources import archives

    rng = random.Random(6)
    rows = [b"", b"plain text\n", "caf\u00e9 \u65e5\u672c".encode(), "latin \xe9\xe8".encode("latin-1"), b"\0" * 3 + b"a" * 50, b"\0\0" + b"a" * 50, bytes(range(32)) * 9, rng.randbytes(5000), b"a" * 4000 + b"\0" * 4000]
    rows += [bytes(rng.choice([7, 65, 66, 10]) for _ in range(100)) for _ in range(20)] + [None]

    def plain(raw):
        raw = (raw or b"")[:4000]
        if raw.count(b"\0") > max(2, len(raw) // 50):
            return False
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
        return not text or sum(c.isprintable() or c in "\n\r\t" for c in text) >= 0.85 * len(text)

    got = archives.looks_like_text(spark.createDataFrame(list(enumerate(rows)), "id int, content binary"))
    assert {r.id: r.is_text for r in got.collect()} == {k: plain(r) for k, r in enumerate(rows)}


def test_member_caps(spark):
    members = spark.createDataFrame([(a * 100 + k, f"/z{a}.zip", f"m{k}", k, 1) for a in range(3) for k in range(10)], "id long, archive_container string, archive_member string, member_ord int, size long")
    assert [r.id for r in index.cap_members(members, 4, 6).collect()] == [0, 1, 2, 3, 100, 101]
    assert index.cap_members(members).count() == 30
