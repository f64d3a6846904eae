import random
import zlib

from hypothesis import given, settings, strategies as st

from cartulary.sources import digests


@given(st.binary(max_size=300), st.binary(max_size=300))
@settings(max_examples=200, deadline=None)
def test_parts_add_up(a, b):
    assert digests.shifted(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def _files(spark, folder, contents):
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    return spark.createDataFrame([(f"{'file://' if k % 2 else ''}{folder}/{n}", len(d)) for k, (n, d) in enumerate(contents.items())], "path string, size long")


def test_whole_digests_by_ranges(spark, tmp_path):
    rng = random.Random(3)
    contents = {f"f{k}": rng.randbytes(n) for k, n in enumerate([0, 1, 999, 1000, 1001, 25_000, 70_001])}
    files = _files(spark, tmp_path, contents)
    got = {r.path.rsplit("/", 1)[1]: (r.digest, r.error) for r in digests.whole_digests(files, range_bytes=1000).collect()}
    assert got == {n: (f"crc32:{len(d)}:{zlib.crc32(d):08x}", None) for n, d in contents.items()}


def test_large_files_are_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    files = _files(spark, tmp_path, {"large": bytes(range(256)) * 4000})
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1_023_000).cast("long"), F.lit(1000).cast("long"))).alias("start")).withColumn("length", F.lit(1000))
    spread = digests.range_crcs(ranges.repartition(8, "path", "start")).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 400
    assert digests.whole_digests(files, range_bytes=1000, tasks=8).first().digest == f"crc32:1024000:{zlib.crc32(bytes(range(256)) * 4000):08x}"


def test_only_what_repeats_is_read_whole(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    head, tail = rng.randbytes(1000), rng.randbytes(5000)
    contents = {
        "a": head + tail, "b": head + tail, "other_tail": head + rng.randbytes(5000), "other_head": rng.randbytes(6000), "own_size": rng.randbytes(6001),
        "small": b"xyz", "small_too": b"xyz", "small_else": b"xyw", "empty": b"", "empty_too": b"",
    }
    files = _files(spark, tmp_path, contents).unionByName(spark.createDataFrame([(f"{tmp_path}/gone", 6000), (None, 3)], "path string, size long"))
    asked = []
    whole = digests.whole_digests
    monkeypatch.setattr(digests, "whole_digests", lambda rows, n: asked.extend(r.path.rsplit("/", 1)[1] for r in rows.collect()) or whole(rows, n))
    rows = {r.path.rsplit("/", 1)[1]: r for r in digests.two_phase_digests(files, prefix=1000, range_bytes=700).collect()}
    assert sorted(asked) == ["a", "b", "other_tail"]
    want = {n: f"crc32:{len(d)}:{zlib.crc32(d):08x}" for n, d in contents.items() if n not in ("other_head", "own_size", "small_else")}
    assert {n: r.digest for n, r in rows.items() if r.digest} == want
    assert rows["gone"].error and not any(r.error for n, r in rows.items() if n != "gone")
