import zlib

import pytest
from pyspark.sql import functions as F

from cartulary.functions import contents, formats, names

#: Name, normalised, sanitised.
NAMES = [
    ("IMG_001 (1).JPG", "img001", "IMG_001 (1).jpg"),
    ("credit.pdf", "cr", "credit.pdf"),
    ("photocopy.png", "photo", "photocopy.png"),
    ("x copy (1).txt", "x", "x copy (1).txt"),
    ("x (1) copy.txt", "x1", "x (1) copy.txt"),
    ("café_final2.docx", "caf", "café_final2.docx"),
    ("report - Copy.docx", "report", "report - Copy.docx"),
    ("副本.txt", "", "副本.txt"),
    ("a\u00a0copy.txt", "a", "a\u00a0copy.txt"),
    (".bashrc", "bashrc", "bashrc"),
    (".jpg", "jpg", "jpg"),
    ("a.tar.gz", "atar", "a.tar.gz"),
    ("foo.", "foo", "foo"),
    ("foo..jpg", "foo", "foo.jpg"),
    ("..x", "", "file.x"),
    ("__.txt", "", "file.txt"),
    ("bad<na>me?.TXT", "badname", "bad_na_me.txt"),
]


def test_names(spark):
    rows = spark.createDataFrame([(n,) for n, _, _ in NAMES], "n string").select("n", names.normalised(F.col("n")).alias("x"), names.sanitised(F.col("n")).alias("y")).collect()
    assert [(r.n, r.x, r.y) for r in rows] == NAMES


def test_categories(spark):
    rows = spark.createDataFrame([("a.JPG",), ("b.mkv",), ("c",), (".zip",), ("d.tar.gz",), ("e.Md",)], "n string").select(names.category(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["Photos", "Videos", "Other", "Other", "Archives", "Documents"]


@pytest.mark.parametrize(("size", "shown"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1048576, "1.0 MB"), (10**18, "909494.7 TB")])
def test_bytes(spark, size, shown):
    assert spark.range(1).select(formats.human_bytes(F.lit(size).cast("long"))).first()[0] == shown


@pytest.mark.parametrize(("seconds", "shown"), [(-1.0, "0.0s"), (0.25, "0.2s"), (0.99, "1.0s"), (1.0, "1s"), (2.5, "2s"), (59.5, "1m 00s"), (185.0, "3m 05s"), (3599.5, "1h 00m 00s"), (3723.0, "1h 02m 03s")])
def test_durations(spark, seconds, shown):
    assert spark.range(1).select(formats.human_duration(F.lit(seconds))).first()[0] == shown


def test_digests(spark):
    rows = spark.createDataFrame([(b"", 0), (b"abc", 3)], "c binary, n long").select(contents.content_digest(F.col("c"), F.col("n"), "crc32").alias("d")).collect()
    assert [r.d for r in rows] == ["crc32:0:00000000", f"crc32:3:{zlib.crc32(b'abc'):08x}"]


def test_hamming(spark):
    rows = [("00000000000000ff", "0000000000000000"), ("f" * 16, "0" * 16), (None, "0" * 16), ("xyz", "000"), ("00", "000")]
    out = spark.createDataFrame(rows, "a string, b string").select(contents.hamming(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in out] == [8, 64, 999, 999, 999]


def test_unsafe_members(spark):
    rows = ["../x", "/abs/x", "C:/x", "a\\..\\b", "dir/", "", "ok/a.txt"]
    out = spark.createDataFrame([(r,) for r in rows], "m string").select(names.unsafe_member(F.col("m"))).collect()
    assert [r[0] for r in out] == [True, False, True, True, True, True, False]


def test_unzipped_names(spark):
    out = spark.createDataFrame([("Trip.zip",), (".zip",), ("..a.zip",)], "n string").select(names.unzipped_name(F.col("n"))).collect()
    assert [r[0] for r in out] == ["Trip_unzipped", "archive_unzipped", "a_unzipped"]


def test_grid_hash(spark):
    grid = [float(i) for i in range(64)]
    got = spark.createDataFrame([(grid,)], "g array<double>").select(contents.average_hash(F.col("g"))).first()[0]
    assert got == f"{sum(1 << i for i in range(64) if i >= 31.5):016x}"
