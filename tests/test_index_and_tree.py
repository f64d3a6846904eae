import os

import pytest
from pyspark.sql import functions as F

from cartulary.operators import report
from cartulary.schema import as_files
from cartulary.sources import listing


def _index(spark, rows):
    return as_files(spark.createDataFrame(rows, "id long, path string, size long, modified double, source_root string"))


def test_index_versions(spark, tmp_path):
    path = f"{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        report.read_index(spark, path)
    seen = lambda: sorted((r.id, r.source_root, r.size) for r in report.read_index(spark, path).collect())
    report.write_index(_index(spark, [(1, "/a/x.txt", 1, 0.0, "/a"), (2, "/b/y.txt", 2, 0.0, "/b"), (3, "/007/z", 3, 0.0, "7")]), path)
    assert seen() == [(1, "/a", 1), (2, "/b", 2), (3, "7", 3)]
    report.upsert_index(_index(spark, [(4, "/b/new.txt", 9, 0.0, "/b"), (5, "/c/c.txt", 5, 0.0, "/c")]), path)
    assert seen() == [(1, "/a", 1), (3, "7", 3), (4, "/b", 9), (5, "/c", 5)]
    # half a write: folders and even the table of versions, but no marker
    _index(spark, [(6, "/a/half.txt", 6, 0.0, "/a")]).withColumn("version", F.lit("half")).write.mode("append").partitionBy("version", "source_root").parquet(f"{path}/files")
    spark.createDataFrame([("/a", "half")], "source_root string, version string").write.parquet(f"{path}/versions/half")
    assert seen() == [(1, "/a", 1), (3, "7", 3), (4, "/b", 9), (5, "/c", 5)]
    report.write_index(_index(spark, [(7, "/z/only.txt", 7, 0.0, "/z")]), path)
    assert seen() == [(7, "/z", 7)]


def test_tree_level_by_level(spark, tmp_path):
    deep = tmp_path / "root" / "only" / "one"
    for k in range(40):
        inner = deep / f"d{k}" / "e"
        inner.mkdir(parents=True)
        (inner / "f.txt").write_text("x" * k)
    (deep / ".hidden").mkdir()
    (deep / ".hidden" / "no.txt").write_text("no")
    (tmp_path / "root" / "top.txt").write_text("top")
    os.symlink(deep / "d1" / "e" / "f.txt", deep / "link.txt")
    roots = [str(tmp_path / "root"), str(tmp_path / "gone")]
    listing.register(spark)
    for junk in (False, True):
        walked = spark.read.format("file_listing").option("roots", ",".join(roots)).option("include_junk", str(junk).lower()).load()
        rows = listing.list_tree(spark, roots, junk)
        assert sorted(map(str, rows.collect())) == sorted(map(str, walked.collect()))
        assert rows.count() == 43 + junk
    # one root, one top folder: the folders of a level are dealt over the cores
    tasks = listing.list_tree(spark, roots[:1], tasks=8).where("path like '%/e/f.txt'").select(F.input_file_name().alias("f")).distinct().count()
    assert tasks >= 4
