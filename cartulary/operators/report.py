"""Reports and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from cartulary.functions import formats, names
from cartulary.operators import index


def inventory_lines(files: DataFrame) -> DataFrame:
    """line, with the keys that order it."""
    line = F.concat_ws(" | ", "path", "category", formats.human_bytes(F.col("size")), F.date_format(F.timestamp_seconds("modified"), "yyyy-MM-dd HH:mm:ss"))
    return files.select(F.lower("path").alias("sort_path"), "id", line.alias("line"))


def save_inventory(files: DataFrame, path: str) -> None:
    inventory_lines(files).orderBy("sort_path", "id").select("line").write.mode("overwrite").text(path)


def overview(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(section, key, value) of totals, categories and scan counters."""
    sums = index.totals(files).select(F.explode(F.create_map(*[x for c in ("n_files", "total_bytes", "disk_bytes", "disk_files", "archive_members") for x in (F.lit(c), F.col(c))])).alias("key", "value"))
    parts = [
        sums.select(F.lit("totals").alias("section"), "key", "value"),
        index.category_counts(files).select(F.lit("category").alias("section"), F.col("category").alias("key"), F.col("n_files").alias("value")),
        index.scan_counters(outcomes).select(F.lit("scan").alias("section"), F.col("outcome").alias("key"), F.col("n").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def file_cards(files: DataFrame) -> DataFrame:
    """name, extension, size, time, folder and short digest of each file."""
    name = names.basename(F.coalesce("archive_member", "path"))
    return files.select(
        "id", name.alias("name"), F.lower(names.suffix(name)).alias("extension"), formats.human_bytes(F.col("size")).alias("shown_size"),
        F.date_format(F.timestamp_seconds("modified"), "yyyy-MM-dd HH:mm").alias("shown_time"), names.parent(F.col("path")).alias("folder"), F.substring("hash_value", 1, 16).alias("short_hash"),
    )


def _hadoop(spark, path: str):
    """Hadoop's file context, paths and file system for a path: whatever store it is in."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, where, where.getFileSystem(conf)


def _switch(spark, path: str, version: str) -> None:
    """Make a version the current one: the marker is written beside and renamed over the old one, so readers see the one or the other."""
    jvm, conf, _, store = _hadoop(spark, path)
    beside, marker = jvm.org.apache.hadoop.fs.Path(f"{path}/.{version}"), jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    out = store.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf).rename(store.makeQualified(beside), store.makeQualified(marker), overwrite)


def _current(spark, path: str) -> str | None:
    jvm, _, _, store = _hadoop(spark, path)
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    if not store.exists(marker):
        return None
    source = store.open(marker)
    try:
        return bytes(b & 255 for b in source.readNBytes(64)).decode()
    finally:
        source.close()


def _put(files: DataFrame, path: str, kept: DataFrame | None) -> None:
    """Write files as a new version's folders by source root, then the table that says which root is read from which version, then the marker."""
    version = uuid.uuid4().hex
    files.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "source_root").parquet(f"{path}/files")
    spark = files.sparkSession
    roots = spark.read.parquet(f"{path}/files").where(F.col("version") == version).select(F.col("source_root").cast("string").alias("source_root")).distinct().withColumn("version", F.lit(version))
    if kept is not None:
        roots = roots.unionByName(kept.join(roots, "source_root", "left_anti"))
    roots.write.parquet(f"{path}/versions/{version}")
    _switch(spark, path, version)


def write_index(files: DataFrame, path: str) -> None:
    """A fresh index in place of the old one, by source root. Until the marker is renamed readers have the old one whole."""
    _put(files, path, None)


def upsert_index(files: DataFrame, path: str) -> None:
    """The rows of files in place of those of their source roots; other roots stay as they are and aren't read or written."""
    spark = files.sparkSession
    version = _current(spark, path)
    _put(files, path, spark.read.parquet(f"{path}/versions/{version}") if version else None)


def read_index(spark, path: str) -> DataFrame:
    """The current version. Folders that no finished write named are not seen; which folders are read is pruned by root and version."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no index in {path}")
    roots = spark.read.parquet(f"{path}/versions/{version}")
    return spark.read.parquet(f"{path}/files").withColumn("source_root", F.col("source_root").cast("string")).join(roots, ["version", "source_root"], "left_semi").drop("version")


def write_meta(spark, values: dict[str, str], path: str) -> None:
    """Scan metadata as a one-row table of a map; keys given again replace the old ones."""
    old = {}
    try:
        old = spark.read.parquet(path).first()["meta"]
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    spark.createDataFrame([({**old, **values},)], "meta map<string,string>").write.mode("overwrite").parquet(path)


def read_meta(spark, path: str, key: str, default: str | None = None) -> str | None:
    return spark.read.parquet(path).first()["meta"].get(key, default)


def write_manifest(manifest: DataFrame, root: str, session: str) -> None:
    manifest.write.mode("errorifexists").json(f"{root}/{session}/manifest")
