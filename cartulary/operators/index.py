"""The file index: reading, caps, caches, filters and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartulary.functions import names
from cartulary.scratch import cut


#: Members that are listed of one archive, and in all.
MEMBERS_PER_ARCHIVE, MEMBERS_IN_ALL = 5_000, 100_000


def cap_members(members: DataFrame, per_archive: int = MEMBERS_PER_ARCHIVE, total: int = MEMBERS_IN_ALL) -> DataFrame:
    """The first per_archive members of each archive, and of those the first total in scan order."""
    rank = F.row_number().over(Window.partitionBy("archive_container").orderBy("member_ord", "id"))
    return members.withColumn("_r", rank).where(F.col("_r") <= per_archive).drop("_r").orderBy("id", "member_ord").limit(total)


def capped_archives(members: DataFrame, per_archive: int) -> DataFrame:
    """archive_container, members, bytes, capped."""
    return members.groupBy("archive_container").agg(
        F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"), (F.count(F.lit(1)) > per_archive).alias("capped")
    )


def cache_hits(files: DataFrame, cache: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """files with hash_value from the cache where path and size agree and modified differs by less than tolerance."""
    known = cache.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("modified").alias("_m"), F.col("hash_value").alias("_h"))
    near = (F.col("path") == F.col("_p")) & (F.col("size") == F.col("_s")) & (F.abs(F.col("modified") - F.col("_m")) < tolerance)
    joined = files.join(known, near, "left")
    best = Window.partitionBy("id", "path").orderBy(F.abs(F.col("modified") - F.col("_m")).asc_nulls_last(), F.col("_h"))
    found = joined.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return found.withColumn("hash_value", F.coalesce("hash_value", "_h")).drop("_p", "_s", "_m", "_h", "_r")


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new's rows in place of rows of the same path, size and modified."""
    both = cache.select("path", "size", "modified", "hash_value", F.lit(0).alias("_g")).unionByName(new.select("path", "size", "modified", "hash_value", F.lit(1).alias("_g")))
    last = Window.partitionBy("path", "size", "modified").orderBy(F.desc("_g"), "hash_value")
    return both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_g")


def remove_paths(files: DataFrame, removed: DataFrame) -> DataFrame:
    return files.join(removed.select("path").distinct(), "path", "left_anti")


def rows_by_id(files: DataFrame, ids: DataFrame) -> DataFrame:
    return files.join(ids.select("id").distinct(), "id", "left_semi")


def first_rows(files: DataFrame, limit: int = 40) -> DataFrame:
    return files.orderBy("id").limit(limit)


def stride_sample(files: DataFrame, limit: int, per_range: int = 100_000) -> DataFrame:
    """Every (n div limit)-th row in id order, limit rows at most. Rows are numbered range by range, never all in one task."""
    ordered = cut(files.orderBy("id", "path").withColumn("_part", F.spark_partition_id()), "ordered")
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    number = F.col("_off") + F.row_number().over(Window.partitionBy("_part").orderBy("id", "path")) - 1
    step = F.greatest(F.lit(1).cast("long"), F.floor(total / limit))
    return ordered.join(offsets, "_part").withColumn("_i", number).where((F.col("_i") % step == 0) & (F.col("_i") < step * limit)).drop("_part", "_off", "_i")


def pruned(files: DataFrame, include_junk: bool = False) -> DataFrame:
    """files outside skipped folders below their root, with is_junk. The quarantine folder is always skipped."""
    relative = F.when(F.col("path").startswith(F.concat("source_root", F.lit("/"))), F.expr("substring(path, length(source_root) + 2)")).otherwise(F.col("path"))
    rows = files.withColumn("_rel", relative)
    if not include_junk:
        return rows.where(~names.in_junk_folder(F.col("_rel"))).withColumn("is_junk", F.lit(False)).drop("_rel")
    junk = names.in_junk_folder(F.col("_rel")) | names.basename(F.col("path")).startswith(".")
    return rows.where(~names.in_quarantine(F.col("_rel"))).withColumn("is_junk", junk).drop("_rel")


def on_device(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files with ``cross_device``: their device differs from their root's (roots: source_root, root_device_id)."""
    return files.join(roots, "source_root", "left").withColumn("cross_device", ~F.col("device_id").eqNullSafe(F.col("root_device_id")) & F.col("root_device_id").isNotNull())


def missing_roots(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """An error row for each requested root that is not there, is no folder or cannot be read."""
    good = available.where("is_dir and readable").select("source_root")
    state = available.select("source_root", F.when(~F.col("is_dir"), "not a folder").otherwise("not readable").alias("error"))
    return wanted.join(good, "source_root", "left_anti").join(state, "source_root", "left").select("source_root", F.coalesce("error", F.lit("missing")).alias("error"))


def is_photo(name: Column, category: Column) -> Column:
    return (category == "Photos") | F.lower(names.suffix(name)).isin(*[f".{e}" for e in names.EXTENSIONS["Photos"]])


def is_document(name: Column, category: Column) -> Column:
    return (category == "Documents") | F.lower(names.suffix(name)).isin(*[f".{e}" for e in names.EXTENSIONS["Documents"]])


def disk_only(files: DataFrame) -> DataFrame:
    return files.where("archive_container is null")


def destination_conflicts(destinations: DataFrame, sources: DataFrame) -> DataFrame:
    """(destination, source) where the destination is a source or lies under one.

    Each destination is expanded into its own ancestors and joined by equality, so no prefix comparison of all pairs is needed.
    """
    parts = F.split("destination", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    steps = destinations.select("destination", F.explode(above).alias("_a"))
    return steps.join(sources.select("source").distinct(), F.col("_a") == F.col("source")).select("destination", "source")


def prefer_extracted(members: DataFrame, files: DataFrame) -> DataFrame:
    """Members of archives that have no unpacked sibling folder (``<stem>_unzipped``, or with a number) among the files' folders."""
    folder = names.parent(F.col("path"))
    base = F.regexp_replace(folder, r"_\d+$", "")
    folders = files.select(F.explode(F.array(folder, base)).alias("_f")).distinct()
    target = F.concat(names.parent(F.col("archive_container")), F.lit("/"), names.unzipped_name(names.basename(F.col("archive_container"))))
    return members.withColumn("_f", target).join(folders, "_f", "left_anti").drop("_f")


def totals(files: DataFrame) -> DataFrame:
    """n_files, total_bytes (archives and their members both), disk_bytes, disk_files, archive_members."""
    disk = F.col("archive_container").isNull()
    return files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when(disk, F.col("size"))), F.lit(0)).alias("disk_bytes"),
        F.count_if(disk).alias("disk_files"),
        F.count_if(~disk).alias("archive_members"),
    )


def category_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


def default_categories(files: DataFrame) -> DataFrame:
    """source_root, category, n_files of the categories that a plan takes when none are chosen: those with a file."""
    return files.where("category is not null").groupBy("source_root", "category").agg(F.count(F.lit(1)).alias("n_files"))


def in_categories(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """files whose (source_root, category) is chosen."""
    return files.join(chosen.select("source_root", "category").distinct(), ["source_root", "category"], "left_semi")


def scan_counters(outcomes: DataFrame) -> DataFrame:
    """Rows by outcome of a listing. Counted from the table, so that a task run again counts once."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def same_size(files: DataFrame) -> DataFrame:
    """Files whose size another file has too: the only ones whose content needs reading."""
    sizes = files.groupBy("size").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("size")
    return files.join(sizes, "size", "left_semi")


def action_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def large_library(files: DataFrame, documents: int = 5000, photos: int = 3000) -> DataFrame:
    """A row for each category whose similarity search will be long."""
    limits = F.when(F.col("category") == "Documents", documents).when(F.col("category") == "Photos", photos)
    return category_counts(files).select("category", "n_files", limits.alias("limit")).where("n_files > limit")


def expansion_space(archives: DataFrame, volumes: DataFrame) -> DataFrame:
    """archive_container, bytes, needed, free_bytes, low. Unknown free space is not low."""
    from cartulary.functions.formats import needed_to_expand

    rows = archives.join(volumes, "volume", "left").withColumn("needed", needed_to_expand(F.col("bytes")))
    return rows.select("archive_container", "bytes", "needed", "free_bytes", F.coalesce(F.col("free_bytes") < F.col("needed"), F.lit(False)).alias("low"))
