"""The files table: one row for each file or archive member."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from cartulary.functions import names

FILES = StructType(
    [
        StructField("id", LongType()),
        StructField("path", StringType()),
        StructField("size", LongType()),
        StructField("modified", DoubleType()),
        StructField("category", StringType()),
        StructField("source_root", StringType()),
        StructField("archive_container", StringType()),
        StructField("archive_member", StringType()),
        StructField("zip_crc", LongType()),
        StructField("is_junk", BooleanType()),
        StructField("hash_value", StringType()),
        StructField("visual_hash", StringType()),
        StructField("content_fingerprint", StringType()),
    ]
)


def as_files(listing: DataFrame) -> DataFrame:
    """A listing (id, path, size, modified, source_root and any other column of FILES) as the files table, with ``content`` if it is there."""
    have = set(listing.columns)
    base = listing.withColumn("_name", names.basename(F.coalesce(F.col("archive_member"), F.col("path")) if "archive_member" in have else F.col("path")))
    base = base.withColumn("_ext", F.lower(F.substring(names.suffix(F.col("_name")), 2, 1000)))
    made = {"category": names.category_of(F.col("_ext")), "is_junk": F.lit(False), "source_root": F.lit("")}
    columns = [F.col(f.name) if f.name in have else made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FILES]
    return base.select(*columns, *[c for c in ("content",) if c in have])
