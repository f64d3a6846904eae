"""Digests of files by path, read in byte ranges.

A range is a row, and so a large file is many tasks. The CRC-32 of a file is the sum over GF(2) of its ranges' CRCs, each shifted by the bytes behind it, so the ranges
are combined by ``bit_xor`` in any order. Whole files are read only where size and first bytes repeat.

Files are opened by Arrow's file systems: plain paths, file://, hdfs://, s3:// and gs:// as far as the build has them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from cartulary.scratch import cut

#: The polynomial of CRC-32, lowest bit first (a fixed value).
POLYNOMIAL = 0xEDB88320
PREFIX = 8 << 20
RANGE = 64 << 20
BLOCK = 1 << 20


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo POLYNOMIAL; bit 31 is the power 0."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def shifted(crc: int, size: int) -> int:
    """What a CRC adds to that of the whole when ``size`` bytes follow."""
    power, step = 1 << 31, 1 << 23  # x ** 0, x ** 8
    while size:
        if size & 1:
            power = _times(power, step)
        step = _times(step, step)
        size >>= 1
    return _times(power, crc)


def _opened(path: str):
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return fs.LocalFileSystem().open_input_file(path)


def range_crcs(ranges: DataFrame) -> DataFrame:
    """Rows (path, size, start, length) with ``part`` (the shifted CRC of these bytes, a long) and ``error`` where they could not be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, errors = [], []
            for path, size, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start", "length")), strict=True):
                try:
                    crc, left = 0, length
                    with _opened(path) as source:
                        source.seek(start)
                        while left:
                            data = source.read(min(BLOCK, left))
                            if not data:
                                raise OSError(f"shorter than {size} bytes")
                            crc = zlib.crc32(data, crc)
                            left -= len(data)
                    parts.append(shifted(crc, size - start - length))
                    errors.append(None)
                except (OSError, pa.ArrowException) as e:
                    parts.append(None)
                    errors.append(str(e)[:200])
            columns = [*(batch.column(c) for c in ("path", "size", "start", "length")), pa.array(parts, pa.int64()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "size", "start", "length", "part", "error"])

    wanted = ranges.select("path", F.col("size").cast("long").alias("size"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))
    return wanted.mapInArrow(run, "path string, size long, start long, length long, part long, error string")


def whole_digests(files: DataFrame, range_bytes: int = RANGE, tasks: int | None = None) -> DataFrame:
    """path, size, digest (``crc32:<size>:<8 hex digits>``, null if unreadable), error, for files (path, size). Each path is read once."""
    once = files.where("path is not null and size is not null").groupBy("path").agg(F.max("size").alias("size"))
    last = F.greatest(F.ceil(F.col("size") / range_bytes) - 1, F.lit(0))
    starts = once.select("path", "size", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda k: k * range_bytes)).alias("start"))
    ranges = starts.withColumn("length", F.least(F.lit(range_bytes), F.col("size") - F.col("start")))
    dealt = ranges.repartition("path", "start") if tasks is None else ranges.repartition(tasks, "path", "start")
    read = range_crcs(dealt).groupBy("path", "size").agg(F.bit_xor("part").alias("_crc"), F.max("error").alias("error"))
    return read.select("path", "size", F.when(F.col("error").isNull(), F.format_string("crc32:%d:%08x", "size", "_crc")).alias("digest"), "error")


def two_phase_digests(files: DataFrame, prefix: int = PREFIX, range_bytes: int = RANGE) -> DataFrame:
    """path, size, digest of the files (path, size) that may have a copy: those whose size, and then size and first ``prefix`` bytes, another file has too.

    Others have a null digest; of those of a size of their own no byte is read, of those with first bytes of their own no further ones.
    """
    once = files.where("path is not null and size is not null").groupBy("path").agg(F.max("size").alias("size"))
    sizes = once.groupBy("size").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("size")
    some = once.join(sizes, "size", "left_semi").select("path", "size", F.lit(0).cast("long").alias("start"), F.least(F.col("size"), F.lit(prefix)).alias("length"))
    # behind a prefix of equal size the same number of bytes follows, so the shifted parts compare like the plain ones
    first = cut(range_crcs(some.repartition("path")).select("path", "size", F.col("part").alias("_first"), "error"), "prefixes")
    again = first.where("_first is not null").groupBy("size", "_first").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("size", "_first")
    alike = cut(first.join(again, ["size", "_first"], "left_semi").select("path", "size", "_first"), "alike")
    large = whole_digests(alike.where(F.col("size") > prefix), range_bytes).select("path", "digest", F.col("error").alias("_late"))
    small = alike.where(F.col("size") <= prefix).select("path", F.format_string("crc32:%d:%08x", "size", "_first").alias("digest"), F.lit(None).cast("string").alias("_late"))
    known = small.unionByName(large)
    return once.join(first.select("path", "error"), "path", "left").join(known, "path", "left").select("path", "size", "digest", F.coalesce("error", "_late").alias("error"))
