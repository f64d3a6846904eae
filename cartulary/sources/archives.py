"""Members of zip archives, from the archives' directories; and file contents read by path."""

from __future__ import annotations

import calendar
import hashlib
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MEMBER_SCHEMA = "archive_container string, archive_member string, member_ord long, size long, modified double, zip_crc long, outcome string"
CHUNK = 4 << 20


def zip_members(archives: DataFrame) -> DataFrame:
    """One row a member of the archives (path, modified); an archive that can't be read gives one row with outcome ``unreadable``.

    Only the directory at the archive's end is read. A member's invalid date becomes the archive's.
    """
    names = [part.split()[0] for part in MEMBER_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, modified in zip(batch.column("path").to_pylist(), batch.column("modified").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(path) as z:
                        for k, m in enumerate(z.infolist()):
                            if m.is_dir():
                                continue
                            try:
                                when = float(calendar.timegm((*m.date_time, 0, 0, 0)))
                                calendar.datetime.datetime(*m.date_time)
                            except (ValueError, OverflowError):
                                when = modified
                            out.append((path, m.filename, k, m.file_size, when, m.CRC, "file"))
                except (OSError, zipfile.BadZipFile):
                    out.append((path, None, None, None, modified, None, "unreadable"))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return archives.select("path", F.col("modified").cast("double").alias("modified")).mapInArrow(run, MEMBER_SCHEMA)


def digests_by_path(files: DataFrame, algo: str = "sha256", limit: int | None = None) -> DataFrame:
    """id, digest of files read in pieces of 4 MiB; null where a file can't be read. limit: only the first bytes (for a first pass)."""
    kind = files.schema["id"].dataType.simpleString()

    def digest(path: str) -> str | None:
        crc, sha, size, left = 0, hashlib.sha256(), 0, limit
        try:
            with open(path, "rb") as f:
                while (left is None or left > 0) and (data := f.read(CHUNK if left is None else min(CHUNK, left))):
                    size += len(data)
                    crc = zlib.crc32(data, crc)
                    sha.update(data)
                    left = None if left is None else left - len(data)
        except OSError:
            return None
        return f"crc32:{size}:{crc:08x}" if algo == "crc32" else sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([digest(p) for p in batch.column("path").to_pylist()], pa.string())], names=["id", "digest"])

    return files.select("id", "path").mapInArrow(run, f"id {kind}, digest string")


def read_texts(spark, path: str, largest: int | None = None, characters: int | None = None) -> DataFrame:
    """path, text of plain text files: their bytes as UTF-8 without what isn't, whole unless cut to ``largest`` bytes or ``characters``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b[:largest].decode("utf-8", "ignore")[:characters] for b in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,csv,rtf,log}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, text string")


def looks_like_text(rows: DataFrame, content: str = "content", head: int = 4000) -> DataFrame:
    """rows with is_text: few NULs among the first bytes and 85 % printable characters."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def sniff(data):
        def one(raw) -> bool:
            raw = bytes(raw or b"")[:head]
            if raw.count(0) > max(2, len(raw) // 50):
                return False
            if not raw:
                return True
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = raw.decode("latin-1")
            return sum(c.isprintable() or c in "\n\r\t" for c in text) / len(text) >= 0.85

        return data.map(one)

    return rows.withColumn("is_text", sniff(F.col(content)))


def image_grids(spark, path: str, side: int = 8) -> DataFrame:
    """path, grid: images as side * side grey means, for average hashes. Images that can't be decoded are left out."""
    import numpy as np
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def grid(data, height, width, channels):
        def one(raw, h, w, c):
            pixels = np.frombuffer(raw, dtype=np.uint8).reshape(h, w, c)[:, :, :3].astype(float)
            grey = pixels[:, :, 0] if c == 1 else pixels @ np.array([0.114, 0.587, 0.299])
            rows = np.array_split(np.arange(h), side) if h >= side else [np.array([i * h // side]) for i in range(side)]
            cols = np.array_split(np.arange(w), side) if w >= side else [np.array([i * w // side]) for i in range(side)]
            return [float(grey[np.ix_(r, k)].mean()) for r in rows for k in cols]

        return data.combine(height, lambda a, b: (a, b)).combine(width, lambda a, b: (*a, b)).combine(channels, lambda a, b: one(*a, b))

    images = spark.read.format("image").option("dropInvalid", "true").load(path)
    return images.select(F.col("image.origin").alias("path"), grid("image.data", "image.height", "image.width", "image.nChannels").alias("grid"))
