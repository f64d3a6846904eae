"""Files of a directory tree: ``list_tree``, or as a Spark data source ``spark.read.format("file_listing").option("roots", "/a,/b")``.

``list_tree`` widens a frontier of folders level by level: a level's folders are dealt over all tasks, so one deep root occupies the whole cluster as soon as a level
has many folders. In the data source each top folder of each root is a partition, walked by one task; the root's own files are one more. The usual binary source isn't used because it leaves out
hidden names and empty files. The roots must be seen by all executors under the same path.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartulary.functions.names import JUNK_FOLDERS, QUARANTINE
from cartulary.scratch import cut

SCHEMA = "path string, size long, modified double, source_root string, device_id long, root_device_id long, outcome string"


def skipped(name: str, include_junk: bool) -> bool:
    if name == QUARANTINE:
        return True
    return not include_junk and (name in JUNK_FOLDERS or name.startswith("."))


def entries(folder: str, root: str, device: int | None, include_junk: bool) -> tuple[list[tuple], list[str]]:
    """The rows of a folder's own entries, and the folders in it that are to be listed."""
    rows, inner = [], []
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return [(folder, None, None, root, None, device, "unreadable")], []
    for e in found:
        try:
            info = e.stat(follow_symlinks=False)
        except OSError:
            rows.append((e.path, None, None, root, None, device, "unreadable"))
            continue
        if stat.S_ISDIR(info.st_mode):
            if not skipped(e.name, include_junk):
                if info.st_dev == device:
                    inner.append(e.path)
                else:
                    rows.append((e.path, None, None, root, info.st_dev, device, "cross_device"))
            continue
        outcome = "symlink" if stat.S_ISLNK(info.st_mode) else "file" if stat.S_ISREG(info.st_mode) else "special"
        rows.append((e.path, info.st_size, info.st_mtime, root, info.st_dev, device, outcome))
    return rows, inner


def _absent(root: str) -> tuple | None:
    if os.path.isdir(root):
        return None
    return root, None, None, root, None, None, "missing" if not os.path.exists(root) else "not a folder"


class TreePartition(InputPartition):
    def __init__(self, root: str, folder: str | None):
        self.root, self.folder = root, folder


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r.rstrip("/") for r in options.get("roots", "").split(",") if r]
        self.include_junk = str(options.get("include_junk", "false")).lower() == "true"

    def partitions(self) -> list[TreePartition]:
        found = []
        for root in self.roots:
            found.append(TreePartition(root, None))
            if os.path.isdir(root):
                found += [TreePartition(root, e.path) for e in sorted(os.scandir(root), key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and not skipped(e.name, self.include_junk)]
        return found

    def read(self, partition: TreePartition) -> Iterator[tuple]:
        root = partition.root
        if (row := _absent(root)) is not None:
            yield row
            return
        device = os.stat(root).st_dev
        stack = [partition.folder or root]
        while stack:
            rows, inner = entries(stack.pop(), root, device, self.include_junk)
            if partition.folder is not None:
                stack += inner
                yield from rows
            else:
                yield from (r for r in rows if r[-1] != "cross_device")


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(FileListing)


LEVEL = f"{SCHEMA}, folder string"


def list_tree(spark: SparkSession, roots: list[str], include_junk: bool = False, tasks: int | None = None) -> DataFrame:
    """The columns of the data source for all files under the roots. Each level of folders is one job over ``tasks`` tasks (by default as many as there are cores)
    and a written table, so a lost executor costs a part of a level."""
    tasks = tasks or spark.sparkContext.defaultParallelism

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for folder, root, device in zip(*(batch.column(c).to_pylist() for c in ("folder", "source_root", "root_device_id")), strict=True):
                if device is None:
                    if (row := _absent(root)) is not None:
                        out.append((*row, None))
                        continue
                    device = os.stat(root).st_dev
                rows, inner = entries(folder, root, device, include_junk)
                out += [(*r, None) for r in rows] + [(None, None, None, root, None, device, "folder", f) for f in inner]
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in LEVEL.split(", ")])

    frontier = spark.createDataFrame([(r.rstrip("/"), r.rstrip("/"), None) for r in roots], "folder string, source_root string, root_device_id long")
    tables = []
    while True:
        found = cut(frontier.repartition(tasks, "folder").mapInArrow(level, LEVEL), "tree")
        tables.append(found.where("folder is null").drop("folder"))
        frontier = found.where("folder is not null").select("folder", "source_root", "root_device_id")
        if not frontier.limit(1).count():
            break
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every
