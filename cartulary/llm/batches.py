"""Row-wise work in Arrow batches: each input row gives its own output rows, so no shuffle is needed and a lost task is simply run again."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


_kept: dict[Hashable, object] = {}


def worker_tables(name: Hashable, build: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker between tasks, built when first asked for. A worker outlives a stage, so only the operator
    that asked last keeps its tables: those of the stages before go. The tables hold no cycles, so few collections are needed."""
    if name not in _kept:
        _kept.clear()
        gc.collect()
        gc.set_threshold(1_000_000, 50, 100)
        _kept[name] = build()
    return _kept[name]


def no_tables() -> None:
    """For an operator that keeps nothing between tasks: those of the stages before go."""
    if _kept:
        _kept.clear()
        gc.collect()


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _mapped(rows: DataFrame, text: str, make: Callable[[], Callable[[list], list[list]]], schema: str, kept: list[str]) -> DataFrame:
    out = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [schema])
    names, kinds = zip(*[(n, _TYPES[t]) for n, t in (part.split() for part in schema.split(","))], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = work(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[*kept, *names])

    return rows.mapInArrow(run, out)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], list[list]]], schema: str, key: str, text: str, binary: bool = False) -> DataFrame:
    """For every row: key column (as ``doc_id``), then the columns that the function gives for its text.

    make() runs once in each task and returns the function: texts (str or bytes, None for null) to a list for each column of schema. Only the key and the text
    leave the scan. The schema lists the new columns, not the key.
    """
    source = F.col(text).cast("binary") if binary else F.col(text)
    return _mapped(docs.select(F.col(key).alias("doc_id"), source.alias("_text")), "_text", make, schema, ["doc_id"])


def map_rows(docs: DataFrame, make: Callable[[], Callable[[list], list[list]]], schema: str, text: str) -> tuple[DataFrame, list[str]]:
    """Every whole row, its columns named c0, c1, ... whatever their names were, with the columns that the function gives for its text; and those names."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return _mapped(docs.toDF(*names), names[docs.columns.index(text)], make, schema, names), names
