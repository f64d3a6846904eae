"""Operator 12, fill-in-middle transformation with a sparse exception index.

Cuts are drawn in code points, the text is UTF-8. The index of a text records its multibyte characters only: the code point that each stands at
and the bytes that they have had beyond one each, summed. A binary search in it turns a cut in code points into one in bytes and back; where the text is
ASCII nothing is recorded and both are the same number. So a text is never decoded, and its parts are slices of its bytes.

A document's cuts and form come from its id alone (``draws``): every run and every executor rebuilds the same rows.

Forms: ``plain``, the text; ``psm``, ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm``, ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. Texts that
hold a marker stay plain, so the markers of an output are its own and ``restored`` gives the exact text back.

Nulls and edges: a null text counts as empty and stays plain with n 0; a null doc_id draws as an empty number and is returned as null; repeated rows give
repeated results; an empty table gives no rows; extra columns are ignored, whatever their names. Bytes that are no UTF-8 are kept as they are. The index
takes 8 bytes a multibyte character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartulary.llm.batches import map_texts, no_tables

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
#: Of 100 documents so many are transformed, and of 100 of those so many get the suffix first.
FIM_SHARE, SPM_SHARE = 90, 20
BLOCK = 1 << 20
#: Bytes of output in one batch.
AT_ONCE = 16 << 20


class ExceptionIndex:
    """Where code points and bytes of a UTF-8 text part: points[k], the code point of the k-th multibyte character, and excess[k], the bytes beyond one
    each of the characters before it (one entry more than points)."""

    def __init__(self, data: bytes):
        points, excess, before = [], [], 0
        if not data.isascii():
            whole = np.frombuffer(data, dtype=np.uint8)
            for at in range(0, len(whole), BLOCK):
                part = whole[at : at + BLOCK]
                lead = np.flatnonzero(part >= 0xC0)
                byte = part[lead]
                through = np.cumsum(1 + (byte >= 0xE0) + (byte >= 0xF0)) + before
                prior = np.concatenate([[before], through[:-1]])[: len(lead)]
                points.append((lead + at - prior).astype(np.uint32))
                excess.append(through.astype(np.uint32))
                before = int(through[-1]) if len(lead) else before
        self.points = np.concatenate([np.empty(0, dtype=np.uint32), *points])
        self.excess = np.concatenate([np.zeros(1, dtype=np.uint32), *excess])
        self.n = len(data) - before

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """The byte that each code point begins at; the end of the text for n."""
        cuts = np.asarray(cuts, dtype=np.int64)
        return cuts + self.excess[np.searchsorted(self.points, cuts, side="left")].astype(np.int64)

    def to_points(self, offsets: np.ndarray) -> np.ndarray:
        """The code point that each byte belongs to; n for the end of the text."""
        offsets = np.asarray(offsets, dtype=np.int64)
        if not len(self.points):
            return offsets
        starts = self.points.astype(np.int64) + self.excess[:-1]
        k = np.searchsorted(starts, offsets, side="right")
        behind = offsets - self.excess[k].astype(np.int64)
        return np.where(k > 0, np.maximum(self.points[np.maximum(k - 1, 0)].astype(np.int64), behind), behind)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the sha256 of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transformed(doc_id: int | None, data: bytes, unit: str = "chars", seed: int = SEED, fim_share: int = FIM_SHARE, spm_share: int = SPM_SHARE) -> tuple[int, str, int | None, int | None, bytes]:
    """n code points, form, code points of prefix and of middle (None if plain), output. With the unit ``bytes`` the cuts are drawn in bytes and
    moved back to the beginning of the character that they fall into."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    index = ExceptionIndex(data)
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or h3 % 100 >= fim_share:
        return index.n, "plain", None, None, data
    if unit == "bytes":
        points = index.to_points(np.sort([h1 % (len(data) + 1), h2 % (len(data) + 1)]))
    else:
        points = np.sort(np.array([h1 % (index.n + 1), h2 % (index.n + 1)], dtype=np.int64))
    first, second = index.to_bytes(points).tolist()
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    spm = h4 % 100 < spm_share
    parts = [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle] if spm else [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]
    return index.n, "spm" if spm else "psm", int(points[0]), int(points[1] - points[0]), b"".join(parts)


def restored(output: bytes, form: str) -> bytes:
    """The text of an output."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    cut = output.index(second, len(PREFIX))
    last = output.index(MIDDLE, cut)
    one, two, middle = output[len(PREFIX) : cut], output[cut + len(second) : last], output[last + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "chars", seed: int = SEED, fim_share: int = FIM_SHARE, spm_share: int = SPM_SHARE
) -> DataFrame:
    """One row a document: doc_id, n, form, prefix_chars, middle_chars and the output as text."""
    if unit not in ("chars", "bytes"):
        raise ValueError("unit is chars or bytes")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_tables()

        def made(ids: list, found: list) -> pa.RecordBatch:
            parts = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind_of), *(pa.array(c, t) for c, t in zip(parts, columns.values(), strict=True))], names=["doc_id", *columns])

        for batch in batches:
            kind_of = batch.column("doc_id").type
            ids, found, size = [], [], 0
            for k in range(batch.num_rows):
                ids.append(batch.column("doc_id")[k].as_py())
                found.append(transformed(ids[-1], batch.column("_text")[k].as_py() or b"", unit, seed, fim_share, spm_share))
                size += len(found[-1][4])
                if size >= AT_ONCE:
                    yield made(ids, found)
                    ids, found, size = [], [], 0
            if ids:
                yield made(ids, found)

    out = rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text: the texts of outputs, in DataFrame functions. A null output or form gives null."""
    out, form = F.col(output_col), F.col(form_col)
    at = lambda marker, start: F.call_function("locate", F.lit(marker), out, start)
    cut = F.when(form == "psm", at("<S>", F.lit(4))).otherwise(at("<P>", F.lit(4)))
    last = at("<M>", cut)
    one = F.substring(out, F.lit(4), cut - 4)
    two = F.substring(out, cut + 3, last - cut - 3)
    middle = F.substring(out, last + 3, F.length(out))
    whole = F.when(form == "plain", out).when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one))
    return rows.select(F.col(id_col).alias("doc_id"), whole.alias("text"))


def op12_fill_middle(spark, sf_dir: str) -> DataFrame:
    """The digest of each document's output and of the text that is rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def make():
        no_tables()

        def work(rows: list) -> list[list]:
            out = []
            for row in rows:
                data = row["text"] or b""
                n, form, prefix, middle, output = transformed(row["doc_id"], data)
                out.append((n, form, prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(output, form)).hexdigest()))
            return list(zip(*out, strict=True)) if out else [[] for _ in range(6)]

        return work

    both = docs.select("doc_id", F.struct("doc_id", F.col("text").cast("binary").alias("text")).alias("row"))
    return map_texts(both, make, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", "doc_id", "row")


OP12_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (select doc_id, t, length(t) as n, cast('0x' || substr(h, 1, 8) as ubigint)::bigint as h1, cast('0x' || substr(h, 9, 8) as ubigint)::bigint as h2,
  cast('0x' || substr(h, 17, 8) as ubigint)::bigint as h3, cast('0x' || substr(h, 25, 8) as ubigint)::bigint as h4 from d),
formed as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
cut as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from formed)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256 from cut
"""
