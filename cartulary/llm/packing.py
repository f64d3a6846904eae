"""Operator 6, packing: bounded-space online packing of token sequences into windows.

Each partition streams its documents and keeps ``open_windows`` windows open. A document's stretch that fills whole windows goes out
at once; the rest is placed best-fit, into the open window with the least room that still holds it. When none fits, the fullest
window is emitted: if its gap is ``min_cut`` tokens or more, the head of the rest fills it first (documents may be cut anywhere),
so a window's padding is below ``min_cut``. What is open at the end of a partition is merged afterwards: the leftovers of
``merge_span`` neighbouring partitions meet in one small task, largest first, each into the merged window with the least room that holds it.
A task's memory is bounded by the windows' number and size, whatever the table's size.

Tokens: the tokenizer encodes each piece of its pattern by itself, so a batch's distinct words are cut into pieces and each piece is encoded once and
kept in a bounded table (see WordTokenizer). Special tokens written out in a text are what the library makes of them. A document ends with ``end_id``.

A window's number is (partition << 32) + a running number; a merged window takes the number of its first part. Results depend on
how Spark splits the input, as an online method's must, but every split gives a whole and gapless packing. The pieces are written once to
the shared folder, so a lost executor cannot mix two packings.

Nulls and edges: a null or empty text is its end id alone; a null doc_id is returned as null; repeated rows are packed each for itself; an
empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cartulary.llm.batches import worker_tables
from cartulary.scratch import cut

WINDOW = 2048
OPEN_WINDOWS = 32
MIN_CUT = 16
MERGE_SPAN = 64
END_ID = 1
KEPT_WORDS = 600_000
CHARS_AT_ONCE = 6_000_000
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: ASCII and Latin-1 without control characters and the blanks on which libraries differ.
PLAIN = b"\t\n\r" + bytes(range(0x20, 0x7F)) + bytes(range(0xA1, 0x100))
#: The pieces of the tokenizer's own pattern, for lower-cased text of those characters.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN)
    except UnicodeEncodeError:
        return False


class WordTokenizer:
    """Ids of texts, as arrays of unsigned 32-bit integers. Words are encoded once and kept in a bounded table.

    The library lower-cases, then encodes each piece of its pattern by itself. In texts of ``PLAIN`` characters Python's pieces are the same, so
    only new pieces of new words go to the library; other texts go there by white-space-delimited word; texts with separators on which Python and the tokenizer differ, or with
    something like a special token, are encoded whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # the same model for pieces that are normalised and split already
        bare = json.loads(definition) | {"normalizer": None, "added_tokens": []}
        bare["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.piece_tokenizer = Tokenizer.from_str(json.dumps(bare))
        self.number: dict[str, int] = {}
        self.flat, self.edges = array("I"), array("q", [0])

    def _store(self, word: str, ids) -> int:
        k = self.number[word] = len(self.edges) - 1
        self.flat.extend(ids)
        self.edges.append(len(self.flat))
        return k

    def _numbers(self, words: list[str], plain: bool) -> list[int]:
        """The places of distinct words in the table; new ones are encoded."""
        if len(self.number) > KEPT_WORDS:  # what these words need stays
            kept = {w: self.flat[self.edges[k] : self.edges[k + 1]] for w in words if (k := self.number.get(w)) is not None}
            self.number, self.flat, self.edges = {}, array("I"), array("q", [0])
            for w, ids in kept.items():
                self._store(w, ids)
        found = list(map(self.number.get, words))
        missing = [i for i, k in enumerate(found) if k is None]
        pieces = [PIECE.findall(words[i]) if plain else [words[i]] for i in missing]
        new = list({p for each in pieces for p in each}.difference(self.number))
        library = self.piece_tokenizer if plain else self.tokenizer
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            for p, e in zip(some, library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self._store(p, e.ids)
        number, flat, edges = self.number, self.flat, self.edges
        for i, each in zip(missing, pieces, strict=True):
            if len(each) == 1:
                found[i] = number[each[0]]
            else:
                found[i] = self._store(words[i], [x for p in each for x in flat[edges[number[p]] : edges[number[p] + 1]]])
        return found

    def _by_words(self, texts: pa.Array, plain: bool) -> list[np.ndarray]:
        split = pc.utf8_split_whitespace(pc.utf8_lower(texts) if plain else texts)
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return [np.empty(0, dtype="<u4")] * len(texts)
        numbers = np.array(self._numbers(coded.dictionary.to_pylist(), plain))
        edges = np.array(self.edges)
        sizes = (edges[numbers + 1] - edges[numbers])[index := coded.indices.to_numpy()]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(edges[numbers][index] - ends + sizes, sizes)
        ids = np.array(self.flat, dtype="<u4")[places]
        at = np.concatenate([[0], ends])[split.offsets.to_numpy()]
        return np.split(ids, at[1:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        kinds = ["whole" if ODD_SPACE.search(t) or "<|" in t else "plain" if is_plain(t) else "words" for t in texts]
        out: list[np.ndarray] = [None] * len(texts)
        for kind in ("plain", "words"):
            places = [k for k, x in enumerate(kinds) if x == kind]
            if places:
                for k, ids in zip(places, self._by_words(pa.array([texts[k] for k in places], pa.string()), kind == "plain"), strict=True):
                    out[k] = ids
        for k, kind in enumerate(kinds):
            if kind == "whole":
                out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype="<u4")
        return out


class Packer:
    """Open windows of one partition. A piece: (document, start, length, checksum, tokens of the document, window, offset, open)."""

    def __init__(self, partition: int, window: int, open_windows: int, min_cut: int):
        self.size, self.most, self.min_cut = window, open_windows, min_cut
        self.next = partition << 32
        self.open: list[list] = []  # [used, number, pieces]
        self.out: list[tuple] = []

    def _new(self) -> list:
        self.next += 1
        return [0, self.next - 1, []]

    def _put(self, w: list, doc, ids: np.ndarray, start: int, length: int, total: int) -> None:
        w[2].append((doc, start, length, zlib.crc32(ids[start : start + length]), total, w[1], w[0]))
        w[0] += length

    def _emit(self, w: list, still_open: bool = False) -> None:
        self.out += [(*p, still_open) for p in w[2]]

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        start = 0
        while total - start >= self.size:
            w = self._new()
            self._put(w, doc, ids, start, self.size, total)
            self._emit(w)
            start += self.size
        rest = total - start
        if not rest:
            return
        best = None
        for w in self.open:
            if self.size - w[0] >= rest and (best is None or w[0] > best[0]):
                best = w
        if best is None and len(self.open) >= self.most:
            fullest = max(self.open, key=lambda w: w[0])
            gap = self.size - fullest[0]
            if gap >= self.min_cut:
                self._put(fullest, doc, ids, start, gap, total)
                start, rest = start + gap, rest - gap
            self.open.remove(fullest)
            self._emit(fullest)
        if best is None:
            best = self._new()
            self.open.append(best)
        self._put(best, doc, ids, start, rest, total)
        if best[0] == self.size:
            self.open.remove(best)
            self._emit(best)

    def finish(self) -> None:
        for w in self.open:
            self._emit(w, True)
        self.open = []

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "_open"]


def packed_pieces(docs: DataFrame, definition: str, id_col: str, text_col: str, window: int, open_windows: int, min_cut: int, end_id: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tables("packing", lambda: WordTokenizer(shared.value))
        packer = Packer(TaskContext.get().partitionId(), window, open_windows, min_cut)
        types = None

        def made(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True)) if pieces else [[] for _ in NAMES]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NAMES)

        for batch in batches:
            types = [batch.schema.field("doc_id").type, *[pa.int64()] * 6, pa.bool_()]
            ids, texts, n = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text or "")
                n += len(texts[-1])
                if n >= CHARS_AT_ONCE:
                    for d, e in zip(ids, tokenizer.encode(texts), strict=True):
                        packer.add(d, np.concatenate([e, end]))
                    ids, texts, n = [], [], 0
            for d, e in zip(ids, tokenizer.encode(texts), strict=True):
                packer.add(d, np.concatenate([e, end]))
            yield made(packer.taken())
        packer.finish()
        if types and (left := packer.taken()):
            yield made(left)

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, _open boolean")


def merged_leftovers(pieces: DataFrame, window: int, merge_span: int) -> DataFrame:
    """Open windows of neighbouring partitions put together. A group holds the sizes of the windows of merge_span partitions at most."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        bins: list[list[int]] = []  # [used, number]
        out = []
        for number, size in sorted(zip(frame["sequence_id"], frame["used"], strict=True), key=lambda x: (-x[1], x[0])):
            best = None
            for b in bins:
                if window - b[0] >= size and (best is None or b[0] > best[0]):
                    best = b
            if best is None:
                best = [0, number]
                bins.append(best)
            out.append((number, best[1], best[0]))
            best[0] += size
        return pd.DataFrame(out, columns=["_was", "_now", "_at"])

    windows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    grouped = windows.withColumn("_group", F.floor(F.shiftright("sequence_id", 32) / merge_span))
    moves = grouped.groupBy("_group").applyInPandas(merge, "_was long, _now long, _at long")
    moved = pieces.join(moves, F.col("sequence_id") == F.col("_was"))
    return moved.withColumn("sequence_id", F.col("_now")).withColumn("offset", F.col("offset") + F.col("_at")).select(*pieces.columns)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    min_cut: int = MIN_CUT,
    merge_span: int = MERGE_SPAN,
    end_id: int = END_ID,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. The tokenizer file, of fixed size, is broadcast."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    pieces = cut(packed_pieces(docs, definition, id_col, text_col, window, open_windows, min_cut, end_id), "pieces")
    closed = pieces.where("not _open")
    return closed.unionByName(merged_leftovers(pieces.where("_open"), window, merge_span)).drop("_open")


def op6_pack_windows(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of docs."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
