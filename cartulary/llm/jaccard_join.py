"""Operator 5, n-gram Jaccard join by vertical partitioning of the global n-gram order.

A document's set: the 64-bit hashes of its distinct 5-word shingles (fewer words: the whole sequence as one). Sets are known by a 128-bit digest; equal
sets are one node, so exact copies never meet as pairs. Two nodes link when 100 * |A n B| >= 75 * |A u B|.

* The global order puts frequent n-grams last, the most frequent behind the others: how frequent an n-gram is comes from a count sketch over all
  documents, whose size follows the input up to 2 ** ``MOST_BITS`` cells. Any order that all documents share gives right results; this one keeps
  shared passages out of the front.
* The first fragment of a node is its prefix, the n - ceil(0.75 n) + 1 first n-grams: two linked nodes share one at least. The
  prefix overlaps of a pair are counted, and the count with the places of the last common n-gram bounds the whole overlap, which
  discards most pairs that only share a passage.
* For what is left the other fragments (ranges of the hash) are counted separately, one after the other, and summed per pair, until the sum is whole
  or too small whatever is still to come. Only pairs that can still link have their next fragments shuffled. The sum is exact.

Links are wanted for components, so a large group's pairs are not all made. While the lists would give more than ``CROSS_PER_ROW`` pairs a row,
each node of an n-gram's list meets only the list's leader; found links are contracted to components, and lists whose nodes are all in one
component are done; further rounds take other leaders. Jaccard distance is a metric, so the distances to a common leader, which those rounds
measure, rule out most other pairs of a large group: two nodes whose distances to it differ by more than a quarter can't link. The pairs of nodes that are
then still in different components are compared in the end, all of them, so no link between components is lost. Lists of frequent n-grams
are split by a salt before they are ordered.

Memory is bounded by a batch, its sets, and a bucket of postings, of which there are as many as the input needs; the driver holds bit maps of at most
2 ** ``MOST_BITS`` bits, and counts. Each table that a later step reads twice is written to the shared folder, so lost executors only cost a
stage, and deleted when it has served.

Nulls and edges: a null or blank text has the empty set, no links and itself as its component; a null doc_id stands in its group without
naming it (component_id is the least id that is not null, or null); repeated rows give repeated results; an empty table gives
no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from cartulary.llm.batches import no_tables
from cartulary.operators.closure import components
from cartulary.scratch import cut, drop

WORDS = 5
CHUNK_BITS = 16
LEAST_BITS, MOST_BITS = 18, 25
FRAGMENTS = 4
#: The fragments that one pass counts where only links are wanted: most pairs drop out in the first.
PASSES = ((0, 1), (1, FRAGMENTS))
BUCKET = 1 << 19
ROUNDS = 3
CROSS_PER_ROW = 2
HUB = 8
SEEN = 200_000
BLOCK_BYTES = 1 << 18
ROWS_AT_ONCE = 512
LONG_WORD = 32
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: One random number for each byte at each place of a word; a word's hash is their sum.
_TABLE = np.array([xxhash.xxh3_64_intdigest(bytes([k, b])) for k in range(LONG_WORD) for b in range(256)], dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of a text in lower case."""
    b = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero(~_BLANK[b])
    if not len(at):
        return at, np.empty(0, dtype=np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    sizes = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    np.minimum(place, LONG_WORD - 1, out=place)
    hashes = np.add.reduceat(_TABLE[(place << 8) + b[at]], first)
    starts = at[first]
    for k in np.flatnonzero(sizes > LONG_WORD):
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + sizes[k]])
    return starts, hashes


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces, cut at blanks."""
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK_BYTES)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for block in _blocks([t or b"" for t in texts]):
        edges = np.cumsum([0, *[len(t) + 1 for t in block]])
        if len(block) == 1:
            hashes = np.concatenate([np.empty(0, dtype=np.uint64), *(word_hashes(p)[1] for p in _pieces(block[0].lower()))])
            bounds = np.array([0, len(hashes)])
        else:
            starts, hashes = word_hashes(b" ".join(block).lower())
            bounds = np.searchsorted(starts, edges)
        total = hashes * _MULTIPLIERS[0]
        for k in range(1, WORDS):
            total[:-k] += hashes[k:] * _MULTIPLIERS[k]
        total ^= total >> np.uint64(32)
        total *= _MULTIPLIERS[4]
        total ^= total >> np.uint64(29)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo < WORDS:
                yield np.array([xxhash.xxh3_64_intdigest(hashes[lo:hi].tobytes(), seed=hi - lo)] if hi > lo else [], dtype=np.uint64)
            else:
                h = np.sort(total[lo : hi - WORDS + 1])
                yield h[np.concatenate([[True], h[1:] != h[:-1]])]


def key_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time; nothing that other stages keep in the worker stays."""
    no_tables()
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


class Seen:
    """Whether a key was met lately: what this forgets is removed after the shuffle."""

    def __init__(self):
        self.keys: set = set()

    def new(self, key) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= SEEN:
            self.keys.clear()
        self.keys.add(key)
        return True


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def _packed_cells(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Chunks of a sketch that aren't empty: a byte for the form, then places or a bit map of what isn't 0, then those counts."""
    for chunk, part in enumerate(cells.reshape(-1, 1 << CHUNK_BITS)):
        at = np.flatnonzero(part)
        if len(at):
            sparse = 16 * len(at) < 1 << CHUNK_BITS
            yield chunk, (b"s" + at.astype("<u2").tobytes() if sparse else b"d" + np.packbits(part > 0).tobytes()) + part[at].tobytes()


def _unpacked_cells(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if data[:1] == b"s":
        n = (len(data) - 1) // 3
        return np.frombuffer(data, dtype="<u2", offset=1, count=n), np.frombuffer(data, dtype=np.uint8, offset=1 + 2 * n)
    bits = (1 << CHUNK_BITS) // 8
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=1, count=bits))), np.frombuffer(data, dtype=np.uint8, offset=1 + bits)


def _digest(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text.cast("binary")))


def _nodes(rows: DataFrame, bits: int) -> DataFrame:
    """doc_id, key, n and a digest of the text for each row, and behind each partition's rows its count sketch in chunks. key is null for empty sets."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "key", "n", "digest", "chunk", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ids = Seen(), None
        sketch, fresh, size = np.zeros(1 << bits, dtype=np.uint8), [], 0

        def count() -> None:
            cells, times = np.unique((np.concatenate(fresh) & np.uint64((1 << bits) - 1)).astype(np.uint32), return_counts=True)
            sketch[cells] = np.minimum(sketch[cells] + times, 255)
            fresh.clear()

        for batch in _slices(batches):
            ids = batch.column("doc_id")
            keys, sizes = [], []
            for h in shingle_sets(batch.column("_text").to_pylist()):
                keys.append(key_of(h) if len(h) else None)
                sizes.append(len(h))
                if len(h) and seen.new(keys[-1]):
                    fresh.append(h)
                    size += len(h)
                    if size > 1 << 18:
                        count()
                        size = 0
            none = [pa.nulls(len(ids), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), batch.column("digest"), *none], names=names)
        if fresh:
            count()
        if ids is not None and sketch.any():
            chunks, data = zip(*_packed_cells(sketch), strict=True)
            none = [pa.nulls(len(chunks), t) for t in (ids.type, pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(chunks, pa.int32()), pa.array(data, pa.binary())], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, key binary, n long, digest long, chunk int, cells binary")


def _frequent(table: DataFrame, bits: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit maps of the sketch cells that stand out, and that stand out by far: 2 ** bits bits each."""
    mean = total / (1 << bits)
    limit = mean + max(8.0, 6.0 * mean**0.5)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's rows follow one another."""
        at, counts, out = None, None, []

        def end() -> None:
            if at is not None and (counts > limit).any():
                out.append((at, np.packbits(counts > limit, bitorder="little").tobytes(), np.packbits(counts > 8 * limit, bitorder="little").tobytes()))

        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if chunk != at:
                    end()
                    at, counts = chunk, np.zeros(1 << CHUNK_BITS, dtype=np.int64)
                cells, times = _unpacked_cells(data)
                counts[cells] += times
        end()
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "often", "very"])

    parts = table.where("chunk is not null").select("chunk", "cells").repartition("chunk").sortWithinPartitions("chunk")
    size = 1 << (CHUNK_BITS - 3)
    maps = np.zeros((2, 1 << (bits - 3)), dtype=np.uint8)
    for row in parts.mapInArrow(add, "chunk int, often binary, very binary").collect():  # 2 ** (bits - CHUNK_BITS) rows of 16 KB at most
        maps[0, row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["often"], dtype=np.uint8)
        maps[1, row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["very"], dtype=np.uint8)
    return maps[0], maps[1]


def _bit_set(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def prefix(hashes: np.ndarray, maps: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The set's prefix in the global order, and how many n-grams of it are not frequent."""
    size = prefix_length(len(hashes))
    cells = hashes & np.uint64(len(maps[0]) * 8 - 1)
    often = _bit_set(maps[0], cells)
    rare = hashes[~often]
    if len(rare) >= size:
        return rare[:size], size
    late, very = hashes[often], _bit_set(maps[1], cells[often])
    return np.concatenate([rare, late[~very], late[very]])[:size], len(rare)


def _postings(rows: DataFrame, maps, bits: int) -> DataFrame:
    """Postings of all prefixes, packed by bucket: a bucket is a range of the hash, behind those stand the salted buckets of frequent n-grams.

    Of each batch a bucket gets one row: h and pos (from 1) of its postings, node by node; and of those nodes key, n and number of postings.
    """
    names = ["bucket", "h", "pos", "keys", "n", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        both = maps.value

        def made(found: list) -> pa.RecordBatch:
            sizes = np.array([len(f[0]) for f in found])
            h = np.concatenate([f[0] for f in found])
            pos = np.concatenate([np.arange(1, s + 1, dtype="<u4") for s in sizes])
            node = np.repeat(np.arange(len(found)), sizes)
            hot = pos > np.repeat([f[3] for f in found], sizes)
            salt = np.array([int.from_bytes(f[1][:8], "little") for f in found], dtype=np.uint64)
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            bucket[hot] = (1 << bits) + ((h[hot] * _MULTIPLIERS[0] ^ salt[node[hot]]) * _MULTIPLIERS[1] >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, pos, node, bucket = h[order], pos[order], node[order], bucket[order]
            keys, n = np.array([f[1] for f in found], dtype="V16"), np.array([f[2] for f in found], dtype="<u4")
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            out = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                first = np.flatnonzero(np.diff(node[lo:hi], prepend=-1))
                own = node[lo:hi][first]
                out.append((bucket[lo], h[lo:hi].tobytes(), pos[lo:hi].tobytes(), keys[own].tobytes(), n[own].tobytes(), np.diff(first, append=hi - lo).astype("<u4").tobytes()))
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

        found, size = [], 0
        for batch in _slices(batches):
            for h in shingle_sets(batch.column("_text").to_pylist()):
                if not len(h) or not seen.new(key := key_of(h)):
                    continue
                first, rare = prefix(h, both)
                found.append((first, key, len(h), rare))
                size += len(first)
                if size > 500_000:
                    yield made(found)
                    found, size = [], 0
        if found:
            yield made(found)

    return rows.select("_text").where(F.col("_text").isNotNull()).mapInArrow(run, "bucket long, h binary, pos binary, keys binary, n binary, runs binary")


MEMBERS = "h long, key binary, n int, pos int"


def _members(postings: DataFrame, bits: int) -> DataFrame:
    """The postings of n-grams that more than one node has in its prefix, once each; those of frequent ones may be single."""

    def lists(table: pa.Table) -> pa.Table:
        get = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()])
        h, pos, keys = get("h", "<u8"), get("pos", "<u4"), get("keys", "V16")
        node = np.repeat(np.arange(len(keys)), get("runs", "<u4"))
        n = get("n", "<u4")
        order = np.argsort(h, kind="stable")
        h = h[order]
        if table.column("bucket")[0].as_py() < 1 << bits:
            same = np.concatenate([[False], h[1:] == h[:-1], [False]])
            some = np.flatnonzero(same[1:] | same[:-1])
            order, h = order[some], h[some]
        node, pos = node[order], pos[order]
        halves = keys.view("<u8").reshape(-1, 2)[node]
        order = np.lexsort((halves[:, 1], halves[:, 0], h))
        h, node, pos, halves = h[order], node[order], pos[order], halves[order]
        # copies of a set from other tasks go
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (halves[1:] != halves[:-1]).any(axis=1)])[: len(h)]
        h, node, pos = h[keep], node[keep], pos[keep]
        if table.column("bucket")[0].as_py() < 1 << bits:
            same = np.concatenate([[False], h[1:] == h[:-1], [False]]) if len(h) else np.zeros(1, dtype=bool)
            keep = same[1:] | same[:-1]
            h, node, pos = h[keep], node[keep], pos[keep]
        named = pa.Array.from_buffers(pa.binary(16), len(node), [None, pa.py_buffer(keys[node].tobytes())]).cast(pa.binary())
        return pa.table([pa.array(h.view(np.int64)), named, pa.array(n[node].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["h", "key", "n", "pos"])

    return postings.groupBy("bucket").applyInArrow(lists, MEMBERS)


def _digest_map(digests: DataFrame, count: int) -> bytes:
    """Bit map of text digests, 16 bits a digest up to 2 ** MOST_BITS bits: bit digest & 7 of byte (digest >> 3) mod size."""
    size = 1 << min(MOST_BITS, max(16, (16 * count).bit_length())) - 3
    cell = F.pmod(F.shiftright("digest", 3), F.lit(size)) * 8 + F.col("digest").bitwiseAND(F.lit(7))
    # Spark's bit maps hold 32768 bits each
    rows = digests.select(cell.alias("cell")).groupBy(F.floor(F.col("cell") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(F.col("cell"), F.lit(32768))).alias("bits"))
    out = bytearray(size)
    for row in rows.collect():  # 4 KB each, out's size in all
        out[row["bucket"] * 4096 : (row["bucket"] + 1) * 4096] = row["bits"]
    return bytes(out)


def _sets(rows: DataFrame, wanted, lo: int, hi: int) -> DataFrame:
    """key, n, the hashes of fragments lo to hi - 1 and how many follow, of the texts whose digest is in the map ``wanted``. No wanted text is missing; a few others may be there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, seen_texts, bits = Seen(), Seen(), np.frombuffer(wanted.value, dtype=np.uint8)
        for batch in _slices(batches):
            digests = batch.column("digest").to_numpy()
            asked = np.flatnonzero(bits[(digests >> 3) % len(bits)] >> (digests & 7).astype(np.uint8) & 1)
            own = [k for k in asked.tolist() if seen_texts.new(digests[k])]
            found = []
            for h in shingle_sets(batch.column("_text").take(pa.array(own, pa.int64())).to_pylist()):
                if len(h) and seen.new(key := key_of(h)):
                    start, end = (edges := fragment_edges(h))[lo], edges[hi]
                    found.append((key, len(h), h[start:end].tobytes(), len(h) - end))
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["key", "n", "hashes", "rest"])

    sets = rows.select("digest", "_text").where(F.col("_text").isNotNull()).mapInArrow(run, "key binary, n long, hashes binary, rest long")
    return sets.groupBy("key").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"), F.first("rest").alias("rest"))


def _possible(c: Column, na: Column, nb: Column) -> Column:
    """Whether an overlap of c can reach the limit: 100 c >= 75 (na + nb - c)."""
    return 175 * c >= 75 * (na.cast("long") + nb.cast("long"))


def _same_size(na: Column, nb: Column) -> Column:
    return 4 * F.least(na, nb) >= 3 * F.greatest(na, nb)


def _early(n: Column, pos: Column, other: Column) -> Column:
    """Whether an n-gram at this place can be the first that the pair has in common: it and all that follow must reach 3 / 7 of both sizes' sum."""
    return 7 * (n.cast("long") - pos + 1) >= 3 * (n.cast("long") + other)


def _bounded(shared: DataFrame) -> DataFrame:
    """Of rows (a, b, na, nb, pa, pb), one for each common n-gram at an early place of both, the pairs whose overlap there leaves a link possible.

    What a pair has in common before such an n-gram is at early places too, so it is counted.
    """
    counted = shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    bound = F.col("c") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return counted.where(_possible(bound, F.col("na"), F.col("nb"))).select("a", "b")


_EDGES = np.array([(k << 64) // FRAGMENTS for k in range(1, FRAGMENTS)], dtype=np.uint64)


def fragment_edges(hashes: np.ndarray) -> list[int]:
    """Where the fragments of a sorted set begin, and its end."""
    return [0, *np.searchsorted(hashes, _EDGES).tolist(), len(hashes)]


def _counted(rows: DataFrame, firsts: DataFrame, pairs: DataFrame, lo: int, hi: int) -> DataFrame:
    """pairs (a, b, c: common n-grams so far) with the common n-grams of fragments lo to hi - 1 added, the sizes' total and how many may follow (most)."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    digests = cut(firsts.join(keys, "key", "left_semi").select("digest"), "digests")
    wanted = rows.sparkSession.sparkContext.broadcast(_digest_map(digests, digests.count()))
    drop(digests)
    sets = _sets(rows, wanted, lo, hi)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ha, hb = ([np.frombuffer(x, dtype=np.uint64) for x in batch.column(c).to_pylist()] for c in ("ha", "hb"))
            more = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(ha, hb, strict=True)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(batch.column("c").to_numpy() + more), batch.column("total"), batch.column("most")], names=["a", "b", "c", "total", "most"])

    one = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"), F.col("rest").alias("ra"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"), F.col("rest").alias("rb"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "c", (F.col("na") + F.col("nb")).alias("total"), F.least("ra", "rb").alias("most"), "ha", "hb")
    return met.mapInArrow(count, "a binary, b binary, c long, total long, most long")


def _verified(rows: DataFrame, firsts: DataFrame, pairs: DataFrame, whole: bool) -> DataFrame:
    """A written table of a, b, share (common n-grams by all) and whether they link; unless ``whole``, only of the pairs that link."""
    summed = pairs.select("a", "b", F.lit(0).cast("long").alias("c"))
    for lo, hi in ((0, FRAGMENTS),) if whole else PASSES:
        before = summed
        counted = _counted(rows, firsts, before, lo, hi)
        summed = cut(counted if whole else counted.where(175 * (F.col("c") + F.col("most")) >= 75 * F.col("total")), "sums")
        if lo:
            drop(before)
        if not whole and not summed.limit(1).count():
            break
    links = cut(summed.select("a", "b", (F.col("c") / (F.col("total") - F.col("c"))).alias("share"), (175 * F.col("c") >= 75 * F.col("total")).alias("linked")), "links")
    drop(summed)
    return links


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members with comp, of the n-grams whose nodes are in more than one component."""
    named = members.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    open_lists = named.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h")
    return named.join(open_lists, "h", "left_semi").select("h", "key", "n", "pos", "comp")


def _star(members: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of each list's leader and its nodes of another component.

    Rare n-grams come first, so in a group of near copies the node that has an n-gram at the earliest place is the one with the fewest n-grams of its
    own: the middle of the group leads in round 0. Later rounds draw other leaders.
    """
    rank = [F.col("pos") if k == 0 else F.lit(0), F.xxhash64("key", F.lit(k))]
    leaders = members.groupBy("h").agg(F.min(F.struct(rank[0].alias("p"), rank[1].alias("r"), "key", "n", "comp", "pos")).alias("l"))
    leaders = leaders.select("h", F.col("l.key").alias("a"), F.col("l.n").alias("_n"), F.col("l.comp").alias("_c"), F.col("l.pos").alias("_p"))
    early = _early(F.col("n"), F.col("pos"), F.col("_n")) & _early(F.col("_n"), F.col("_p"), F.col("n"))
    met = members.join(leaders, "h").where((F.col("comp") != F.col("_c")) & _same_size(F.col("n"), F.col("_n")) & early)
    return met.select("a", F.col("key").alias("b")).distinct()


def _hopeful(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of _star that can link, and all of leaders with HUB pairs or more: their distances are of use later."""
    pairs = cut(pairs, "star")
    hubs = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= HUB).select("a"), "hubs")
    bounded = _bounded(_with_prefix(pairs.join(hubs, "a", "left_anti"), members))
    out = cut(pairs.join(hubs, "a", "left_semi").select("a", "b").unionByName(bounded), "pairs")
    drop(pairs)
    drop(hubs)
    return out


def _with_prefix(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The common prefix n-grams of the pairs, as _bounded takes them."""
    one = members.select("h", F.col("key").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    two = members.select("h", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    return pairs.join(one, "a").join(two, ["b", "h"]).where(_early(F.col("na"), F.col("pa"), F.col("nb")) & _early(F.col("nb"), F.col("pb"), F.col("na")))


def _all_cross(members: DataFrame, met: list[DataFrame]) -> DataFrame:
    """The common prefix n-grams of all pairs of one list and different components, but for those that the distances to a leader (``met``) rule out."""
    columns = ["comp"]
    for k, pairs in enumerate(met):
        # a node's leader is the one of most pairs; leaders are at no distance from themselves
        size = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")), "hubs")
        own = size.select("a", F.col("a").alias("key"), F.lit(1.0).alias("share"), "_n").unionByName(pairs.join(size, "a").select("a", F.col("b").alias("key"), "share", "_n"))
        best = own.groupBy("key").agg(F.max(F.struct("_n", "a", "share")).alias("l")).select("key", F.col("l.a").alias(f"ref{k}"), F.col("l.share").alias(f"share{k}"))
        members = members.join(best, "key", "left")
        columns += [f"ref{k}", f"share{k}"]
    one = members.select("h", F.col("key").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), *[F.col(c).alias(f"{c}_a") for c in columns])
    two = members.select("h", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), *[F.col(c).alias(f"{c}_b") for c in columns])
    wanted = (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & _same_size(F.col("na"), F.col("nb"))
    wanted &= _early(F.col("na"), F.col("pa"), F.col("nb")) & _early(F.col("nb"), F.col("pb"), F.col("na"))
    for k in range(len(met)):
        apart = (F.col(f"ref{k}_a") == F.col(f"ref{k}_b")) & (F.abs(F.col(f"share{k}_a") - F.col(f"share{k}_b")) > 0.25 + 1e-9)
        known = (F.col(f"ref{k}_a") == F.col("b")) | (F.col(f"ref{k}_b") == F.col("a"))
        wanted &= ~F.coalesce(apart, F.lit(False)) & ~F.coalesce(known, F.lit(False))
    return one.join(two, "h").where(wanted).select("a", "b", "na", "nb", "pa", "pb")


def _cross_rows(members: DataFrame) -> int:
    """How many rows _all_cross can have."""
    per = members.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("q"))
    return per.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0))).collect()[0][0]


def _classes(docs: DataFrame, id_col: str, text_col: str, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The nodes table (doc_id, key, n, digest), the sets (key, first, digest, least row) and, if there are links, the components (key, comp)."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"), _digest(F.col(text_col)).alias("digest"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).collect()[0][0]
    bits = max(LEAST_BITS, min(MOST_BITS, (size // 4).bit_length()))
    table = cut(_nodes(rows, bits), "nodes")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    maps = context.broadcast(_frequent(table, bits, total))
    nodes = cut(table.where("chunk is null").select("doc_id", "key", "n", "digest"), "nodes")
    drop(table)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("row")
    firsts = cut(nodes.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.min("digest").alias("digest"), least), "sets")
    buckets = max(5, (total // 4 // BUCKET).bit_length())
    members = cut(_members(_postings(rows, maps, buckets), buckets), "members")
    most = CROSS_PER_ROW * members.count()
    maps.unpersist()
    comps, met = None, []
    for k in range(rounds + 1):
        open_members = members.withColumn("comp", F.col("key")) if comps is None else cut(_unsettled(members, comps), "open")
        cross = _cross_rows(open_members)
        last = cross <= most or k == rounds
        if cross:
            pairs = cut(_bounded(_all_cross(open_members, met)), "pairs") if last else _hopeful(_star(open_members, k), open_members)
            found = _verified(rows, firsts, pairs, not last)
            drop(pairs)
            links = found.where("linked").select("a", "b")
            if comps is not None:
                links = links.unionByName(comps.where("key <> comp").select(F.col("key").alias("a"), F.col("comp").alias("b")))
            comps = components(links)
            met.append(found)
        if open_members is not members and hasattr(open_members, "_cartulary_path"):
            drop(open_members)
        if last or not cross:
            break
    drop(members)
    for found in met:
        drop(found)
    return nodes, firsts, comps


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id."""
    nodes, firsts, comps = _classes(docs, id_col, text_col, rounds)
    if comps is None:
        named = firsts.select("key", F.col("first").alias("component_id"))
    else:
        rooted = firsts.join(comps, "key", "left").select("key", "first", F.coalesce("comp", "key").alias("root"))
        # written, so that one large component is not held together by the sums before the join
        roots = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
        named = rooted.join(roots, "root").select("key", "component_id")
    joined = nodes.select("doc_id", "key", "n").join(named, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component, columns unchanged: the one of least id (a null id last), then of the least text digest.

    Documents without words stay, each for itself.
    """
    _, firsts, comps = _classes(docs, "doc_id", "text", ROUNDS)
    rooted = firsts.withColumn("root", F.col("key")) if comps is None else firsts.join(comps, "key", "left").withColumn("root", F.coalesce("comp", "key"))
    kept = cut(rooted.groupBy("root").agg(F.min("row").alias("k")).select(F.col("k.doc_id").alias("i"), F.col("k.digest").alias("e")), "kept")
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    id_, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    has_words = F.coalesce(text.rlike("[^ \\t-\\r]"), F.lit(False))
    chosen = rows.where(has_words).withColumn("d", _digest(text)).join(kept, id_.eqNullSafe(F.col("i")) & (F.col("d") == F.col("e")), "left_semi")
    once = chosen.withColumn("r", F.row_number().over(Window.partitionBy(id_, "d").orderBy("d"))).where("r = 1")
    return once.select(*names).unionByName(rows.where(~has_words)).toDF(*docs.columns)
