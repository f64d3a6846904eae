"""Pairs of similar names by difflib's ratio, 2 M / (|a| + |b|) with M matched characters.

Names of some 20 letters that may differ in a third of their bigrams have no rare part that all partners share, so names are compared block by block in arrays.
No pair over the limit is lost. |a| + |b| - 2 M characters are only in one of the two, so at most that many bits differ of a word with a bit for each letter and
its first, second, ... place in the name, also where several share a bit; three times as many of a word with a bit for each two letters in a row. M is at most the
length of the longest common subsequence, found for many pairs at a time in 64-bit words. What is left is matched as difflib does, many pairs at a time.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartulary.functions import names
from cartulary.scratch import cut

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Places of a letter that have a bit; further ones are not told.
PLACES = 7
WORD = 64
BLOCK = 1 << 16
LEAST_BLOCKS = 12
AT_ONCE = 1 << 16
#: Names that are alike are compared with so many others at a time.
ALIKE, COLUMNS = 16, 1 << 14
#: Pairs that are matched at a time.
MATCHED = 1 << 13


class _Block:
    def __init__(self, found: list[str]):
        self.names, k = found, len(found)
        self.lengths = np.array([len(x) for x in found], dtype=np.int64)
        code = np.full(256, len(LETTERS), dtype=np.uint8)
        code[np.frombuffer(LETTERS.encode(), dtype=np.uint8)] = np.arange(len(LETTERS))
        flat = code[np.frombuffer("".join(found).encode(), dtype=np.uint8)]
        owner = np.repeat(np.arange(k), self.lengths)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        short = at < WORD
        self.codes = np.full((k, WORD), len(LETTERS), dtype=np.uint8)
        self.codes[owner[short], at[short]] = flat[short]
        self.where = np.zeros((k, len(LETTERS) + 1), dtype=np.uint64)
        np.bitwise_or.at(self.where, (owner[short], flat[short]), np.uint64(1) << at[short].astype(np.uint64))
        counts = np.zeros((k, len(LETTERS)), dtype=np.int64)
        np.add.at(counts, (owner, flat), 1)
        self.bits = (np.arange(PLACES) < counts[:, :, None]).reshape(k, len(LETTERS) * PLACES)
        twos = np.zeros((k, 4 * WORD), dtype=bool)
        follow = np.flatnonzero(at[1:] > 0)
        twos[owner[follow], (flat[follow].astype(np.int64) * 37 + flat[follow + 1]) * 40503 % 65536 >> 8] = True
        self.twos = np.ascontiguousarray(np.packbits(twos, axis=1).view(np.uint64).T)


def _letter_words(one: _Block, two: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each name: the bits that tell most alone, then the others, of which the rarest share one."""
    often = one.bits.mean(axis=0) + two.bits.mean(axis=0)
    best = np.argsort(-often * (2 - often), kind="stable")

    def words(block: _Block) -> np.ndarray:
        out = np.zeros((len(block.names), 2 * WORD), dtype=bool)
        out[:, :WORD] = block.bits[:, best[:WORD]]
        for start in range(WORD, len(best), WORD):
            part = block.bits[:, best[start : start + WORD]]
            out[:, WORD : WORD + part.shape[1]] |= part
        return np.ascontiguousarray(np.packbits(out, axis=1).view(np.uint64).T)

    return words(one), words(two)


def _alike(block: _Block, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names by length, and those of one length in groups of ``ALIKE`` at most, split by the bit that half of them have; where the groups begin, and the end."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8), axis=1)
    order, begins = [], [0]
    by_length = np.argsort(block.lengths, kind="stable")
    todo = np.split(by_length, np.flatnonzero(np.diff(block.lengths[by_length])) + 1)[::-1]
    while todo:
        some = todo.pop()
        if len(some) > ALIKE:
            have = bits[some].sum(axis=0)
            b = np.argmin(np.abs(2 * have.astype(np.int64) - len(some)))
            if 0 < have[b] < len(some):
                todo += [some[bits[some, b] == 1], some[bits[some, b] == 0]]
            else:
                todo += [some[ALIKE:], some[:ALIKE]]
            continue
        order.append(some)
        begins.append(begins[-1] + len(some))
    return np.concatenate(order), np.array(begins)


def _subsequence(one: _Block, x: np.ndarray, two: _Block, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of names of one word or less."""
    rest = np.full(len(x), ~np.uint64(0))
    where, begin = one.where.ravel(), x * one.where.shape[1]
    codes = np.ascontiguousarray(two.codes[y, : int(two.lengths[y].max(initial=0))].T)
    for code in codes:
        here = where.take(begin + code)
        here &= rest
        # (rest + here) | (rest - here): what is in here is in rest
        there = rest + here
        rest ^= here
        rest |= there
    return np.bitwise_count(~rest).astype(np.int64)


def _near(one: _Block, two: _Block, limit: float):
    """(x, y) of the pairs whose letters leave them possible, some at a time."""
    if not one.names or not two.names:
        return
    words_one, words_two = _letter_words(one, two)
    # how many characters may be in one name only, by the length of both
    total = np.arange(int(one.lengths.max() + two.lengths.max()) + 1)
    table = np.floor(total - limit * total + 1e-6).astype(np.int64)
    of_one, groups = _alike(one, words_one[0])
    of_two = of_one if one is two else np.argsort(two.lengths, kind="stable")
    first_one, first_two = np.ascontiguousarray(words_one[0][of_one]), np.ascontiguousarray(words_two[0][of_two])
    length_one, length_two = one.lengths[of_one], two.lengths[of_two]
    # of the bits that all names of a group have alike, how many others differ there
    all_have, any_has = np.bitwise_and.reduceat(first_one, groups[:-1]), np.bitwise_or.reduceat(first_one, groups[:-1])
    alike = ~(all_have ^ any_has)
    differ, counts = np.empty(ALIKE * COLUMNS, np.uint64), np.empty(ALIKE * COLUMNS, np.uint8)
    near = np.empty(ALIKE * COLUMNS + 8, bool)
    held, size = [], 0

    def places(cells: int, may: int) -> np.ndarray:
        """Of that many words in ``differ``, those with ``may`` bits at most; eight at a time, as most have more."""
        np.bitwise_count(differ[:cells], out=counts[:cells])
        np.less_equal(counts[:cells], may, out=near[:cells])
        near[cells : cells + 8] = False
        whole = near[: -(-cells // 8) * 8]
        eights = np.flatnonzero(whole.view(np.uint64))
        found = np.flatnonzero(whole.reshape(-1, 8)[eights])
        return eights[found >> 3] * 8 + (found & 7)

    def checked():
        x, y = (of.take(np.concatenate(z)) for of, z in zip((of_one, of_two), zip(*held, strict=True), strict=True))
        bits = np.zeros(len(x), dtype=np.uint16)
        for w in range(2):
            bits += np.bitwise_count(words_one[w].take(x) ^ words_two[w].take(y))
        may = table.take(one.lengths.take(x) + two.lengths.take(y))
        good = np.flatnonzero(bits <= may)
        x, y, may = x.take(good), y.take(good), may.take(good)
        bits = np.zeros(len(x), dtype=np.uint16)
        for w in range(4):
            bits += np.bitwise_count(one.twos[w].take(x) ^ two.twos[w].take(y))
        good = bits <= 3 * may
        return (np.minimum(x[good], y[good]), np.maximum(x[good], y[good])) if one is two else (x[good], y[good])

    for c in range(0, len(of_two), COLUMNS):
        columns = first_two[c : c + COLUMNS]
        shortest, longest = int(length_two[c]), int(length_two[c + len(columns) - 1])
        for g, (r, end) in enumerate(zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True)):
            if one is two and r >= c + len(columns):
                break
            length = int(length_one[r])
            may = min(int(table[longest + length]), WORD)
            if max(shortest - length, length - longest) > may:
                continue
            np.bitwise_xor(columns, all_have[g], out=differ[: len(columns)])
            np.bitwise_and(differ[: len(columns)], alike[g], out=differ[: len(columns)])
            some = places(len(columns), may)
            if not len(some):
                continue
            shape = (end - r, len(some))
            np.bitwise_xor(first_one[r:end, None], columns.take(some), out=differ[: shape[0] * shape[1]].reshape(shape))
            x, y = np.divmod(places(shape[0] * shape[1], may), len(some))
            x, y = x + r, some[y] + c
            if one is two:
                x, y = x[x < y], y[x < y]
            if not len(x):
                continue
            held.append((x, y))
            size += len(x)
            if size >= AT_ONCE:
                yield checked()
                held, size = [], 0
    if size:
        yield checked()


def _hopeful(one: _Block, two: _Block, limit: float):
    """(x, y) of the pairs that the bounds leave, some at a time."""
    held, size = [], 0

    def checked():
        x, y = (np.concatenate(z) for z in zip(*held, strict=True))
        total = one.lengths[x] + two.lengths[y]
        good = (one.lengths[x] > WORD) | (two.lengths[y] > WORD)
        told = np.flatnonzero(~good)
        good[told] = 2 * _subsequence(one, x[told], two, y[told]) >= limit * total[told] - 1e-9
        return x[good], y[good]

    for x, y in _near(one, two, limit):
        held.append((x, y))
        size += len(x)
        if size >= AT_ONCE:
            yield checked()
            held, size = [], 0
    if size:
        yield checked()


def _matched(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Characters that difflib's matcher matches in rows of codes of lengths la and lb: those of the longest common run, the first one in a and then in b, and in the
    same way what stands before it in both, and behind it in both. (Its rule for popular characters begins at 200.)"""
    total = np.zeros(len(a), dtype=np.int64)
    zero = np.zeros(len(a), dtype=np.int64)
    pair, alo, ahi, blo, bhi = np.arange(len(a)), zero, la.astype(np.int64), zero, lb.astype(np.int64)
    while len(pair):
        high, wide = int((ahi - alo).max()), int((bhi - blo).max())
        i, j = np.arange(high), np.arange(wide)
        left = np.where(i < (ahi - alo)[:, None], a[pair[:, None], np.minimum(alo[:, None] + i, a.shape[1] - 1)], 255)
        right = np.where(j < (bhi - blo)[:, None], b[pair[:, None], np.minimum(blo[:, None] + j, b.shape[1] - 1)], 254)
        # columns of pairs: runs that end at (i, j)
        left, right = np.ascontiguousarray(left.T).astype(np.uint8), np.ascontiguousarray(right.T).astype(np.uint8)
        runs = np.zeros((wide + 1, len(pair)), dtype=np.uint8)
        best, ai, bj = (np.zeros(len(pair), dtype=np.int64) for _ in range(3))
        for k in range(high):
            runs[1:] = (runs[:-1] + 1) * (right == left[k])
            longest = runs.max(axis=0)
            more = np.flatnonzero(longest > best)
            if len(more):
                best[more] = longest[more]
                ai[more] = k + 1
                bj[more] = runs[:, more].argmax(axis=0)
        np.add.at(total, pair, best)
        ai, bj = ai - best + alo, bj - best + blo
        parts = [(pair, alo, ai, blo, bj), (pair, ai + best, ahi, bj + best, bhi)]
        pair, alo, ahi, blo, bhi = (np.concatenate(z) for z in zip(*[[v[(best > 0) & (p[1] < p[2]) & (p[3] < p[4])] for v in p] for p in parts], strict=True))
    return total


def _ratios(one: _Block, x: np.ndarray, two: _Block, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ratios of the pairs with the name that is first in order as the matcher's first, and whether that is y's."""
    turned = np.fromiter((one.names[i] > two.names[j] for i, j in zip(x.tolist(), y.tolist(), strict=True)), dtype=bool, count=len(x))
    la, lb = one.lengths[x], two.lengths[y]
    out = np.zeros(len(x))
    short = np.flatnonzero((la <= WORD) & (lb <= WORD))
    for start in range(0, len(short), MATCHED):
        p = short[start : start + MATCHED]
        t, u, v = turned[p], one.codes[x[p]], two.codes[y[p]]
        m = _matched(np.where(t[:, None], v, u), np.where(t[:, None], u, v), np.where(t, lb[p], la[p]), np.where(t, la[p], lb[p]))
        out[p] = 2.0 * m / (la[p] + lb[p])
    for p in np.flatnonzero((la > WORD) | (lb > WORD)).tolist():
        out[p] = SequenceMatcher(None, *sorted((one.names[x[p]], two.names[y[p]]))).ratio()
    return out, turned


def similar_names(files: DataFrame, limit: float = 0.82) -> DataFrame:
    """(a, b, ratio) of distinct normalised names that reach ``limit``; equal names are groups, not pairs."""
    if not 0.5 < limit <= 1:
        raise ValueError("limit is over 0.5 and at most 1")
    named = cut(files.select(names.normalised(names.basename(F.coalesce("archive_member", "path"))).alias("a")).where("a <> ''").distinct(), "names")
    blocks = max(LEAST_BLOCKS, -(-named.count() // BLOCK))
    dealt = named.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("bi", F.least("block", "_other")).withColumn("bj", F.greatest("block", "_other")).drop("_other")

    def compared(table: pa.Table) -> pa.Table:
        i, j = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        home, every = table.column("block").to_pylist(), table.column("a").to_pylist()
        one = _Block([x for x, at in zip(every, home, strict=True) if at == i])
        two = one if i == j else _Block([x for x, at in zip(every, home, strict=True) if at == j])
        out = []
        for x, y in _hopeful(one, two, limit):
            ratio, turned = _ratios(one, x, two, y)
            good = ratio >= limit
            x, y, turned = x[good], y[good] + len(one.names), turned[good]
            out.append((np.where(turned, y, x), np.where(turned, x, y), ratio[good]))
        a, b, ratio = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3
        both = pa.array(one.names + two.names, pa.string())
        return pa.table({"a": both.take(pa.array(a)), "b": both.take(pa.array(b)), "ratio": pa.array(ratio, pa.float64())})

    # a number of its own: blocks are small in bytes, and would be put together in few tasks
    dealt = dealt.repartition(blocks * (blocks + 1) // 2, "bi", "bj")
    return dealt.groupBy("bi", "bj").applyInArrow(compared, "a string, b string, ratio double")
