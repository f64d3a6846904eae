"""Operator 13, source divergence audit: which sources of a language differ, and by which terms, over the terms that an iceberg query keeps.

Terms are runs of letters of A to Z (lower-cased) and of all characters beyond ASCII. A language keeps the terms that ``least`` or more of its documents hold.

* Iceberg prefix refinement. A level counts, for byte prefixes of ``FIRST_BYTES`` bytes, how many documents of the language hold a term with that prefix;
  a term that is no longer than that is its own prefix, counted as a complete term. Prefixes below ``least`` are discarded, since no term that they begin
  can reach it; the survivors are extended at the next level, of twice as many bytes. It ends when no incomplete prefix is left. So a long rare term,
  of which a corpus has most, is never shuffled or counted as a whole.
* A level is one pass over the texts. A task counts documents and occurrences by group and term and passes them on whenever it holds ``HELD`` of
  them; a sum by key follows. Survivors go to the next level as a bit map of their hashes of 2 ** ``MOST_BITS`` bits at most: a false positive
  is counted again and discarded again, so results don't depend on the map.
* Every group (lang, source) and each language give each kept term p = 1 + floor(10**9 (count + 2) / (N + 2 V)), all in integers.
* Pairs: f summed over all kept terms for each two sources of a language. Sources fall into blocks of some ``BLOCK_SOURCES`` and terms into ranges of some
  ``RANGE_TERMS`` by hash; a task compares two blocks over one range, and ranges are summed. Terms that neither block holds all give the same value,
  which is multiplied. Terms: the ``top`` of each group by f against the language.

Nulls and edges: null text, lang and source count as ''; a language of one source has no pairs; a group without terms takes part in pairs with all counts
0; a language without kept terms gives 0 for its pairs and no terms; repeated rows are documents of their own; an empty table gives no rows; doc_id and
extra columns are ignored, whatever their names. Very long texts are read in pieces cut between terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from cartulary.llm.batches import no_tables
from cartulary.scratch import cut, drop

#: Bytes of terms as they count, lower-cased; all others a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
LEAST = 10
TOP = 10
FIRST_BYTES = 10
HELD = 300_000
PIECE = 1 << 20
MOST_BITS = 25
BLOCK_SOURCES = 64
RANGE_TERMS = 4096
SCALE = 10**9


def _terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, of about ``PIECE`` bytes at a time; none is cut."""
    if len(data) <= PIECE:
        yield data.translate(TERM_BYTES).split()
        return
    at = 0
    while at < len(data):
        part = data[at : at + PIECE].translate(TERM_BYTES)
        end = at + PIECE
        while end < len(data) and (more := data[end : end + 64].translate(TERM_BYTES)).find(b" ") != 0:
            cut_at = more.find(b" ")
            part += more if cut_at < 0 else more[:cut_at]
            end += len(more) if cut_at < 0 else cut_at
            if cut_at >= 0:
                break
        yield part.split()
        at = end


def survivors_bit(key: bytes, bits: int) -> int:
    return xxhash.xxh64_intdigest(key, seed=42) & (1 << bits) - 1


def _level(docs: DataFrame, done: int, reach: int, alive) -> DataFrame:
    """lang, source, term, whole, docs, n of one level, by task: complete terms of ``done`` + 1 to ``reach`` bytes by source, and prefixes of ``reach`` bytes of longer terms (source null).

    alive: bit map of the prefixes of ``done`` bytes that survived, None at the first level.
    """
    names = ["lang", "source", "term", "whole", "docs", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_tables()
        bits = None if alive is None else np.frombuffer(alive.value, dtype=np.uint8)
        width = None if bits is None else (len(bits) * 8 - 1).bit_length()
        lives: dict[tuple[bytes, bytes], bool] = {}
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        longer: dict[bytes, Counter] = {}
        size = 0

        def living(lang: bytes, prefix: bytes) -> bool:
            got = lives.get((lang, prefix))
            if got is None:
                if len(lives) >= HELD:
                    lives.clear()
                at = survivors_bit(lang + b"\0" + prefix, width)
                got = lives[lang, prefix] = bool(bits[at >> 3] >> (at & 7) & 1)
            return got

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), (docs_of, times) in held.items():
                yield _rows(lang, source, docs_of, [times[t] for t in docs_of])
            for lang, docs_of in longer.items():
                yield _rows(lang, None, docs_of, [0] * len(docs_of))
            held.clear()
            longer.clear()

        for batch in batches:
            for lang, source, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not data:
                    continue
                docs_of, times = held.setdefault((lang, source), (Counter(), Counter()))
                prefixes = longer.setdefault(lang, Counter())
                before, seen = len(docs_of) + len(prefixes), set()
                for found in _terms(data):
                    if bits is not None:
                        # few terms are so long: each is looked up once
                        own = {t for t in set(found) if len(t) > done and living(lang, t[:done])}
                        found = [t for t in found if len(t) > done and t in own] if own else []
                    seen.update(found)
                    times.update([t for t in found if len(t) <= reach])
                long_ones = {t for t in seen if len(t) > reach}
                if long_ones:
                    prefixes.update({t[:reach] for t in long_ones})
                    seen -= long_ones
                docs_of.update(seen)
                size += len(docs_of) + len(prefixes) - before
                if size >= HELD:
                    yield from counted()
                    size = 0
        yield from counted()

    def _rows(lang: bytes, source: bytes | None, docs_of: Counter, times: list[int]) -> pa.RecordBatch:
        k = len(docs_of)
        columns = [pa.array([lang] * k, pa.binary()), pa.array([source] * k, pa.binary()), pa.array(list(docs_of), pa.binary()), pa.array([source is not None] * k, pa.bool_())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(docs_of.values()), pa.int64()), pa.array(times, pa.int64())], names=names)

    return docs.mapInArrow(run, "lang binary, source binary, term binary, whole boolean, docs long, n long")


def _bit_map(prefixes: DataFrame, count: int) -> bytes:
    """The hashes of the survivors as bits, 16 a survivor up to 2 ** MOST_BITS."""
    bits = min(MOST_BITS, max(16, (16 * count).bit_length()))
    place = F.xxhash64(F.concat("lang", F.lit(b"\0"), "term")).bitwiseAND(F.lit((1 << bits) - 1))
    # Spark's bit maps hold 32768 bits each
    rows = prefixes.select(place.alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(32768))).alias("bits"))
    out = bytearray(1 << bits - 3)
    for row in rows.collect():  # 4 KB each, out's size in all
        out[row["bucket"] * 4096 : (row["bucket"] + 1) * 4096] = row["bits"]
    return bytes(out)


def iceberg_terms(docs: DataFrame, least: int = LEAST, first: int = FIRST_BYTES) -> DataFrame:
    """A written table of lang, source, term (binary), n: occurrences of each kept term in each group that holds it. docs: lang, source, text, all binary."""
    context = docs.sparkSession.sparkContext
    tables, alive, done, reach = [], None, 0, first
    while True:
        # the tasks' rows are sums already: they are dealt by term at once, and both the sum by source and that over the sources find them there
        dealt = _level(docs, done, reach, alive).repartition("lang", "term", "whole")
        rows = dealt.groupBy("lang", "source", "term", "whole").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        holders = F.sum("docs").over(Window.partitionBy("lang", "term", "whole"))
        level = cut(rows.withColumn("holders", holders).where(F.col("holders") >= least).select("lang", "source", "term", "whole", "n"), "level")
        tables.append(level)
        if alive is not None:
            alive.unpersist()
        prefixes = level.where("not whole")
        count = prefixes.count()
        if not count:
            break
        alive = context.broadcast(_bit_map(prefixes, count))
        done, reach = reach, 2 * reach
    every = tables[0]
    for level in tables[1:]:
        every = every.unionByName(level)
    kept = cut(every.where("whole").select("lang", "source", "term", "n"), "kept")
    for level in tables:
        drop(level)
    return kept


def _p(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (count + 2) / (total + 2 terms)), exact for totals up to 10**18."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(count + 2) * F.lit(SCALE), wide(total + 2 * terms)).cast("long") + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def exact_p(counts: np.ndarray, divisor: np.ndarray) -> np.ndarray:
    """As _p, in long division by thousands: no step leaves 64 bits for divisors below 9 * 10**15."""
    rest = counts + 2
    out = rest // divisor
    rest = rest % divisor
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // divisor
        rest = rest % divisor
    return 1 + out


def _compared(table: pa.Table) -> pa.Table:
    """Rows (bi, bj, block, source, divisor, term, n) of one language, two blocks and a range of terms: sums of f for each two sources, and the number of terms.

    A row without a term stands for its source, which may hold none.
    """
    block = table.column("block").to_numpy()
    bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
    sources = table.column("source").combine_chunks().dictionary_encode()
    terms = table.column("term").combine_chunks().dictionary_encode()
    who, names = sources.indices.to_numpy(), sources.dictionary
    size = len(terms.dictionary)
    divisor, home = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    divisor[who], home[who] = table.column("divisor").to_numpy(), block
    counts = np.zeros((len(names), size), dtype=np.int64)
    has = terms.indices.is_valid().to_numpy(zero_copy_only=False)
    at = terms.indices.fill_null(0).to_numpy()
    counts[who[has], at[has]] = table.column("n").to_numpy()[has]
    p = np.ones_like(counts)
    for k in range(len(names)):
        if size:
            p[k] = exact_p(counts[k], divisor[k])
    out = []
    for a in np.flatnonzero(home == bi):
        others = np.flatnonzero(home == bj)
        others = others[others > a] if bi == bj else others
        if len(others):
            apart, both = p[others] - p[a], p[others] + p[a]
            sums = (apart * apart // both).sum(axis=1)
            one = names[int(a)].as_py()
            # by name: the order of rows, and of the dictionary with it, is another in each range
            out += [(*sorted((one, names[int(b)].as_py())), int(s)) for b, s in zip(others, sums, strict=True)]
    a, b, sums = zip(*out, strict=True) if out else ((), (), ())
    lang = pa.array([table.column("lang")[0].as_py()] * len(a), pa.binary())
    return pa.table([lang, pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sums, pa.int64()), pa.array([size] * len(a), pa.int64())], names=["lang", "a", "b", "value", "seen"])


def pair_values(kept: DataFrame, groups: DataFrame, block_sources: int = BLOCK_SOURCES, range_terms: int = RANGE_TERMS) -> DataFrame:
    """lang, source, item, value for each source and each other one of its language. groups: lang, source, total (occurrences of kept terms), kinds (kept terms of the language), peers (sources of the language)."""
    blocks = F.ceil(F.col("peers") / block_sources).cast("int")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("kinds") / range_terms)).cast("int")
    block = F.pmod(F.xxhash64("source"), blocks).cast("int")
    sided = groups.where("peers > 1").select("lang", "source", (F.col("total") + 2 * F.col("kinds")).alias("divisor"), block.alias("block"), blocks.alias("blocks"), ranges.alias("ranges"))
    held = kept.join(sided, ["lang", "source"]).withColumn("range", F.pmod(F.xxhash64("term"), F.col("ranges")).cast("int"))
    stands = sided.withColumn("term", F.lit(None).cast("binary")).withColumn("n", F.lit(0).cast("long")).withColumn("range", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)))
    columns = ["lang", "source", "divisor", "block", "blocks", "term", "n", "range"]
    dealt = held.select(*columns).unionByName(stands.select(*columns)).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("bi", F.least("block", "_other")).withColumn("bj", F.greatest("block", "_other"))
    found = dealt.select("lang", "bi", "bj", "range", "block", "source", "divisor", "term", "n").groupBy("lang", "bi", "bj", "range").applyInArrow(
        _compared, "lang binary, a binary, b binary, value long, seen long"
    )
    summed = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    sizes = groups.select("lang", "source", "total", "kinds")
    one = sizes.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "kinds")
    two = sizes.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
    none = F.lit(0).cast("long")
    unseen = (F.col("kinds") - F.col("seen")) * _f(_p(none, F.col("total_a"), F.col("kinds")), _p(none, F.col("total_b"), F.col("kinds")))
    whole = summed.join(one, ["lang", "a"]).join(two, ["lang", "b"]).withColumn("value", F.when(F.col("kinds") > F.col("seen"), F.col("value") + unseen).otherwise(F.col("value")))
    whole = cut(whole.select("lang", "a", "b", "value"), "pairs")
    return whole.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(whole.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each kept term that a group holds with a higher p than its language."""
    whole = kept.groupBy("lang", "term").agg(F.sum("n").alias("m"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    rows = kept.join(whole, ["lang", "term"]).join(groups.select("lang", "source", "total", "kinds"), ["lang", "source"]).join(totals, "lang")
    judged = rows.select("lang", "source", F.col("term").alias("item"), _p(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), _p(F.col("m"), F.col("lang_total"), F.col("kinds")).alias("q"))
    return judged.where("p > q").select("lang", "source", "item", _f(F.col("p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (part ``pair``), and the ``top`` terms (part ``term``)."""
    data = lambda c: F.coalesce(F.col(c).cast("binary"), F.lit(b""))
    rows = docs.select(data(lang_col).alias("lang"), data(source_col).alias("source"), data(text_col).alias("text"))
    kept = iceberg_terms(rows, least)
    counts = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    every = rows.select("lang", "source").distinct()
    sources = every.groupBy("lang").agg(F.count(F.lit(1)).alias("peers"))
    sized = every.join(counts, ["lang", "source"], "left").join(terms, "lang", "left").join(sources, "lang")
    groups = cut(sized.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("kinds", F.lit(0)).cast("long").alias("kinds"), "peers"), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, groups).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    best = term_values(kept, groups).withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    text = lambda c: F.col(c).cast("string").alias(c)
    return pairs.unionByName(best).select(text("lang"), text("source"), "part", text("item"), "value", "rank")


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP13_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
c as (select r, lang, source, term, count(*) as n from w group by all),
k as (select lang, term, sum(n)::bigint as m from c group by all having count(*) >= 10),
v as (select lang, count(*) as v, sum(m)::bigint as mm from k group by lang),
g as (select distinct lang, source from d),
o as (select c.lang, c.source, c.term, sum(c.n)::bigint as n from c join k on c.lang = k.lang and c.term = k.term group by all),
s as (select lang, source, sum(n)::bigint as nn from o group by all),
e as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(o.n, 0) + 2) // (coalesce(s.nn, 0) + 2 * v.v))::bigint as p,
  1 + (1000000000::hugeint * (k.m + 2) // (v.mm + 2 * v.v))::bigint as q
  from g join k on g.lang = k.lang join v on v.lang = g.lang left join s on s.lang = g.lang and s.source = g.source left join o on o.lang = g.lang and o.source = g.source and o.term = k.term),
x as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
  from e a join e b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from e where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""
