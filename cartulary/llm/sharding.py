"""Operator 9, sharding by proportional stratified interleaving, law ``rows``: shard sizes differ by one row at most.

Only DataFrame expressions. Each source's rows are shuffled by a seeded hash and ranked; rank / size of the source is the
fractional rank; all rows sorted by it interleave the sources in proportion, so every stretch of the order, and every shard cut from it,
has the mixture of the whole. A source's ranks are shifted by a hashed part of one step, so that many small sources spread
over the order and don't meet at one place.

No rank needs a source, or all rows, in one task. Ranks are counted in two steps: rows fall into ranges of the sort key (the seeded
hash, or the fractional rank), which a source of any size fills evenly; a running sum over the small table of range counts
gives each range its offset; and only within a range are rows sorted. The number of ranges follows the number of rows, so a
range holds about ``rows_per_range`` rows.

Nulls and edges: rows with a null source form a stratum of their own; a null text has size 1 and checksum 0 (no bytes); rows that
are equal in id and text get neighbouring slots in either order, with equal contents; a null doc_id is returned as null and ranks
first among equal hashes; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SHARDS = 16
SEED = 20_240_229
ROWS_PER_RANGE = 2048
MAX_RANGES = 1 << 18


def _ranked(rows: DataFrame, strata: list[str], part: Column, order: list[Column], name: str) -> DataFrame:
    """rows with ``name``: position from 0 within the stratum by (part, order). part: a range number that rises with the order."""
    ranged = rows.withColumn("_part", part)
    counts = ranged.groupBy(*strata, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_k_{c}") for c in strata], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*strata, "_part").orderBy(*order)
    local = ranged.withColumn("_i", F.row_number().over(within) - 1)
    same = [local[c] == offsets[f"_k_{c}"] for c in strata] + [local["_part"] == offsets["_p"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return local.join(offsets, on).withColumn(name, F.col("_off") + F.col("_i")).drop("_i", "_off", "_part", "_p", *[f"_k_{c}" for c in strata])


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col))).alias("_source"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1).alias("_h"),
    )
    totals = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_total"))
    every = totals.agg(F.coalesce(F.sum("_total"), F.lit(0)).alias("_all"))
    n = every.select(F.col("_all")).scalar()
    ranges = F.least(F.lit(MAX_RANGES), F.greatest(F.lit(1), F.ceil(n / rows_per_range))).cast("long")
    # the hash as a fraction of its range, from 0 to below 1
    spread = F.col("_h") / F.lit(float(1 << 63))
    shuffled = _ranked(rows, ["_source"], F.least(F.floor(spread * ranges), ranges - 1), [F.col("_h"), F.col("doc_id"), F.col("text_crc32")], "_rank")
    step = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_source")), 11) / F.lit(float(1 << 53))
    placed = shuffled.join(totals.withColumnRenamed("_source", "_s"), F.col("_source") == F.col("_s")).select(
        "doc_id", "size", "text_crc32", "_source", "_h", ((F.col("_rank") + step) / F.col("_total")).alias("_at"), F.lit(0).alias("_one")
    )
    ordered = _ranked(placed, ["_one"], F.least(F.floor(F.col("_at") * ranges), ranges - 1), [F.col("_at"), F.col("_source"), F.col("_h"), F.col("doc_id"), F.col("text_crc32")], "_pos")
    number = F.floor(F.col("_pos") * shards / n).cast("int")
    first = F.ceil(F.col("shard") * n / shards)
    return ordered.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), number.alias("shard"), "_pos").select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("_pos") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op9_stratified_shards(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
