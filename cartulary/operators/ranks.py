"""Ranks and running sums within keys, without any task that holds a whole hot key.

Keys of up to ``hot`` rows are windows. The rows of larger keys are put in order over all tasks by ranges of (key, order); each range of a key is a window of its
own, and a sum over the small table of ranges gives each its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartulary.scratch import cut

HOT = 1 << 18


def running(rows: DataFrame, keys: list[str], order: list[Column], name: str, amount: Column | None = None, hot: int = HOT, sizes: DataFrame | None = None) -> DataFrame:
    """rows (read several times: a written table) with ``name``: the sum of ``amount`` over the rows of the same key before this one; without amount, their number, so
    the rank from 0. Rows that are equal in the order stand in either order. Null keys have no place here: their rows go.

    sizes: a written table of the keys and ``_n``, their rows, where that is known already.
    """
    one = F.lit(1).cast("long") if amount is None else amount.cast("long")
    kept = rows
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    counted = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes
    large = cut(counted.where(F.col("_n") > hot), "hot_keys")
    before = lambda *more: Window.partitionBy(*keys, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    small_sum = F.coalesce(F.sum(one).over(before()), F.lit(0).cast("long"))
    size = large.agg(F.coalesce(F.sum("_n"), F.lit(0))).collect()[0][0]
    large = large.select(*keys)
    if not size:
        return kept.withColumn(name, small_sum)
    rest = kept.join(large, keys, "left_anti").withColumn(name, small_sum)
    in_order = kept.join(large, keys, "left_semi").repartitionByRange(1 + size // hot, *keys, *order)
    dealt = cut(in_order.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(one).alias("_sum"))
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    local = dealt.withColumn(name, F.coalesce(F.sum(one).over(before("_range")), F.lit(0).cast("long")))
    placed = local.join(offsets.drop("_sum"), [*keys, "_range"]).withColumn(name, F.col(name) + F.col("_offset"))
    return rest.unionByName(placed.select(*rest.columns))
