"""Connected components of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartulary.scratch import cut, drop


def components(links: DataFrame) -> DataFrame:
    """key, comp: the least key of each node's component, by hooking to the least neighbour and pointer jumping until nothing changes."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["key"]).groupBy("a").agg(F.min("comp").alias("near"))
        hooked = labels.join(near, labels["key"] == near["a"]).select("key", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("key").alias("_k"), F.col("comp").alias("_c"))
        step = cut(hooked.join(up, hooked["comp"] == up["_k"], "left").select("key", "was", F.least("comp", F.coalesce("_c", "comp")).alias("comp")), "labels")
        drop(labels)
        labels = step
        if not step.where("was <> comp").limit(1).count():
            drop(edges)
            return labels.select("key", "comp")
