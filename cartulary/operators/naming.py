"""Collision-free names in plan order, by the arithmetic of gaps.

A row gets the name it wants if that is free; else the first free one of ``stem_1.ext``, ``stem_2.ext``, ... A name is taken by the files already there, by
the first row that wants it, or by a row that is numbered onto it, whichever is first.

Of one wanted path, the rows that need a number are ranked in plan order; the j-th of them gets the j-th free number. Which numbers are not free is known from
the few paths that look numbered and are wanted or there (``_links``): with the blocked numbers e_1 < e_2 < ... the j-th free one is j plus the number of blocked e_i
with e_i - (i - 1) <= j, a rank in the merged order of both. A link whose name the plan wants only later than the row that comes to it is not
blocked: that row takes it, and the rows that want it all need numbers. Which of both happens depends on times that depend on other links, so it is settled in
rounds of joins until nothing changes; links are settled in the order of time, and most stand in the first round.

No row holds a list of numbers, and neither a name's rows nor a family's are gathered in a task: ranks and sums within hot keys are made range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartulary.functions import names
from cartulary.operators.ranks import HOT, running
from cartulary.scratch import cut, drop


def _numbered_path(path: Column, k: Column) -> Column:
    suffix = names.suffix(names.basename(path))
    front = F.substring(path, F.lit(1), F.length(path) - F.length(suffix))
    return F.when(k == 0, path).otherwise(F.concat(front, F.lit("_"), k.cast("string"), suffix))


def _bases(path: Column) -> Column:
    """The paths whose numbering can make this one, each with its number: at most two, as ``a_2._1`` is both the second of ``a._1`` and the first of ``a_2.``."""
    name = names.basename(path)
    pattern = r"(?s)^(.+)_([1-9]\d{0,17})$"
    inner = F.struct(F.concat(names.parent(path), F.lit("/"), F.regexp_extract(names.stem(name), pattern, 1), names.suffix(name)).alias("base"), F.regexp_extract(names.stem(name), pattern, 2).alias("k"))
    bare = F.regexp_extract(name, pattern, 1)
    outer = F.struct(F.concat(names.parent(path), F.lit("/"), bare).alias("base"), F.regexp_extract(name, pattern, 2).alias("k"))
    both = F.array(inner, F.when((names.suffix(bare) == "") & (names.suffix(name) != ""), outer))
    return F.filter(both, lambda x: x.isNotNull() & (x["k"] != ""))


def _links(paths: DataFrame) -> DataFrame:
    """base, k, name: wanted or present names that the numbering of a wanted path can come to; first: the first row that wants the name; there: whether it is present."""
    named = paths.select(F.col("destination").alias("name"), "first", "there", F.explode(_bases(F.col("destination"))).alias("_b"))
    found = named.select(F.col("_b.base").alias("base"), F.col("_b.k").cast("long").alias("k"), "name", "first", "there")
    wanted = paths.where("n > 0").select(F.col("destination").alias("base"), F.col("n").alias("_n"))
    known = cut(found.join(wanted, "base"), "links")
    # n rows pass over m names at most
    most = known.groupBy("base").agg(F.count(F.lit(1)).alias("_m"))
    return known.join(most, "base").where(F.col("k") <= F.col("_n") + F.col("_m")).select("base", "k", "name", "first", "there")


def _reached(links: DataFrame, state: DataFrame, paths: DataFrame, rows: DataFrame, hot: int) -> DataFrame:
    """links with takes: the order number of the row that takes the name, null if none does, under the present state (base, k, name, blocked).

    A link of number k is reached by the row in need number j = k - the blocked ones before it.
    """
    counted = running(cut(state, "state"), ["base"], [F.col("k")], "_before", F.col("blocked").cast("int"), hot)
    lost = paths.where("there").select("destination").unionByName(state.where("not blocked").select(F.col("name").alias("destination"))).distinct()
    sized = paths.select(F.col("destination").alias("base"), F.col("n").alias("_n"))
    needs = counted.join(lost.select(F.col("destination").alias("base"), F.lit(1).alias("_lost")), "base", "left").join(sized, "base")
    # ranks are from 0; the first row of a path that is not lost keeps its name
    at = F.col("k") - F.col("_before") - F.coalesce("_lost", F.lit(0))
    asked = needs.withColumn("_rank", at).where(F.col("_rank") < F.col("_n")).select("base", "k", "name", "_rank")
    met = asked.join(rows.select(F.col("destination").alias("base"), F.col("_rank"), F.col("ord").alias("takes")), ["base", "_rank"])
    return links.join(met.select("base", "k", "name", "takes"), ["base", "k", "name"], "left")


def _settled(links: DataFrame, paths: DataFrame, rows: DataFrame, hot: int) -> DataFrame:
    """base, k, name, blocked for every link: whether its name is taken when the numbering comes to it (or never comes)."""
    state = links.select("base", "k", "name", F.lit(True).alias("blocked"))
    while True:
        come = cut(_reached(links, state, paths, rows, hot), "reached")
        # a name of two bases is taken by the earlier comer
        firsts = come.where("takes is not null").groupBy("name").agg(F.min("takes").alias("_first"))
        judged = come.join(firsts, "name", "left").select(
            "base", "k", "name", (F.col("takes").isNull() | F.col("there") | F.coalesce(F.col("first") < F.col("takes"), F.lit(False)) | (F.col("_first") < F.col("takes"))).alias("blocked")
        )
        step = cut(judged, "settled")
        changed = step.join(state.select("base", "k", "name", F.col("blocked").alias("_was")), ["base", "k", "name"]).where("blocked <> _was").limit(1).count()
        drop(come)
        state = step
        if not changed:
            return state


def unique_names(plan: DataFrame, existing: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """plan (ord unique, id, destination) with final_destination and renamed. existing: destination, the files already there. Rows without a destination go.

    A path with more rows or numbered names than ``hot`` is ranked range by range.
    """
    wanted = cut(plan.where("destination is not null"), "plan")
    found = wanted.groupBy("destination").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    if existing is None:
        paths = found.withColumn("there", F.lit(False))
    else:
        held = existing.where("destination is not null").select("destination").distinct().withColumn("there", F.lit(True))
        paths = found.join(held, "destination", "full").select("destination", F.coalesce("n", F.lit(0)).alias("n"), "first", F.coalesce("there", F.lit(False)).alias("there"))
    paths = cut(paths, "paths")
    links = cut(_links(paths), "links")
    columns = plan.columns
    lost = paths.where("n > 0 and there").select("destination")
    rows = running(wanted, ["destination"], [F.col("ord")], "_rank", hot=hot, sizes=paths.select("destination", F.col("n").alias("_n")))
    if links.isEmpty():
        # ranked on the way out: nothing else reads the ranks
        if existing is None:
            ranked = rows.withColumn("_k", F.col("_rank"))
        else:
            ranked = rows.join(lost.withColumn("_lost", F.lit(1)), "destination", "left").withColumn("_k", F.col("_rank") + F.coalesce("_lost", F.lit(0)))
    else:
        rows = cut(rows, "ranked")
        narrow = cut(rows.join(links.select(F.col("base").alias("destination")).distinct(), "destination", "left_semi").select("destination", "_rank", "ord"), "linked")
        state = _settled(links, paths, narrow, hot)
        lost = lost.unionByName(state.where("not blocked").select(F.col("name").alias("destination"))).distinct()
        numbered = cut(rows.join(lost.withColumn("_lost", F.lit(1)), "destination", "left").withColumn("_k", F.col("_rank") + F.coalesce("_lost", F.lit(0))).drop("_lost"), "numbered")
        blocked = state.where("blocked").select(F.col("base").alias("destination"), F.col("k"))
        # the i-th blocked number stands before the row of need number e_i - (i - 1)
        gaps = running(cut(blocked.distinct(), "blocked"), ["destination"], [F.col("k")], "_i", hot=hot).select("destination", (F.col("k") - F.col("_i")).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(plan.schema["ord"].dataType).alias("ord"))
        touched = blocked.select("destination").distinct()
        needy = numbered.where("_k > 0").join(touched, "destination", "left_semi").select("destination", F.col("_k").alias("_at"), F.lit(1).alias("_kind"), "ord")
        merged = running(cut(gaps.unionByName(needy), "merged"), ["destination"], [F.col("_at"), F.col("_kind")], "_place", hot=hot)
        final = merged.where("_kind = 1").select("ord", (F.col("_place") + 1).alias("_final"))
        ranked = numbered.join(final, "ord", "left").withColumn("_k", F.coalesce("_final", "_k"))
    named = ranked.withColumn("final_destination", _numbered_path(F.col("destination"), F.col("_k")))
    return named.select(*columns, "final_destination").withColumn("renamed", F.col("final_destination") != F.col("destination"))
