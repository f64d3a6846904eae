"""Numbers for people, as Column expressions. Ties round to the even digit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNITS = ["B", "KB", "MB", "GB", "TB"]


def human_bytes(size: Column) -> Column:
    value = size.cast("double")
    out = None
    for k in reversed(range(len(UNITS))):
        scaled = F.format_string("%.1f " + UNITS[k], F.bround(value / float(1024**k), 1)) if k else F.concat(size.cast("string"), F.lit(" B"))
        out = scaled if out is None else F.when(value < float(1024 ** (k + 1)), scaled).otherwise(out)
    return out


def human_duration(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    whole = F.bround(s, 0).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return (
        F.when(s < 1, F.format_string("%.1fs", F.bround(s, 1)))
        .when(hours > 0, F.format_string("%dh %02dm %02ds", hours, minutes, rest))
        .when(minutes > 0, F.format_string("%dm %02ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def needed_to_expand(n: Column) -> Column:
    """Bytes and a margin of a tenth, 64 MiB at least."""
    return n + F.greatest(F.lit(64 << 20).cast("long"), F.floor(n * F.lit(0.10)))
