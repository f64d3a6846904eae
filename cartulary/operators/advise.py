"""Recommendations from path statistics. Every answer is one pass over the files: counts by group, then rules on one small row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cartulary.functions import names
from cartulary.operators.layout import LAYOUTS

#: What folder names tell.
YEAR_MONTH = r"(?:^|/)((?:19|20)\d{2})[/_\-](0[1-9]|1[0-2])(?:/|$)"
YEAR_ONLY = r"(?:^|/)((?:19|20)\d{2})(?:/|$)"
EXT_FOLDER = r"(?i)(?:^|/)(jpe?g|png|gif|webp|heic|tiff?|pdf|docx?|xlsx?|pptx?|txt|csv|mp4|mov|mkv|avi|mp3|wav|flac|zip|rar|7z)(?:/|$)"
FLAT_HINT = r"(?i)(?:^|/)(downloads?|desktop|misc|unsorted|dump|inbox|temp|tmp)(?:/|$)"

SIGNALS = ["year_month", "year_only", "ext_folder", "flat_hint", "shallow", "total"]

#: Layouts in order of fit, by what the files are.
FITS = {
    "media": ["media_library", "life_areas", "type_date", "by_year_month", "active_archive"],
    "documents": ["life_areas", "documents_first", "para", "by_extension", "type_date"],
    "mixed": ["life_areas", "type_date", "para", "active_archive", "by_type"],
    "few": ["by_type", "life_areas", "type_date", "by_extension"],
    "none": ["type_date"],
}


def path_text(path: Column) -> Column:
    return F.lower(F.when(path.contains("/"), names.parent(path)).otherwise("."))


def _signals() -> list[Column]:
    p = F.col("_p")
    dated = p.rlike(YEAR_MONTH)
    slashes = F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
    return [
        F.count_if(dated).alias("year_month"),
        F.count_if(~dated & p.rlike(YEAR_ONLY)).alias("year_only"),
        F.count_if(p.rlike(EXT_FOLDER)).alias("ext_folder"),
        F.count_if(p.rlike(FLAT_HINT)).alias("flat_hint"),
        F.count_if(slashes <= 2).alias("shallow"),
        F.count(F.lit(1)).alias("total"),
    ]


def path_signals(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Signal counts for all files (category null) and for each category, in one pass; within each group of ``by``."""
    rows = files.withColumn("_p", path_text(F.col("path")))
    keys = [*(by or []), "category"]
    sets = [[F.col(k) for k in keys], [F.col(k) for k in by or []]]
    return rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(*_signals()).select(*[F.col(k) for k in keys], *SIGNALS)


def advice_facts(files: DataFrame) -> DataFrame:
    """One row: total, deep, media_share, documents, and the advice that applies."""
    media = F.col("category").isin(*names.MEDIA)
    depth = F.size(F.split("path", "/"))
    facts = files.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(depth >= 10).alias("deep"), F.count_if(media).alias("media"), F.count_if(F.col("category") == "Documents").alias("documents")
    )
    return facts.select(
        "total", "deep", "media", "documents", (F.col("deep") > 0).alias("warn_deep"), (F.col("total") >= 100).alias("large_library"),
        F.coalesce(F.col("media") / F.nullif("total", F.lit(0)) >= 0.5, F.lit(False)).alias("media_heavy"), (F.col("documents") > 0).alias("has_documents"),
    )


def _counts(files: DataFrame, by: list[str]) -> DataFrame:
    one = lambda c: F.count_if(F.col("category") == c).alias(f"n_{c}")
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all"), *[one(c) for c in names.CATEGORIES], F.count_distinct("category").alias("n_categories"))


def _layout_rank() -> Column:
    media = (F.col("n_Photos") + F.col("n_Videos") + F.col("n_Audio")) / F.col("n_all")
    docs = F.col("n_Documents") / F.col("n_all")
    kind = lambda k: F.array_distinct(F.array(*[F.lit(x) for x in [*FITS[k], *LAYOUTS]]))
    return F.when(F.col("n_all") == 0, kind("none")).when((media >= 0.6) & (docs <= 0.25), kind("media")).when(docs >= 0.5, kind("documents")).when(F.col("n_categories") >= 3, kind("mixed")).otherwise(kind("few"))


def layout_rank(files: DataFrame, by: str = "source_root") -> DataFrame:
    """by, place (from 1), layout: all layouts, the best fit first."""
    ranked = _counts(files, [by]).select(by, F.posexplode(_layout_rank()).alias("place", "layout"))
    return ranked.select(by, (F.col("place") + 1).alias("place"), "layout")


def suggestion(files: DataFrame, by: str = "source_root", saved_depth: str = "year_month", saved_by_ext: bool = True, saved_modes: dict[str, str] | None = None, saved_layouts: list[str] | None = None) -> DataFrame:
    """One row for each library: layout_ids, media_date_depth, documents_by_ext, and a mode for each category."""
    saved_modes = saved_modes or {}
    signals = path_signals(files, [by])
    share = lambda s: F.col(s) / F.greatest(F.col("total"), F.lit(1))
    counts = _counts(files, [by])
    whole = signals.where("category is null").drop("category").join(counts, by)
    media = (F.col("n_Photos") + F.col("n_Videos") + F.col("n_Audio")) / F.greatest(F.col("n_all"), F.lit(1))
    flat = (share("flat_hint") + share("shallow")) / 2
    depth = (
        F.when(share("year_month") >= 0.15, "year_month")
        .when((share("year_only") >= 0.15) & (share("year_month") < 0.08), "year")
        .when((share("flat_hint") >= 0.35) | (flat >= 0.55), "none")
        .when(media >= 0.45, saved_depth if saved_depth in ("year", "year_month") else "year_month")
        .when(media < 0.2, "none")
        .otherwise(saved_depth)
    )
    top = F.get(_layout_rank(), F.lit(0))
    several = [x for x in LAYOUTS if x in (saved_layouts or [])]
    ids = F.array(top)
    if len(several) > 1 and "custom" not in several:
        ids = F.when(F.array_contains(F.array(*[F.lit(x) for x in several]), top), F.array(*[F.lit(x) for x in several])).otherwise(ids)
    base = whole.select(by, ids.alias("layout_ids"), depth.alias("media_date_depth"))
    each = signals.where("category is not null").join(base.select(by, "media_date_depth"), by)
    cat = F.col("category")
    mode = (
        F.when((cat == "Documents") & (share("ext_folder") >= 0.2), "extension")
        .when(cat.isin(*names.MEDIA) & (share("year_month") >= 0.2), "year_month")
        .when(cat.isin(*names.MEDIA) & (share("year_only") >= 0.2), "year")
        .when(cat.isin(*names.MEDIA) & (flat >= 0.6) & (F.col("media_date_depth") != "none"), "flat")
        .when(cat.isin("Archives", "Other") & (flat >= 0.55), "flat")
        .when((cat == "Documents") & (flat >= 0.55) & (share("ext_folder") < 0.1), "flat")
        .otherwise("layout_default")
    )
    by_ext = F.when(share("ext_folder") >= 0.2, True).when((share("shallow") >= 0.6) & (share("ext_folder") < 0.08), False).otherwise(saved_by_ext)
    modes = each.select(by, "category", mode.alias("mode"), by_ext.alias("by_ext"))
    wide = modes.groupBy(by).agg(
        *[F.max(F.when(cat == c, F.col("mode"))).alias(f"mode_{c}") for c in names.CATEGORIES], F.max(F.when(cat == "Documents", F.col("by_ext"))).alias("documents_by_ext")
    )
    final = lambda c: F.when(F.coalesce(F.col(f"mode_{c}"), F.lit("layout_default")) == "layout_default", saved_modes.get(c, "layout_default")).otherwise(F.col(f"mode_{c}")).alias(f"mode_{c}")
    return base.join(wide, by).select(by, F.array_join("layout_ids", ",").alias("layout_ids"), "media_date_depth", F.coalesce("documents_by_ext", F.lit(saved_by_ext)).alias("documents_by_ext"), *[final(c) for c in names.CATEGORIES])
