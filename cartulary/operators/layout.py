"""Layout planning: a destination path for each file, as one expression per layout, and what follows from a plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartulary.functions import names
from cartulary.operators.naming import unique_names

#: The layouts in the order in which they combine.
LAYOUTS = [
    "type_date", "life_areas", "para", "active_archive", "by_type", "by_year_month",
    "by_extension", "media_library", "documents_first", "by_source_root", "shallow_by_type", "custom",
]

#: Fixed value: the rules that a user starts from.
DEFAULT_RULES = """\
MyArchive/
  Photos/
  Videos/
  Documents/
  Audio/
  Archives/
  Other/

Photos = MyArchive/Photos/{year}/{month}
Videos = MyArchive/Videos/{year}/{month}
Documents = MyArchive/Documents/{ext}
Audio = MyArchive/Audio
Archives = MyArchive/Archives
* = MyArchive/Other
"""


@dataclass(frozen=True)
class LayoutOptions:
    as_of: float
    media_date_depth: str = "year_month"
    documents_by_ext: bool = True
    separate_archives: bool = True
    category_subfolders: dict = field(default_factory=dict)
    unknown_extension: str = "unknown"
    date_prefix: bool = False
    sanitise: bool = True
    archive_older_than_days: int = 365
    rules_text: str = DEFAULT_RULES


def normal_layouts(ids: list[str] | None) -> list[str]:
    chosen = list(dict.fromkeys(i for i in ids or [] if i)) or ["type_date"]
    if "custom" in chosen:
        return ["custom"]
    return sorted(chosen, key=lambda i: LAYOUTS.index(i) if i in LAYOUTS else len(LAYOUTS))


def prepared(files: DataFrame, options: LayoutOptions) -> DataFrame:
    """files with the parts of destinations, each computed once: _name (as planned), _ext, _year, _month."""
    name = names.basename(F.col("path"))
    rows = files.withColumn("_name", names.sanitised(name) if options.sanitise else name)
    if options.date_prefix:
        rows = rows.withColumn("_name", names.date_prefixed(F.col("_name"), F.col("modified")))
    rows = rows.withColumn("_ext", F.lower(F.substring(names.suffix(F.col("_name")), 2, 1000)))
    ext = F.when(F.col("_ext") == "", options.unknown_extension).otherwise(F.col("_ext"))
    return rows.withColumns({"_ext": ext, "_year": names.year(F.col("modified")), "_month": names.month(F.col("modified"))})


def folders(layout: str, options: LayoutOptions) -> Column:
    """The folder parts below the destination, as an array column over prepared rows."""
    cat, year, month, ext = F.col("category"), F.col("_year"), F.col("_month"), F.col("_ext")
    none = F.array().cast("array<string>")
    nests = {"none": none, "flat": none, "year": F.array(year), "year_month": F.array(year, month), "extension": F.array(ext)}

    def nest(kind: str) -> Column:
        default = nests[options.media_date_depth] if kind == "media" else nests["extension"] if kind == "docs" and options.documents_by_ext else none
        out = default
        for c, mode in options.category_subfolders.items():
            if mode != "layout_default":
                out = F.when(cat == c, nests.get(mode, none)).otherwise(out)
        return out

    def at(kind: str, *parts: Column | str) -> Column:
        return F.concat(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]), nest(kind))

    media, docs, archives = cat.isin(*names.MEDIA), cat == "Documents", cat == "Archives"
    old = names.age_days(F.col("modified"), options.as_of) > options.archive_older_than_days
    rest = at("flat", F.when(archives & F.lit(options.separate_archives), "Archives").otherwise("Other"))
    if layout == "by_source_root":
        root = F.coalesce(F.col("source_root"), F.lit(""))
        label = F.when(root == "", "Source").otherwise(names.basename(root))
        under = (root != "") & F.col("path").startswith(F.concat(root, F.lit("/")))
        parts = F.split(F.expr("substring(path, length(source_root) + 2)"), "/")
        inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.when(under, F.concat(F.array(label), inner)).otherwise(at("flat", label, cat))
    if layout == "shallow_by_type":
        return F.array(F.when(archives & F.lit(not options.separate_archives), "Other").otherwise(cat))
    if layout == "life_areas":
        money = names.financial(names.basename(F.col("path")))
        return (
            F.when(media, at("media", "Media", cat)).when(docs & money, at("docs", "Finance", "Documents")).when(docs, at("docs", "Personal", "Documents"))
            .when(archives | old, at("flat", "Archive", cat)).otherwise(at("flat", "Personal", "Other"))
        )
    if layout == "para":
        return F.when(old | archives, at("flat", "Archives", cat)).when(media, at("media", "Areas", "Media", cat)).when(docs, at("docs", "Areas", "Documents")).otherwise(at("flat", "Resources", cat))
    if layout == "active_archive":
        bucket = F.when(old, "Archive").otherwise("Active")
        return F.when(media, at("media", bucket, cat)).when(docs, at("docs", bucket, "Documents")).otherwise(at("flat", bucket, cat))
    if layout == "by_type":
        return F.when(docs, at("docs", "Documents")).when(archives, rest).when(media, at("media", cat)).otherwise(at("flat", cat))
    if layout == "by_year_month":
        shown = F.when(archives & F.lit(not options.separate_archives), "Other").otherwise(cat)
        return F.when(docs, at("docs", year, month, "Documents")).otherwise(at("flat", year, month, shown))
    if layout == "by_extension":
        return F.array(ext)
    if layout == "documents_first":
        return F.when(docs, at("docs", "Documents")).when(media, at("media", "Media", cat)).otherwise(rest)
    return F.when(media, at("media", cat)).when(docs, at("docs", "Documents")).otherwise(rest)


def parse_rules(texts: DataFrame, key: str = "owner", text: str = "rules") -> DataFrame:
    """owner, category, template of user-written rules. A later line for a category wins; comments, blanks and tree lines are left out."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("_pos", "_line"))
    trimmed = F.regexp_replace("_line", r"(?U)^\s+|\s+$", "")
    rules = lines.withColumn("_line", trimmed).where("_line <> '' and not startswith(_line, '#') and not startswith(_line, '-') and contains(_line, '=')")
    at = F.locate("=", F.col("_line"))
    split = rules.select(
        key, "_pos", F.trim(F.substring(F.col("_line"), F.lit(1), at - 1)).alias("category"),
        F.regexp_replace(F.trim(F.expr("substring(_line, locate('=', _line) + 1)")), "^/+|/+$", "").alias("template"),
    ).where("category <> '' and template <> ''")
    last = Window.partitionBy(key, "category").orderBy(F.desc("_pos"))
    return split.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(key, "category", "template")


def filled(template: Column, name: Column) -> Column:
    ext = F.lower(F.substring(names.suffix(name), 2, 1000))
    values = {"{year}": names.year(F.col("modified")), "{month}": names.month(F.col("modified")), "{ext}": F.when(ext == "", "unknown").otherwise(ext), "{category}": F.col("category"), "{name}": name}
    out = template
    for mark, value in values.items():
        out = F.replace(out, F.lit(mark), value)
    return out


def custom_destinations(files: DataFrame, rules: DataFrame, root: str, options: LayoutOptions) -> DataFrame:
    """files with destination from one owner's rules (at most one row a category). Without a rule: the category's folder. Rules of categories that no file can
    have say nothing, so what is broadcast has a row for each category at most, and one for ``*``."""
    small = rules.select(F.col("category").alias("_c"), F.col("template").alias("_t")).where(F.col("_c").isin("*", *names.CATEGORIES))
    fallback = small.where("_c = '*'").agg(F.max("_t").alias("_any")).scalar()
    joined = prepared(files, options).join(F.broadcast(small), F.col("category") == F.col("_c"), "left").withColumn("_rule", F.coalesce("_t", fallback))
    raw, name = names.basename(F.col("path")), F.col("_name")
    path = filled(F.col("_rule"), raw)
    dest = F.when(F.col("_rule").isNull(), F.concat_ws("/", F.lit(root), "category", name)).when(F.col("_rule").contains("{name}"), F.concat_ws("/", F.lit(root), path)).otherwise(F.concat_ws("/", F.lit(root), path, name))
    return joined.withColumn("destination", dest).drop("_c", "_t", "_rule", "_name", "_ext", "_year", "_month")


def destination(layouts: list[str], root: str, options: LayoutOptions) -> Column:
    """One layout's path, or the folders of several in order, repeats dropped."""
    ids = normal_layouts(layouts)
    parts = folders(ids[0], options) if len(ids) == 1 else F.array_distinct(F.concat(*[folders(i, options) for i in ids]))
    return F.concat_ws("/", F.lit(root), parts, F.col("_name"))


def with_destination(files: DataFrame, layouts: list[str], root: str, options: LayoutOptions) -> DataFrame:
    if normal_layouts(layouts) == ["custom"]:
        rules = parse_rules(files.sparkSession.range(1).select(F.lit(0).alias("owner"), F.lit(options.rules_text).alias("rules")))
        return custom_destinations(files, rules, root, options)
    return prepared(files, options).withColumn("destination", destination(layouts, root, options)).drop("_name", "_ext", "_year", "_month")


def plan(files: DataFrame, layouts: list[str], root: str, options: LayoutOptions, categories: list[str] | None = None, present: DataFrame | None = None) -> DataFrame:
    """id, path, category, destination, skip_reason; a skipped file has no destination. present: the paths that exist now."""
    rows = files if categories is None else files.where(F.col("category").isin(*categories))
    rows = with_destination(rows, layouts, root, options)
    if present is not None:
        rows = rows.join(present.select("path", F.lit(True).alias("_here")).distinct(), "path", "left")
    else:
        rows = rows.withColumn("_here", F.lit(True))
    # only user-written templates can step out of the destination
    outside = F.array_contains(F.split("destination", "/"), "..") if normal_layouts(layouts) == ["custom"] else F.lit(False)
    reason = (
        F.when(F.col("archive_container").isNotNull(), "inside archive")
        .when(F.array_contains(F.split("path", "/"), names.QUARANTINE), "in quarantine")
        .when(F.col("path").startswith(F.lit(root + "/")), "already under destination")
        .when(F.col("_here").isNull(), "missing")
        .when(outside, "leaves destination")
    )
    judged = rows.withColumn("skip_reason", reason)
    return judged.select("id", "path", "category", F.when(F.col("skip_reason").isNull(), F.col("destination")).alias("destination"), "skip_reason")


def folder_tree(planned: DataFrame, root: str) -> DataFrame:
    """folder, depth: every folder that the plan makes, below the root."""
    below = F.split(F.expr(f"substring(destination, {len(root) + 2})"), "/")
    inner = planned.where("skip_reason is null").select(F.array_join(F.slice(below, 1, F.size(below) - 1), "/").alias("_d")).distinct()
    parts = F.split("_d", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    # an outer explode: a filter here would be pushed to the scan, with the whole destination in it once more
    found = inner.select(F.explode_outer(F.when(F.col("_d") != "", steps)).alias("folder")).distinct().where("folder is not null")
    return found.withColumn("depth", F.size(F.split("folder", "/")))


def tree_key(path: Column) -> Column:
    """What paths are shown in the order of: their parts in lower case, compared part by part."""
    return F.transform(F.split(path, "/"), lambda part: F.lower(part))


def tree_order(tree: DataFrame) -> DataFrame:
    return tree.orderBy(tree_key(F.col("folder")), "folder")


def child_order(found: DataFrame) -> DataFrame:
    """children in the order of a listing: by folder, in it folders first, then names whatever their case."""
    return found.orderBy(tree_key(F.col("parent")), ~F.col("is_dir"), F.lower("name"), "name", "source")


def children(planned: DataFrame, root: str) -> DataFrame:
    """parent, name, is_dir, source: what lies directly in each folder of the plan."""
    inside = planned.where("skip_reason is null").select(F.expr(f"substring(destination, {len(root) + 2})").alias("_d"), "path")
    files = inside.select(F.when(F.col("_d").contains("/"), names.parent(F.col("_d"))).otherwise("").alias("parent"), names.basename(F.col("_d")).alias("name"), F.lit(False).alias("is_dir"), F.col("path").alias("source"))
    tree = folder_tree(planned, root)
    dirs = tree.select(F.when(F.col("folder").contains("/"), names.parent(F.col("folder"))).otherwise("").alias("parent"), names.basename(F.col("folder")).alias("name"), F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("source"))
    return files.unionByName(dirs)


def dry_run(planned: DataFrame, mode: str = "copy", existing: DataFrame | None = None) -> DataFrame:
    """id, path, final_destination, renamed, message of each planned file."""
    rows = planned.where("skip_reason is null").withColumn("ord", F.col("id"))
    named = unique_names(rows.select("ord", "id", "path", "destination"), existing)
    tag = F.concat(F.lit(f"preview-{mode}"), F.when(F.col("renamed"), "-unique").otherwise(""))
    return named.select("id", "path", "final_destination", "renamed", F.concat(F.lit("["), tag, F.lit("] "), "path", F.lit(" -> "), "final_destination").alias("message"))


def notes(planned: DataFrame, root: str, layout: str, existing: DataFrame | None = None) -> DataFrame:
    """path, text: a note for each top folder of the plan that has none yet."""
    top = F.get(F.split(F.expr(f"substring(destination, {len(root) + 2})"), "/"), F.lit(0))
    rows = planned.where("skip_reason is null").select(top.alias("folder")).distinct()
    out = rows.select(F.concat(F.lit(root + "/"), "folder", F.lit("/README.txt")).alias("path"), F.concat(F.lit("Folder: "), "folder", F.lit(f" | Layout: {layout}")).alias("text"))
    return out if existing is None else out.join(existing.select("path").distinct(), "path", "left_anti")


def quarantine_manifest(extras: DataFrame, root: str, session: str) -> DataFrame:
    """original, quarantine: a collision-free place for each file in the session's folder."""
    plan_rows = extras.select(F.col("id").alias("ord"), "id", "path", F.concat(F.lit(f"{root}/{session}/"), names.basename(F.col("path"))).alias("destination"))
    return unique_names(plan_rows).select(F.col("path").alias("original"), F.col("final_destination").alias("quarantine"))


def restore_plan(manifest: DataFrame) -> DataFrame:
    """source, destination: back from quarantine; of several rows for one original the latest session's."""
    last = Window.partitionBy("original").orderBy(F.desc("quarantine"))
    return manifest.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(F.col("quarantine").alias("source"), F.col("original").alias("destination"))


def latest_session(manifests: DataFrame, root: str) -> DataFrame:
    session = F.get(F.split(F.expr(f"substring(quarantine, {len(root) + 2})"), "/"), F.lit(0))
    return manifests.select(session.alias("session")).where("not startswith(session, '.')").agg(F.max("session").alias("session"))


def plan_key(layouts: list[str], root: str, options: LayoutOptions) -> str:
    """The same for equal options: stored with a plan, it tells whether a preview still holds."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps([normal_layouts(layouts), root, vars(options)], sort_keys=True).encode()).hexdigest()
