"""File names and paths as Column expressions. Regular expressions use Java's (?U) where the rules are about all white space and digits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Categories by extension.
EXTENSIONS = {
    "Photos": "jpg jpeg png gif bmp webp heic tif tiff raw cr2 nef dng arw orf rw2 raf".split(),
    "Videos": "mp4 mov avi mkv wmv m4v webm mpg mpeg".split(),
    "Audio": "mp3 wav flac aac ogg m4a wma".split(),
    "Documents": "pdf doc docx xls xlsx ppt pptx txt rtf odt ods odp csv md".split(),
    "Archives": "zip rar 7z tar gz bz2 xz".split(),
}
CATEGORIES = [*EXTENSIONS, "Other"]
MEDIA = ["Photos", "Videos", "Audio"]

#: Words that make a document financial.
FINANCIAL = "tax invoice bank insurance mortgage receipt salary payslip pension statement budget finance loan credit".split()

#: Folders that hold no user files.
QUARANTINE = "Cartulary_Quarantine"
JUNK_FOLDERS = [".git", ".Trash", ".trashes", "$RECYCLE.BIN", "System Volume Information", "__MACOSX", "node_modules", ".cache", QUARANTINE]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def suffix(name: Column) -> Column:
    """With its dot, in the name's case; empty for ``.bashrc`` and ``foo.``."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def category(name: Column) -> Column:
    return category_of(F.lower(F.substring(suffix(name), 2, 1000)))


def category_of(ext: Column) -> Column:
    """By extension: lower case, without its dot."""
    out = F.lit("Other")
    for label, exts in reversed(EXTENSIONS.items()):
        out = F.when(ext.isin(*exts), label).otherwise(out)
    return out


#: Stands between an archive's path and its member's name where both are shown.
INSIDE = " → "


def display_path(path: Column, container: Column, member: Column) -> Column:
    return F.when(container.isNotNull(), F.concat(container, F.lit(INSIDE), member)).otherwise(path)


def normalised(name: Column) -> Column:
    """The stem without copy marks, letters a-z and digits only. Each mark is stripped once, in this order."""
    s = F.lower(stem(name))
    s = F.regexp_replace(s, r"(?Ud)[\s._\x1c-\x1f-]*\(\d+\)$", "")
    s = F.regexp_replace(s, r"(?Ud)[\s._\x1c-\x1f-]*(copy|副本|final|edited|edit|dup|duplicate)\d*$", "")
    return F.regexp_replace(s, "[^a-z0-9]+", "")


def sanitised(name: Column) -> Column:
    s = F.regexp_replace(stem(name), r'[<>:"/\\|?*\x00-\x1f]+', "_")
    s = F.regexp_replace(F.regexp_replace(s, "^[ ._]+|[ ._]+$", ""), "_+", "_")
    return F.concat(F.when(s == "", "file").otherwise(s), F.lower(suffix(name)))


def date_prefixed(name: Column, modified: Column) -> Column:
    return F.when(name.rlike(r"^\d{4}-\d{2}-\d{2}[_ ]"), name).otherwise(F.concat(F.date_format(F.timestamp_seconds(modified), "yyyy-MM-dd"), F.lit("_"), name))


def financial(name: Column) -> Column:
    return F.lower(name).rlike("|".join(FINANCIAL))


def year(modified: Column) -> Column:
    return F.date_format(F.timestamp_seconds(modified), "yyyy")


def month(modified: Column) -> Column:
    return F.date_format(F.timestamp_seconds(modified), "MM")


def age_days(modified: Column, as_of: float) -> Column:
    return (F.lit(float(as_of)) - modified) / 86400.0


def unzipped_name(name: Column) -> Column:
    s = F.trim(stem(name))
    s = F.when((s == "") | (s.startswith(".") & (suffix(name) == "")), "archive").otherwise(s)
    bare = F.regexp_replace(s, r"^\.+", "")
    return F.concat(F.when(~s.startswith("."), s).when(bare == "", "archive").otherwise(bare), F.lit("_unzipped"))


def unsafe_member(member: Column) -> Column:
    """Whether an archive member must not be unpacked: empty, a folder, a drive, or a step out of the target."""
    clean = F.regexp_replace(F.trim(F.replace(member, F.lit("\\"), F.lit("/"))), "^/+", "")
    parts = F.split(clean, "/")
    return (clean == "") | clean.endswith("/") | F.get(parts, F.lit(0)).contains(":") | F.array_contains(parts, "..")


def _folders(relative: Column) -> Column:
    parts = F.split(relative, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def in_junk_folder(relative: Column) -> Column:
    return F.exists(_folders(relative), lambda s: s.isin(*JUNK_FOLDERS) | s.startswith("."))


def in_quarantine(relative: Column) -> Column:
    return F.array_contains(_folders(relative), QUARANTINE)
