"""SQL text shared by the oracle queries: the same tables and rules in DuckDB's dialect."""

from __future__ import annotations

from cartulary.functions import names
from cartulary.sources import fixtures

AS_OF = 1735689600.0
ROOT = "/dest"


def _category(ext: str) -> str:
    return "case " + " ".join(f"when {ext} in ({', '.join(repr(e) for e in exts)}) then '{c}'" for c, exts in names.EXTENSIONS.items()) + " else 'Other' end"


def files(source: str, more: str = "") -> str:
    """A ``with`` clause that defines files(id, path, size, modified, source_root, name, suffix, stem, ext, category, parent, ts, ...)."""
    return f"""with raw as ({source}),
named as (select *, regexp_extract(path, '([^/]*)$', 1) as name, regexp_replace(path, '/[^/]*$', '') as parent, to_timestamp(modified) at time zone 'UTC' as ts from raw),
suffixed as (select *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) as suffix from named),
files as (select *, substr(name, 1, length(name) - length(suffix)) as stem, lower(substr(suffix, 2)) as ext,
  {_category("lower(substr(suffix, 2))")} as category from suffixed){more}
"""


DOCS = files(fixtures.FILES_DOCS)
ITEMS = files(fixtures.FILES_ITEMS)

YEAR, MONTH = "strftime(ts, '%Y')", "strftime(ts, '%m')"
SANITISED = (
    "(case when regexp_replace(trim(regexp_replace(stem, '[<>:\"/\\\\|?*\\x00-\\x1f]+', '_', 'g'), ' ._'), '_+', '_', 'g') = '' then 'file' "
    "else regexp_replace(trim(regexp_replace(stem, '[<>:\"/\\\\|?*\\x00-\\x1f]+', '_', 'g'), ' ._'), '_+', '_', 'g') end || lower(suffix))"
)
NORMALISED = (
    "regexp_replace(regexp_replace(regexp_replace(lower(stem), '[\\s._-]*\\(\\d+\\)$', ''), "
    "'[\\s._-]*(copy|副本|final|edited|edit|dup|duplicate)\\d*$', ''), '[^a-z0-9]+', '', 'g')"
)
FINGERPRINT = (
    "(case when length(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) >= 20 then sha256(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) end)"
)


def human_bytes(n: str) -> str:
    out = f"printf('%.1f TB', round_even({n} / 1099511627776.0, 1))"
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        shown = f"printf('%.1f {unit}', round_even({n} / {float(1024**k)}, 1))" if k else f"{n} || ' B'"
        out = f"case when {n} < {float(1024 ** (k + 1))} then {shown} else {out} end"
    return out


def groups(base: str, key: str, kind: str, reason: str, name: str, where: str = "true") -> str:
    """CTEs <name>_k and <name>: members of the groups of equal keys."""
    return f""", {name}_k as (select *, {key} as gid from {base} where {where}),
{name} as (select gid, '{kind}' as kind, '{reason}' as reason, id, path, path as display_path, size, modified, category,
  row_number() over (partition by gid order by modified, path, id) - 1 as keep_rank
  from {name}_k where gid in (select gid from {name}_k where gid is not null and gid <> '' group by gid having count(*) > 1))"""


EXACT = groups("files", "cast(size as varchar) || ':' || sha256(content)", "exact", "", "exact", "size in (select size from files group by size having count(*) > 1)")

GROUP_SUMMARY = """select gid, kind, reason, count(*) as n, max(case when keep_rank = 0 then size end) as size,
  max(case when keep_rank = 0 then category end) as category, max(case when keep_rank = 0 then regexp_extract(path, '([^/]*)$', 1) end) as name,
  case when kind = 'exact' then max(case when keep_rank = 0 then size end) * (count(*) - 1) else sum(case when keep_rank > 0 then size else 0 end) end as wasted"""


def layout(name: str) -> str:
    """The destination expression of a layout with default options."""
    media, docs = "category in ('Photos', 'Videos', 'Audio')", "category = 'Documents'"
    old = f"({AS_OF} - modified) / 86400.0 > 365"
    ext = "case when lower(regexp_extract(sname, '^.+\\.([^.]+)$', 1)) = '' then 'unknown' else lower(regexp_extract(sname, '^.+\\.([^.]+)$', 1)) end"
    m = f"'/' || {YEAR} || '/' || {MONTH}"
    d = f"'/' || {ext}"
    rest = "case when category = 'Archives' then 'Archives' else 'Other' end"
    body = {
        "type_date": f"case when {media} then category || {m} when {docs} then 'Documents' || {d} else {rest} end",
        "media_library": f"case when {media} then category || {m} when {docs} then 'Documents' || {d} else {rest} end",
        "by_type": f"case when {media} then category || {m} when {docs} then 'Documents' || {d} else category end",
        "documents_first": f"case when {docs} then 'Documents' || {d} when {media} then 'Media/' || category || {m} else {rest} end",
        "life_areas": f"case when {media} then 'Media/' || category || {m} when {docs} and regexp_matches(lower(name), '{'|'.join(names.FINANCIAL)}') then 'Finance/Documents' || {d} "
        f"when {docs} then 'Personal/Documents' || {d} when category = 'Archives' or {old} then 'Archive/' || category else 'Personal/Other' end",
        "para": f"case when {old} or category = 'Archives' then 'Archives/' || category when {media} then 'Areas/Media/' || category || {m} when {docs} then 'Areas/Documents' || {d} else 'Resources/' || category end",
        "active_archive": f"(case when {old} then 'Archive/' else 'Active/' end) || case when {media} then category || {m} when {docs} then 'Documents' || {d} else category end",
        "by_year_month": f"{YEAR} || '/' || {MONTH} || '/' || case when {docs} then 'Documents' || {d} else category end",
        "by_extension": ext,
        "shallow_by_type": "category",
        "by_source_root": "regexp_extract(source_root, '([^/]*)$', 1) || regexp_replace(substr(path, length(source_root) + 1), '/[^/]*$', '')",
        "custom": f"case category when 'Photos' then 'MyArchive/Photos/' || {YEAR} || '/' || {MONTH} when 'Videos' then 'MyArchive/Videos/' || {YEAR} || '/' || {MONTH} "
        "when 'Documents' then 'MyArchive/Documents/' || (case when ext = '' then 'unknown' else ext end) when 'Audio' then 'MyArchive/Audio' when 'Archives' then 'MyArchive/Archives' else 'MyArchive/Other' end",
    }[name]
    return f"'{ROOT}/' || {body} || '/' || sname"


def planned(name: str, base: str = DOCS) -> str:
    return f"{base}, sane as (select *, {SANITISED} as sname from files), plan as (select id, path, category, {layout(name)} as destination from sane)\n"
