"""Every registered query of the file-inventory engine, with its SQL.

A query takes (spark, sf_dir) and runs over its whole fixture table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from cartulary.functions import contents, formats, names
from cartulary.operators import advise, duplicates, index, layout, naming, report, similar_names as similar
from cartulary.plans import sql
from cartulary.schema import as_files
from cartulary.scratch import shared_dir
from cartulary.sources import archives, fixtures

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
OPTIONS = layout.LayoutOptions(as_of=sql.AS_OF)
SESSION = "20250101_000000"


def query(text: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if text is not None:
            ORACLE_SQL[key] = text
        return f

    return add


def _docs(spark, sf_dir) -> DataFrame:
    return fixtures.files_docs(spark, sf_dir)


def _name() -> F.Column:
    return names.basename(F.col("path"))


# ---- index ----


@query(sql.DOCS + "select id, path, size, modified, category, source_root, name, lower(suffix) as suffix, stem, path as display_path from files")
def files_index(spark, sf_dir):
    n = _name()
    return _docs(spark, sf_dir).select(
        "id", "path", "size", "modified", "category", "source_root", n.alias("name"), F.lower(names.suffix(n)).alias("suffix"), names.stem(n).alias("stem"),
        names.display_path(F.col("path"), F.col("archive_container"), F.col("archive_member")).alias("display_path"),
    )


@query(
    f"with m as ({fixtures.ZIP_MEMBERS}), r as (select *, row_number() over (partition by archive_container order by member_ord, id) as r from m) "
    f"select id, archive_container, archive_member, size from r where r <= {index.MEMBERS_PER_ARCHIVE} order by id, member_ord limit {index.MEMBERS_IN_ALL}"
)
def zip_members_capped(spark, sf_dir):
    return index.cap_members(fixtures.zip_members(spark, sf_dir)).select("id", "archive_container", "archive_member", "size")


@query(f"with m as ({fixtures.ZIP_MEMBERS}) select archive_container, count(*) as members, sum(size) as bytes, count(*) > 3 as capped from m group by 1")
def zip_bytes(spark, sf_dir):
    return index.capped_archives(fixtures.zip_members(spark, sf_dir), 3)


@query(f"with o as ({fixtures.LISTING_OUTCOMES}) select outcome, count(*) as n from o group by 1")
def scan_counters(spark, sf_dir):
    return index.scan_counters(fixtures.listing_outcomes(spark, sf_dir))


def _cache(files: DataFrame) -> DataFrame:
    shift = F.when(F.col("id") % 4 == 2, 1.0).otherwise(0.00005)
    return files.where("id % 2 = 0").select("path", "size", (F.col("modified") + shift).alias("modified"), F.sha2("content", 256).alias("hash_value"))


_CACHE = ", cache as (select path, size, modified + case when id % 4 = 2 then 1.0 else 0.00005 end as modified, sha256(content) as hash_value from files where id % 2 = 0)"


@query(sql.DOCS + _CACHE + " select f.id, f.path, c.hash_value from files f left join cache c on f.path = c.path and f.size = c.size and abs(f.modified - c.modified) < 1e-4")
def cache_hits(spark, sf_dir):
    files = _docs(spark, sf_dir)
    return index.cache_hits(files, _cache(files)).select("id", "path", "hash_value")


@query(
    sql.DOCS + _CACHE + ", fresh as (select path, size, modified, 'new:' || id as hash_value from files where id % 3 = 0) "
    "select * from fresh union all select * from cache c where not exists (select 1 from fresh f where f.path = c.path and f.size = c.size and f.modified = c.modified)"
)
def cache_upsert(spark, sf_dir):
    files = _docs(spark, sf_dir)
    fresh = files.where("id % 3 = 0").select("path", "size", "modified", F.concat(F.lit("new:"), F.col("id").cast("string")).alias("hash_value"))
    return index.cache_upsert(_cache(files), fresh)


@query(sql.DOCS + "select id, path from files where path not in (select path from files where id % 9 = 0)")
def remove_paths(spark, sf_dir):
    files = _docs(spark, sf_dir)
    return index.remove_paths(files, files.where("id % 9 = 0")).select("id", "path")


@query(sql.DOCS + "select id, path from files where id in (select l_orderkey from lineitem)")
def id_lookup(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("id"))
    return index.rows_by_id(_docs(spark, sf_dir), ids).select("id", "path")


@query(sql.DOCS + "select id, path from files order by id limit 40")
def sample_rows(spark, sf_dir):
    return index.first_rows(_docs(spark, sf_dir), 40).select("id", "path")


@query(
    sql.DOCS + ", n as (select *, row_number() over (order by id, path) - 1 as i, count(*) over () as total from files) "
    "select id, path from n where i % greatest(1, total // 100) = 0 and i < greatest(1, total // 100) * 100"
)
def stride_sample(spark, sf_dir):
    return index.stride_sample(_docs(spark, sf_dir).select("id", "path"), 100)


_TREE = f"case id % 6 when 0 then '.git/' when 1 then 'node_modules/x/' when 2 then '.hidden/' when 3 then '{names.QUARANTINE}/' when 4 then '.' else '' end"
_PRUNE = sql.DOCS + f", t as (select id, source_root || '/' || {_TREE} || name as path, {_TREE} || name as rel from files)"
_JUNK = "(" + " or ".join(f"contains('/' || regexp_replace(rel, '[^/]*$', ''), '/{j}/')" for j in names.JUNK_FOLDERS) + " or regexp_matches(rel, '(^|/)\\.[^/]*/'))"


def _tree(spark, sf_dir) -> DataFrame:
    kind = F.col("id") % 6
    inner = F.when(kind == 0, ".git/").when(kind == 1, "node_modules/x/").when(kind == 2, ".hidden/").when(kind == 3, f"{names.QUARANTINE}/").when(kind == 4, ".").otherwise("")
    return _docs(spark, sf_dir).withColumn("path", F.concat("source_root", F.lit("/"), inner, _name()))


@query(_PRUNE + f" select id, path from t where not {_JUNK}")
def dir_prune(spark, sf_dir):
    return index.pruned(_tree(spark, sf_dir)).select("id", "path")


@query(_PRUNE + f" select id, path, {_JUNK} or regexp_matches(rel, '(^|/)\\.[^/]*$') as is_junk from t where not contains(rel, '{names.QUARANTINE}/')")
def junk_flags(spark, sf_dir):
    return index.pruned(_tree(spark, sf_dir), include_junk=True).select("id", "path", "is_junk")


_MEMBER = "case turn % 7 when 0 then '../' || role when 1 then '/abs/' || role when 2 then 'C:/' || role when 3 then 'a\\..\\' || role when 4 then role || '/' when 5 then '' else 'ok/' || role end"


@query(
    f"with m as (select conv_id, turn, {_MEMBER} as member from conversations), c as (select *, regexp_replace(trim(replace(member, '\\', '/')), '^/+', '') as clean from m) "
    "select conv_id, turn, member, clean = '' or clean like '%/' or contains(split_part(clean, '/', 1), ':') or list_contains(string_split(clean, '/'), '..') as unsafe from c"
)
def unsafe_members(spark, sf_dir):
    k = F.col("turn") % 7
    role = F.col("role")
    member = (
        F.when(k == 0, F.concat(F.lit("../"), role)).when(k == 1, F.concat(F.lit("/abs/"), role)).when(k == 2, F.concat(F.lit("C:/"), role))
        .when(k == 3, F.concat(F.lit("a\\..\\"), role)).when(k == 4, F.concat(role, F.lit("/"))).when(k == 5, F.lit("")).otherwise(F.concat(F.lit("ok/"), role))
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", member.alias("member"))
    return rows.withColumn("unsafe", names.unsafe_member(F.col("member")))


@query(
    sql.DOCS + ", d as (select distinct parent as destination from files), s as (select distinct source_root || '/pdf' as source from files union select distinct source_root || '/2016' from files) "
    "select destination, source from d join s on destination = source or starts_with(destination, source || '/')"
)
def dest_conflicts(spark, sf_dir):
    files = _docs(spark, sf_dir)
    dest = files.select(names.parent(F.col("path")).alias("destination")).distinct()
    roots = files.select("source_root").distinct()
    src = roots.select(F.explode(F.array(F.concat("source_root", F.lit("/pdf")), F.concat("source_root", F.lit("/2016")))).alias("source"))
    return index.destination_conflicts(dest, src)


@query(sql.DOCS + f"select id, name from files where category = 'Documents' and regexp_matches(lower(name), '{'|'.join(names.FINANCIAL)}')")
def financial_docs(spark, sf_dir):
    n = _name()
    return _docs(spark, sf_dir).where(F.col("category") == "Documents").where(names.financial(n)).select("id", n.alias("name"))


@query(sql.DOCS + f"select id, {sql.NORMALISED} as normalised from files")
def normalized_names(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", names.normalised(_name()).alias("normalised"))


@query(sql.DOCS + f"select id, {sql.FINGERPRINT} as fingerprint from files")
def text_fingerprint(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", contents.text_fingerprint(F.col("content")).alias("fingerprint"))


_TOKENS = "list_distinct(regexp_extract_all(lower(content), '[a-z0-9]{4,}'))"


@query(sql.DOCS + f"select id, len({_TOKENS}) as n_tokens, array_to_string(list_sort({_TOKENS}), ' ') as tokens from files")
def tokens(spark, sf_dir):
    t = contents.token_set(F.col("content"))
    return _docs(spark, sf_dir).select("id", F.size(t).alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("tokens"))


_MEDIA_SQL = """with media as (select vec_id as id, reverse(list_aggregate([case when x::double >= m then '1' else '0' end for x in v], 'string_agg', '')) as bits
  from (select vec_id, v, list_sum([y::double for y in v]) / len(v) as m from (select vec_id, embedding[1:64] as v from embeddings)))"""


@query(_MEDIA_SQL + " select id, printf('%016x', bits::bit::uhugeint) as hash from media")
def avg_hash(spark, sf_dir):
    return fixtures.media_grids(spark, sf_dir).select("id", contents.average_hash(F.col("grid")).alias("hash"))


@query(sql.DOCS + f"select id, {sql.SANITISED} as clean_name, case when regexp_matches(name, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[_ ]') then {sql.SANITISED} else strftime(ts, '%Y-%m-%d') || '_' || {sql.SANITISED} end as dated_name from files")
def safe_names(spark, sf_dir):
    clean = names.sanitised(_name())
    return _docs(spark, sf_dir).select("id", clean.alias("clean_name"), names.date_prefixed(clean, F.col("modified")).alias("dated_name"))


@query(sql.DOCS + f"select id, {sql.human_bytes('size * 977')} as shown from files")
def human_units(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", formats.human_bytes(F.col("size") * 977).alias("shown"))


@query(sql.DOCS + "select category, count(*) as n_files, sum(size) as bytes from files group by 1")
def category_counts(spark, sf_dir):
    return index.category_counts(_docs(spark, sf_dir))


@query(sql.DOCS + "select count(*) as n_files, sum(size) as total_bytes, sum(size) as disk_bytes, count(*) as disk_files, 0 as archive_members from files")
def index_totals(spark, sf_dir):
    return index.totals(_docs(spark, sf_dir))


@query(
    sql.DOCS + f", m as ({fixtures.ZIP_MEMBERS}) select (select count(*) from files) + count(*) as n_files, (select sum(size) from files) + sum(size) as total_bytes, "
    "(select sum(size) from files) as disk_bytes, (select count(*) from files) as disk_files, count(*) as archive_members from m"
)
def index_totals_members(spark, sf_dir):
    """Totals over files on disk and archive members."""
    rows = _docs(spark, sf_dir).drop("content").unionByName(fixtures.member_files(spark, sf_dir).drop("content"), allowMissingColumns=True)
    return index.totals(rows)


@query()
def content_kinds(spark, sf_dir):
    """What the first bytes of files look like, by extension; each fifth file holds digests of its text instead. Python's notion of a printable character has no
    form in SQL, so a test holds the rule against plain code."""
    raw = F.unhex(F.repeat(F.sha2("content", 512), 8))
    rows = _docs(spark, sf_dir).select(F.lower(names.suffix(_name())).alias("extension"), F.when(F.col("id") % 5 == 0, raw).otherwise(F.col("content").cast("binary")).alias("content"))
    return archives.looks_like_text(rows).groupBy("extension", "is_text").agg(F.count(F.lit(1)).alias("n_files"))


@query(sql.DOCS + "select id, size from files where size in (select size from files group by size having count(*) > 1)")
def size_buckets(spark, sf_dir):
    return index.same_size(_docs(spark, sf_dir)).select("id", "size")


@query(sql.DOCS + ", last as (select max(source_root) as r from files) select id, path, case when source_root = r then size + 1 else size end as size, category from files, last where source_root <> r or id % 3 = 0")
def index_round_trip(spark, sf_dir):
    """An index written, one source root's rows replaced, and read again."""
    files = _docs(spark, sf_dir).drop("content")
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    report.write_index(files, path)
    newest = files.agg(F.max("source_root")).scalar()
    report.upsert_index(files.where((F.col("source_root") == newest) & (F.col("id") % 3 == 0)).withColumn("size", F.col("size") + 1), path)
    return report.read_index(spark, path).select("id", "path", "size", "category")


@query(
    sql.DOCS + ", m as (select distinct parent from files where id % 3 = 0), z as (select id, name, source_root, parent from files where ext = 'zip') "
    "select id, name from z where parent not in (select parent from m)"
)
def prefer_extracted(spark, sf_dir):
    files = _docs(spark, sf_dir)
    zips = files.where(F.lower(names.suffix(_name())) == ".zip").select("id", _name().alias("name"), F.col("path").alias("archive_container"), names.parent(F.col("path")).alias("_at"))
    target = F.concat(F.col("_at"), F.lit("/"), names.unzipped_name(F.col("name")), F.lit("/x"))
    made = zips.join(files.where("id % 3 = 0").select(names.parent(F.col("path")).alias("_at")).distinct(), "_at").select(target.alias("path"))
    return index.prefer_extracted(zips, made).select("id", "name")


# ---- duplicates ----

_MEMBERS = "gid, kind, id, path, size, keep_rank"
_MEMBER_COLS = ["gid", "kind", "id", "path", "size", "keep_rank"]


@query(sql.DOCS + sql.EXACT + f" select {_MEMBERS} from exact")
def exact_dups(spark, sf_dir):
    return duplicates.exact(_docs(spark, sf_dir)).select(*_MEMBER_COLS)


@query(sql.DOCS + sql.EXACT + f", g as ({sql.GROUP_SUMMARY} from exact group by gid, kind, reason) select category, count(*) as n_groups, sum(wasted) as wasted from g group by category")
def exact_dups_by_category(spark, sf_dir):
    found = duplicates.groups(duplicates.exact(_docs(spark, sf_dir)))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("wasted").alias("wasted"))


@query(sql.DOCS + sql.EXACT + f", g as ({sql.GROUP_SUMMARY} from exact group by gid, kind, reason) select count(*) as n_groups, coalesce(sum(n - 1), 0) as extra_files, coalesce(sum(wasted), 0) as wasted_bytes from g")
def dup_totals(spark, sf_dir):
    return duplicates.totals(duplicates.groups(duplicates.exact(_docs(spark, sf_dir))))


_DOC = "category = 'Documents'"
_NAME_GROUPS = sql.groups("files", sql.NORMALISED, "similar_document", "name", "byname", _DOC)
_TEXT_GROUPS = sql.groups("files", f"case when size = 0 then 'empty' else {sql.FINGERPRINT} end", "similar_document", "content", "bytext", _DOC)


def _documents(files: DataFrame) -> DataFrame:
    return files.where(index.is_document(_name(), F.col("category")))


@query(sql.DOCS + _NAME_GROUPS + f" select {_MEMBERS} from byname")
def name_dups(spark, sf_dir):
    return duplicates.by_name(_documents(_docs(spark, sf_dir)), "similar_document").select(*_MEMBER_COLS)


@query(sql.DOCS + _TEXT_GROUPS + f" select {_MEMBERS} from bytext")
def text_dups(spark, sf_dir):
    return duplicates.by_text(_documents(_docs(spark, sf_dir))).select(*_MEMBER_COLS)


def _media(spark, sf_dir) -> DataFrame:
    rows = fixtures.files_media(spark, sf_dir)
    return as_files(rows.select("id", "path", F.lit(1000).cast("long").alias("size"), F.col("id").cast("double").alias("modified"), contents.hash_of_bits(F.col("bits")).alias("visual_hash")))


@query(_MEDIA_SQL + ", k as (select bits from media group by 1 having count(*) > 1) select id, bits, row_number() over (partition by bits order by id) - 1 as keep_rank from media where bits in (select bits from k)")
def look_dups(spark, sf_dir):
    found = duplicates.by_look(_media(spark, sf_dir)).select("id", "keep_rank")
    return found.join(fixtures.files_media(spark, sf_dir), "id").select("id", "bits", "keep_rank")


@query(
    _MEDIA_SQL + ", k as (select id, bits, bits[1:4] as p from media) select a.id as a, b.id as b, bit_count(xor(a.bits::bit, b.bits::bit))::int as distance "
    "from k a join k b on a.p = b.p and a.id < b.id where bit_count(xor(a.bits::bit, b.bits::bit)) <= 20"
)
def near_edges(spark, sf_dir):
    return duplicates.near_edges(_media(spark, sf_dir), prefix=1, distance=20, most=None)


@query(
    _MEDIA_SQL.replace("with media", "with recursive media", 1) + ", h as (select distinct bits, bits[1:4] as p from media), e as (select a.bits as x, b.bits as y from h a join h b on a.p = b.p and a.bits <> b.bits "
    "where bit_count(xor(a.bits::bit, b.bits::bit)) <= 20), r as (select x as bits, x as seen from e union select r.bits, e.y from r join e on r.seen = e.x), "
    "c as (select bits, min(seen) as comp from r group by bits), n as (select id, comp from media join c using (bits)), g as (select comp, min(id) as root from n group by comp) "
    "select 'near:' || root as gid, 'similar_photo' as kind, id, '/vault/photos/img_' || id || '.jpg' as path, 1000::bigint as size, row_number() over (partition by root order by id) - 1 as keep_rank from n join g using (comp)"
)
def near_look(spark, sf_dir):
    return duplicates.near_look(_media(spark, sf_dir), prefix=1, distance=20, most=None).select(*_MEMBER_COLS)


_PHOTOS = """with recursive v0 as (select vec_id, embedding[1:64] as grid from embeddings),
copies as (select vec_id * 3 as id, vec_id, grid from v0 union all select vec_id * 3 + 1, vec_id, grid from v0 where vec_id % 3 = 0
  union all select vec_id * 3 + 2, vec_id, list_transform(grid, lambda x, i: case when i - 1 = vec_id % 40 then -x else x end) from v0 where vec_id % 4 = 0),
hashed as (select id, vec_id, reverse(list_aggregate([case when x::double >= m then '1' else '0' end for x in grid], 'string_agg', '')) as bits
  from (select *, list_sum([y::double for y in grid]) / len(grid) as m from copies)),
photos as (select id, '/vault/photos/img_' || vec_id || '_' || id % 3 || '.jpg' as path, 1000::bigint as size, (id % 7919)::double as modified, bits from hashed)"""


def _photos(spark, sf_dir) -> DataFrame:
    """Grids to hashes to files; names of copies differ by what a copy's name has."""
    rows = fixtures.photo_copies(spark, sf_dir)
    path = F.concat(F.lit("/vault/photos/img_"), F.col("vec_id").cast("string"), F.lit("_"), (F.col("id") % 3).cast("string"), F.lit(".jpg"))
    hashed = rows.select("id", path.alias("path"), F.lit(1000).cast("long").alias("size"), (F.col("id") % 7919).cast("double").alias("modified"), contents.average_hash(F.col("grid")).alias("visual_hash"))
    return as_files(hashed)


@query(_PHOTOS + ", k as (select bits from photos group by 1 having count(*) > 1) select id, path, row_number() over (partition by bits order by modified, path, id) - 1 as keep_rank from photos where bits in (select bits from k)")
def photo_copies(spark, sf_dir):
    return duplicates.by_look(_photos(spark, sf_dir)).select("id", "path", "keep_rank")


_NEAR_PHOTOS = _PHOTOS + (
    ", h as (select distinct bits, bits[1:16] as p from photos), e as (select a.bits as x, b.bits as y from h a join h b on a.p = b.p and a.bits <> b.bits where bit_count(xor(a.bits::bit, b.bits::bit)) <= 8), "
    "r as (select x as bits, x as seen from e union select r.bits, e.y from r join e on r.seen = e.x), c as (select bits, min(seen) as comp from r group by bits), "
    "n as (select p.*, comp from photos p join c using (bits)), near as (select *, row_number() over (partition by comp order by modified, path, id) - 1 as keep_rank, min(id) over (partition by comp) as root from n)"
)


@query(_NEAR_PHOTOS + " select 'near:' || root as gid, id, path, keep_rank from near")
def near_photos(spark, sf_dir):
    """Near groups with the default prefix and distance."""
    return duplicates.near_look(_photos(spark, sf_dir)).select("gid", "id", "path", "keep_rank")


@query(_PHOTOS + ", k as (select id, bits, bits[1:16] as p from photos) select a.id as a, b.id as b, bit_count(xor(a.bits::bit, b.bits::bit))::int as distance from k a join k b on a.p = b.p and a.id < b.id where bit_count(xor(a.bits::bit, b.bits::bit)) <= 8")
def near_photo_links(spark, sf_dir):
    return duplicates.near_edges(_photos(spark, sf_dir))


@query(
    _NEAR_PHOTOS + ", look as (select *, count(*) over (partition by bits) as m, row_number() over (partition by bits order by modified, path, id) - 1 as r from photos), "
    "sets as (select 'look' as reason, bits as g, string_agg(path, '|' order by path) as s, count(*) as n, sum(case when r > 0 then size else 0 end) as wasted from look where m > 1 group by bits "
    "union all select 'near', 'near:' || root, string_agg(path, '|' order by path), count(*), sum(case when keep_rank > 0 then size else 0 end) from near group by root), "
    "one as (select s, case when bool_or(reason = 'look') then 'look' else 'near' end as reason, any_value(n) as n, any_value(wasted) as wasted from sets group by s) "
    "select reason, count(*) as n_groups, sum(n)::bigint as members, sum(wasted)::bigint as wasted from one group by reason"
)
def photo_report(spark, sf_dir):
    """The report's photo searches (name, look, near) merged, by reason."""
    found = duplicates.groups(duplicates.report(_photos(spark, sf_dir), exact_copies=False, photos=True))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("members"), F.sum("wasted").alias("wasted"))


@query()
def similar_names(spark, sf_dir):
    """Names that look alike; difflib's ratio has no form in SQL, so a test holds them against all pairs."""
    return similar.similar_names(fixtures.named_files(spark, sf_dir))


_TOKEN_SETS = sql.DOCS + f", s as (select id, list_sort({_TOKENS}) as t from files where len({_TOKENS}) > 0), c as (select t, min(id) as class_id, count(*) as members from s group by t)"


@query(_TOKEN_SETS + " select id, class_id, members from s join c using (t)")
def token_classes(spark, sf_dir):
    return duplicates.token_classes(_docs(spark, sf_dir))


@query(
    _TOKEN_SETS + ", k as (select class_id as id, members, len(t) as n, unnest(t) as token from c), "
    "o as (select x.id as a, y.id as b, count(*) as k, any_value(least(x.n, y.n)) as n, any_value(x.members) as members_a, any_value(y.members) as members_b from k x join k y on x.token = y.token and x.id < y.id group by 1, 2) "
    "select a, b, k / n as overlap, members_a, members_b from o where k / n >= 0.72::double"
)
def token_overlap(spark, sf_dir):
    return duplicates.token_overlap(_docs(spark, sf_dir))


_MERGED = (
    sql.DOCS + _NAME_GROUPS + _TEXT_GROUPS + ", allg as (select * from byname union all select * from bytext), "
    "keys as (select gid, reason, string_agg(path, '|' order by path) as set_key from (select distinct gid, reason, path from allg) group by gid, reason), "
    "best as (select set_key, min(case reason when 'name' then '0' else '1' end || gid) as pick, "
    "case when count(distinct reason) = 2 then 'name+content' else min(reason) end as combined from keys group by set_key), "
    "merged as (select a.gid, a.kind, b.combined as reason, a.id, a.path, a.size, a.modified, a.category, a.keep_rank from allg a join keys k on a.gid = k.gid and a.reason = k.reason "
    "join best b on b.set_key = k.set_key and b.pick = case a.reason when 'name' then '0' else '1' end || a.gid)"
)


@query(_MERGED + " select gid, kind, reason, id, path, keep_rank from merged")
def merged_groups(spark, sf_dir):
    docs = _documents(_docs(spark, sf_dir))
    both = duplicates.by_name(docs, "similar_document").unionByName(duplicates.by_text(docs))
    return duplicates.merged(both).select("gid", "kind", "reason", "id", "path", "keep_rank")


_REPORT = (
    _MERGED + sql.EXACT + ", contained as (select m.gid, m.reason from merged m left join (select path, min(gid) as e from exact group by path) x on m.path = x.path "
    "group by m.gid, m.reason having count(*) = count(x.e) and count(distinct x.e) = 1), "
    "report as (select gid, kind, reason, id, path, size, modified, category, keep_rank from merged m where not exists (select 1 from contained c where c.gid = m.gid and c.reason = m.reason) "
    "union all select gid, kind, reason, id, path, size, modified, category, keep_rank from exact), "
    f"g as ({sql.GROUP_SUMMARY} from report group by gid, kind, reason)"
)


def _report(spark, sf_dir) -> DataFrame:
    return duplicates.report(_docs(spark, sf_dir), documents=True)


@query(_REPORT + " select gid, kind, reason, n, size, category, name, wasted from g")
def dups_report(spark, sf_dir):
    found = duplicates.report_order(duplicates.groups(_report(spark, sf_dir)))
    return found.select("gid", "kind", "reason", "n", "size", "category", "name", "wasted")


@query(_REPORT + " select category, kind, count(*) as n_groups, sum(wasted) as wasted from g group by rollup(category, kind)")
def dups_by_type(spark, sf_dir):
    return duplicates.wasted_by(duplicates.groups(_report(spark, sf_dir)))


_RANK = "case category " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(names.CATEGORIES)) + " else 9 end"


@query(
    _REPORT + f", o as (select *, row_number() over (order by {_RANK}, category, kind, n desc, size desc, gid, reason) as r from g), p as (select * from o where r between 81 and 160) "
    "select gid, kind, reason, n, category, lag(category) over (order by r) is distinct from category as section_start from p"
)
def dups_page(spark, sf_dir):
    found = duplicates.page(duplicates.groups(_report(spark, sf_dir)), 1)
    return found.select("gid", "kind", "reason", "n", "category", "section_start")


@query(
    _REPORT + ", l as (select * from report where path not in (select path from files where id % 9 = 0)) "
    "select gid, kind, reason, id, path, row_number() over (partition by gid, kind, reason order by keep_rank) - 1 as keep_rank from l "
    "where (gid, kind, reason) in (select gid, kind, reason from l group by gid, kind, reason having count(*) > 1)"
)
def prune_groups(spark, sf_dir):
    gone = _docs(spark, sf_dir).where("id % 9 = 0")
    return duplicates.prune(_report(spark, sf_dir), gone).select("gid", "kind", "reason", "id", "path", "keep_rank")


@query(sql.DOCS + f"select id, size from files where {_DOC} order by size desc, id limit 120")
def top_k_size(spark, sf_dir):
    return duplicates.largest(_documents(_docs(spark, sf_dir)), 120).select("id", "size")


_EXTRAS = (
    _REPORT + ", kept as (select distinct path from report where kind = 'exact' and keep_rank = 0), "
    "extras as (select gid, kind, reason, id, path, size, keep_rank from (select *, row_number() over (partition by path order by kind <> 'exact', gid, reason, id) as r "
    "from report where keep_rank > 0 and path not in (select path from kept)) where r = 1)"
)


@query(_EXTRAS + " select id, path, size, kind, case keep_rank when 0 then 'Keep (oldest)' when 1 then 'Extra copy' else 'Extra copy ' || keep_rank end as role from extras")
def extras(spark, sf_dir):
    found = duplicates.extras(_report(spark, sf_dir))
    return found.select("id", "path", "size", "kind", duplicates.role(F.col("keep_rank")).alias("role"))


@query(_EXTRAS + " select count(*) as n_files, coalesce(sum(size), 0) as bytes, count(distinct gid || reason) as n_groups from extras")
def extras_summary(spark, sf_dir):
    return duplicates.extras(_report(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_distinct(F.concat("gid", "reason")).alias("n_groups"))


_EXACT_EXTRAS = sql.DOCS + sql.EXACT + ", extras as (select id, path, regexp_extract(path, '([^/]*)$', 1) as name from exact where keep_rank > 0)"


def _manifest(spark, sf_dir) -> DataFrame:
    return layout.quarantine_manifest(duplicates.extras(duplicates.exact(_docs(spark, sf_dir))), "/quarantine", SESSION)


_NUMBERED = "case when k = 0 then name else substr(name, 1, length(name) - length(regexp_extract(name, '^.+(\\.[^.]+)$', 1))) || '_' || k || regexp_extract(name, '^.+(\\.[^.]+)$', 1) end"


@query(_EXACT_EXTRAS + f", n as (select path, name, row_number() over (partition by name order by id) - 1 as k from extras) select path as original, '/quarantine/{SESSION}/' || {_NUMBERED} as quarantine from n")
def quarantine_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query(_EXACT_EXTRAS + f", n as (select path, name, row_number() over (partition by name order by id) - 1 as k from extras) select '/quarantine/{SESSION}/' || {_NUMBERED} as source, path as destination from n")
def restore_plan(spark, sf_dir):
    return layout.restore_plan(_manifest(spark, sf_dir))


# ---- layouts ----


def _layout_query(name: str):
    def run(spark, sf_dir):
        return layout.plan(_docs(spark, sf_dir), [name], sql.ROOT, OPTIONS).select("id", "destination")

    query(sql.planned(name) + " select id, destination from plan", f"layout_{name}")(run)


for _layout in layout.LAYOUTS:
    _layout_query(_layout)


@query(
    sql.DOCS + f", sane as (select *, {sql.SANITISED} as sname from files), "
    f"p as (select id, sname, regexp_replace({sql.layout('type_date')}, '/[^/]*$', '') as a, regexp_replace({sql.layout('by_year_month')}, '/[^/]*$', '') as b from sane), "
    "q as (select id, sname, list_concat(string_split(substr(a, 7), '/'), string_split(substr(b, 7), '/')) as parts from p) "
    f"select id, '{sql.ROOT}/' || array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), '/') || '/' || sname as destination from q"
)
def layout_combined(spark, sf_dir):
    return layout.plan(_docs(spark, sf_dir), ["by_year_month", "type_date"], sql.ROOT, OPTIONS).select("id", "destination")


@query(
    "select source as owner, category, case when category = 'Audio' then source || '/Audio' else template end as template from (select distinct source from documents where source is not null) "
    "cross join (values ('Photos', 'MyArchive/Photos/{year}/{month}'), ('Videos', 'MyArchive/Videos/{year}/{month}'), ('Documents', 'MyArchive/Documents/{ext}'), ('Audio', ''), ('Archives', 'MyArchive/Archives'), ('*', 'MyArchive/Other')) as t(category, template)"
)
def custom_rules(spark, sf_dir):
    """Each source's own rules text: the default rules, then a line of its own, which wins."""
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source is not null").select("source").distinct()
    own = F.concat(F.lit(layout.DEFAULT_RULES + "\nAudio = "), F.col("source"), F.lit("/Audio\n"))
    return layout.parse_rules(sources.select(F.col("source").alias("owner"), own.alias("rules")))


@query(
    sql.planned("type_date") + f" select id, path, category, case when id % 7 = 0 then null else destination end as destination, case when id % 7 = 0 then 'missing' end as skip_reason from plan where category in ('Photos', 'Documents', 'Other')"
)
def plan(spark, sf_dir):
    files = _docs(spark, sf_dir)
    return layout.plan(files, ["type_date"], sql.ROOT, OPTIONS, ["Photos", "Documents", "Other"], files.where("id % 7 <> 0").select("path"))


_FOLDERS = sql.planned("life_areas") + ", d as (select distinct string_split(regexp_replace(substr(destination, 7), '/[^/]*$', ''), '/') as parts from plan), tree as (select distinct array_to_string(parts[1:i], '/') as folder from (select parts, unnest(range(1, len(parts) + 1)) as i from d))"


def _life(spark, sf_dir):
    return layout.plan(_docs(spark, sf_dir), ["life_areas"], sql.ROOT, OPTIONS)


@query(_FOLDERS + " select folder, len(string_split(folder, '/'))::int as depth from tree")
def folder_tree(spark, sf_dir):
    return layout.folder_tree(_life(spark, sf_dir), sql.ROOT)


@query(
    _FOLDERS + " select case when contains(folder, '/') then regexp_replace(folder, '/[^/]*$', '') else '' end as parent, regexp_extract(folder, '([^/]*)$', 1) as name, true as is_dir, null as source from tree "
    "union all select regexp_replace(substr(destination, 7), '/[^/]*$', ''), regexp_extract(destination, '([^/]*)$', 1), false, path from plan"
)
def plan_children(spark, sf_dir):
    return layout.children(_life(spark, sf_dir), sql.ROOT)


_ITEM_PLAN = sql.ITEMS + ", o as (select *, row_number() over (order by id, path, size) as ord from files), p as (select ord, category, name, row_number() over (partition by category, name order by ord) - 1 as k from o)"


def _items_plan(spark, sf_dir) -> DataFrame:
    """Items in a flat layout. Equal (id, path, size) rows are interchangeable; the order number is unique: id, then a rank within the id."""
    from pyspark.sql import Window

    rows = fixtures.files_items(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("path", "size"))
    return rows.select((F.col("id") * 1000 + rank).alias("ord"), "id", F.concat_ws("/", F.lit(sql.ROOT), "category", _name()).alias("destination"))


@query(_ITEM_PLAN + f" select '{sql.ROOT}/' || category || '/' || ({_NUMBERED}) as final_destination, k > 0 as renamed from p")
def unique_names(spark, sf_dir):
    return naming.unique_names(_items_plan(spark, sf_dir)).select("final_destination", "renamed")


@query(
    _ITEM_PLAN + ", t as (select distinct category, name from files where id % 11 = 0), e as (select p.category, p.name, p.k + (t.name is not null)::int as k from p left join t on p.category = t.category and p.name = t.name) "
    f"select '{sql.ROOT}/' || category || '/' || ({_NUMBERED}) as final_destination, k > 0 as renamed from e"
)
def unique_names_existing(spark, sf_dir):
    rows = _items_plan(spark, sf_dir)
    taken = rows.where("id % 11 = 0").select("destination").distinct()
    return naming.unique_names(rows, taken).select("final_destination", "renamed")


@query(
    sql.planned("shallow_by_type") + ", p as (select id, path, destination, regexp_extract(destination, '([^/]*)$', 1) as name, regexp_replace(destination, '/[^/]*$', '') as folder, "
    f"row_number() over (partition by destination order by id) - 1 as k from plan), f as (select *, folder || '/' || ({_NUMBERED}) as final_destination from p) "
    "select id, path, final_destination, k > 0 as renamed, '[preview-copy' || case when k > 0 then '-unique' else '' end || '] ' || path || ' -> ' || final_destination as message from f"
)
def dry_run_log(spark, sf_dir):
    return layout.dry_run(layout.plan(_docs(spark, sf_dir), ["shallow_by_type"], sql.ROOT, OPTIONS))


@query(sql.planned("life_areas") + f" select distinct '{sql.ROOT}/' || split_part(destination, '/', 3) || '/README.txt' as path, 'Folder: ' || split_part(destination, '/', 3) || ' | Layout: life_areas' as text from plan")
def readme_notes(spark, sf_dir):
    return layout.notes(_life(spark, sf_dir), sql.ROOT, "life_areas")


# ---- reports and recommendations ----


@query(sql.DOCS + f"select id, lower(path) as sort_path, path || ' | ' || category || ' | ' || {sql.human_bytes('size')} || ' | ' || strftime(ts, '%Y-%m-%d %H:%M:%S') as line from files")
def inventory_lines(spark, sf_dir):
    return report.inventory_lines(_docs(spark, sf_dir))


@query(
    sql.DOCS + f", o as ({fixtures.LISTING_OUTCOMES}) select 'category' as section, category as key, count(*) as value from files group by 2 union all select 'scan', outcome, count(*) from o group by 2 "
    "union all select 'totals', 'n_files', count(*) from files union all select 'totals', 'total_bytes', sum(size) from files union all select 'totals', 'disk_bytes', sum(size) from files "
    "union all select 'totals', 'disk_files', count(*) from files union all select 'totals', 'archive_members', 0"
)
def overview(spark, sf_dir):
    return report.overview(_docs(spark, sf_dir), fixtures.listing_outcomes(spark, sf_dir))


_SIG = (
    "count(*) filter (where regexp_matches(p, '(?:^|/)((?:19|20)\\d{2})[/_\\-](0[1-9]|1[0-2])(?:/|$)')) as year_month, "
    "count(*) filter (where not regexp_matches(p, '(?:^|/)((?:19|20)\\d{2})[/_\\-](0[1-9]|1[0-2])(?:/|$)') and regexp_matches(p, '(?:^|/)((?:19|20)\\d{2})(?:/|$)')) as year_only, "
    "count(*) filter (where regexp_matches(p, '" + advise.EXT_FOLDER + "')) as ext_folder, count(*) filter (where regexp_matches(p, '" + advise.FLAT_HINT + "')) as flat_hint, "
    "count(*) filter (where length(p) - length(replace(p, '/', '')) <= 2) as shallow, count(*) as total"
)


@query(sql.DOCS + f", t as (select *, lower(parent) as p from files) select category, {_SIG} from t group by grouping sets ((category), ())")
def path_signals(spark, sf_dir):
    return advise.path_signals(_docs(spark, sf_dir))


@query(
    sql.DOCS + ", a as (select count(*) as total, count(*) filter (where len(string_split(path, '/')) >= 10) as deep, count(*) filter (where category in ('Photos', 'Videos', 'Audio')) as media, "
    "count(*) filter (where category = 'Documents') as documents from files) select *, deep > 0 as warn_deep, total >= 100 as large_library, media / total >= 0.5 as media_heavy, documents > 0 as has_documents from a"
)
def advice_facts(spark, sf_dir):
    return advise.advice_facts(_docs(spark, sf_dir))


_FIT = {k: "[" + ", ".join(f"'{x}'" for x in dict.fromkeys([*v, *layout.LAYOUTS])) + "]" for k, v in advise.FITS.items()}
_COUNTS = (
    sql.DOCS + ", c as (select source_root, count(*) as n, count(*) filter (where category in ('Photos', 'Videos', 'Audio')) as media, count(*) filter (where category = 'Documents') as docs, "
    "count(distinct category) as cats from files group by 1), "
    f"ranked as (select source_root, n, media, docs, case when media / n >= 0.6 and docs / n <= 0.25 then {_FIT['media']} when docs / n >= 0.5 then {_FIT['documents']} when cats >= 3 then {_FIT['mixed']} else {_FIT['few']} end as layouts from c)"
)


@query(_COUNTS + " select source_root, i::int as place, layouts[i] as layout from (select source_root, layouts, unnest(range(1, len(layouts) + 1)) as i from ranked)")
def layout_rank(spark, sf_dir):
    return advise.layout_rank(_docs(spark, sf_dir))


_MODE = (
    "case when category = 'Documents' and ext_folder / total >= 0.2 then 'extension' when category in ('Photos', 'Videos', 'Audio') and year_month / total >= 0.2 then 'year_month' "
    "when category in ('Photos', 'Videos', 'Audio') and year_only / total >= 0.2 then 'year' when category in ('Photos', 'Videos', 'Audio') and (flat_hint + shallow) / (2 * total) >= 0.6 and media_date_depth <> 'none' then 'flat' "
    "when category in ('Archives', 'Other') and (flat_hint + shallow) / (2 * total) >= 0.55 then 'flat' when category = 'Documents' and (flat_hint + shallow) / (2 * total) >= 0.55 and ext_folder / total < 0.1 then 'flat' else 'layout_default' end"
)


@query(
    _COUNTS + f", t as (select *, lower(parent) as p from files), s as (select source_root, category, {_SIG} from t group by 1, 2), w as (select source_root, {_SIG} from t group by 1), "
    "b as (select w.source_root, r.layouts[1] as layout_ids, case when year_month / total >= 0.15 then 'year_month' when year_only / total >= 0.15 and year_month / total < 0.08 then 'year' "
    "when flat_hint / total >= 0.35 or (flat_hint / total + shallow / total) / 2 >= 0.55 then 'none' when media / n >= 0.45 then 'year_month' when media / n < 0.2 then 'none' else 'year_month' end as media_date_depth "
    f"from w join ranked r on r.source_root = w.source_root), m as (select s.*, b.media_date_depth from s join b on b.source_root = s.source_root), q as (select *, {_MODE} as mode from m) "
    "select b.source_root, b.layout_ids, b.media_date_depth, coalesce(max(case when category = 'Documents' then case when ext_folder / total >= 0.2 then true when shallow / total >= 0.6 and ext_folder / total < 0.08 then false else true end end), true) as documents_by_ext, "
    + ", ".join(f"coalesce(max(case when category = '{c}' then mode end), 'layout_default') as \"mode_{c}\"" for c in names.CATEGORIES)
    + " from b left join q on q.source_root = b.source_root group by 1, 2, 3"
)
def suggestion(spark, sf_dir):
    return advise.suggestion(_docs(spark, sf_dir))


_SAVED = {"Archives": "flat", "Other": "year"}
_SAVED_LAYOUTS = ["type_date", "media_library", "documents_first"]


def _with_saved(text: str) -> str:
    """The suggestion's SQL with saved settings where the statistics say nothing."""
    text = text.replace("else 'year_month' end as media_date_depth", "else 'year' end as media_date_depth").replace("when media / n >= 0.45 then 'year_month'", "when media / n >= 0.45 then 'year'")
    text = text.replace("then false else true end end), true) as documents_by_ext", "then false else false end end), false) as documents_by_ext")
    listed = ", ".join(f"'{x}'" for x in _SAVED_LAYOUTS)
    text = text.replace("r.layouts[1] as layout_ids", f"case when r.layouts[1] in ({listed}) then '{','.join(x for x in layout.LAYOUTS if x in _SAVED_LAYOUTS)}' else r.layouts[1] end as layout_ids")
    for c, mode in _SAVED.items():
        own = f"coalesce(max(case when category = '{c}' then mode end), 'layout_default')"
        text = text.replace(f'{own} as "mode_{c}"', f"case {own} when 'layout_default' then '{mode}' else {own} end as \"mode_{c}\"")
    return text


@query(_with_saved(ORACLE_SQL["suggestion"]))
def suggestion_saved(spark, sf_dir):
    return advise.suggestion(_docs(spark, sf_dir), saved_depth="year", saved_by_ext=False, saved_modes=_SAVED, saved_layouts=_SAVED_LAYOUTS)


# ---- the engine's smaller operators ----


@query(
    sql.DOCS + f", m as (select 'm' || id || ':' || member_ord as key, archive_container || '!' || archive_member as shown, size, modified, content from ({fixtures.ZIP_MEMBERS})), "
    "u as (select 'f' || id as key, path as shown, size, modified, content from files where content is not null or size = 0 union all select key, shown, size, modified, content from m where content is not null), "
    "g as (select size, content from u group by 1, 2 having count(*) > 1) select shown as display_path, size, "
    "row_number() over (partition by u.size, u.content order by modified, shown, key) - 1 as keep_rank from u join g using (size, content)"
)
def member_copies(spark, sf_dir):
    found = duplicates.exact_with_members(_docs(spark, sf_dir), fixtures.member_files(spark, sf_dir))
    # a member is shown here as container!member
    box, shown = F.col("archive_container"), F.col("display_path")
    joined = F.concat(box, F.lit("!"), F.substring(shown, F.length(box) + F.length(F.lit(names.INSIDE)) + 1, F.length(shown)))
    return found.select(F.when(box.isNotNull(), joined).otherwise(shown).alias("display_path"), "size", "keep_rank")


@query(_REPORT + ", marked as (select path from files where id % 4 <> 1) select min(id) as id, path, min(size) as size, min(category) as category from report where path in (select path from marked) group by path")
def marked_files(spark, sf_dir):
    marked = _docs(spark, sf_dir).where("id % 4 <> 1").select("path")
    return duplicates.marked_files(_report(spark, sf_dir), marked)


@query(
    _REPORT + ", h as (select *, case kind when 'exact' then 'Exact copies' when 'similar_photo' then 'Similar photos' else 'Similar documents' end as label from g) select gid, reason, "
    "label || ' · ' || category || ' | ' || case when length(name) > 36 then substr(name, 1, 33) || '...' else name end || ' | ' || n || ' files' as heading from h"
)
def group_headings(spark, sf_dir):
    return duplicates.groups(_report(spark, sf_dir)).select("gid", "reason", "heading")



@query(
    _FOLDERS + ", o as (select folder, row_number() over (order by string_split(lower(folder), '/'), folder) as r from tree) "
    "select repeat('    ', len(string_split(folder, '/')) - 1) || regexp_extract(folder, '([^/]*)$', 1) as line, folder from o where r <= 100"
)
def tree_listing(spark, sf_dir):
    """The first 100 folders of the plan's tree, as it is shown."""
    rows = layout.tree_order(layout.folder_tree(_life(spark, sf_dir), sql.ROOT)).limit(100)
    return rows.select(F.concat(F.repeat(F.lit("    "), F.col("depth") - 1), names.basename(F.col("folder"))).alias("line"), "folder")


@query(sql.DOCS + ", c as (select source_root, category, count(*) as n_files from files group by 1, 2) select source_root, category, n_files from c")
def default_categories(spark, sf_dir):
    return index.default_categories(_docs(spark, sf_dir))


@query(
    sql.DOCS + ", chosen as (select distinct source_root, category from files where id % 2 = 0) select id, path, category from files where (source_root, category) in (select source_root, category from chosen)"
)
def chosen_categories(spark, sf_dir):
    files = _docs(spark, sf_dir)
    return index.in_categories(files, index.default_categories(files.where("id % 2 = 0"))).select("id", "path", "category")


_CLOCK = (
    "case when s < 1 then printf('%.1fs', round_even(s, 1)) when w >= 3600 then printf('%dh %02dm %02ds', w // 3600, w % 3600 // 60, w % 60) "
    "when w >= 60 then printf('%dm %02ds', w // 60, w % 60) else printf('%ds', w) end"
)


@query(sql.DOCS + f", t as (select id, size / 8.0 as s, round_even(size / 8.0, 0)::bigint as w from files) select id, {_CLOCK} as shown from t")
def human_durations(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", formats.human_duration(F.col("size") / 8.0).alias("shown"))


@query(
    f"with m as ({fixtures.ZIP_MEMBERS}), a as (select archive_container, sum(size) * 1000 as bytes from m group by 1), v as (select archive_container, bytes, bytes + greatest(67108864, floor(bytes * 0.1)::bigint) as needed, "
    "case when regexp_extract(archive_container, '^/vault/(src[0-9]+)', 1) = 'src3' then null else 68000000 end as free_bytes from a) "
    "select archive_container, bytes, needed, free_bytes, coalesce(free_bytes < needed, false) as low from v"
)
def expansion_space(spark, sf_dir):
    members = fixtures.zip_members(spark, sf_dir).withColumn("volume", F.regexp_extract("archive_container", "^/vault/(src[0-9]+)", 1))
    archives = members.groupBy("archive_container", "volume").agg((F.sum("size") * 1000).alias("bytes"))
    volumes = archives.select("volume").distinct().where("volume <> 'src3'").withColumn("free_bytes", F.lit(68_000_000).cast("long"))
    return index.expansion_space(archives, volumes)


@query(f"with o as ({fixtures.LISTING_OUTCOMES}) select outcome as status, count(*) as n from o group by 1")
def action_log(spark, sf_dir):
    return index.action_summary(fixtures.listing_outcomes(spark, sf_dir).withColumnRenamed("outcome", "status"))


@query(sql.DOCS + ", c as (select category, count(*) as n_files, case category when 'Documents' then 40 when 'Photos' then 30 end as \"limit\" from files group by 1) select category, n_files, \"limit\" from c where n_files > \"limit\"")
def large_library(spark, sf_dir):
    return index.large_library(_docs(spark, sf_dir), 40, 30)


@query(
    sql.DOCS + ", r as (select f.source_root, f.id, f.id % 3 as device_id, case when f.source_root like '%web' then null else 1 end as root_device_id from files f) "
    "select id, source_root, root_device_id is not null and device_id <> root_device_id as cross_device from r"
)
def on_device(spark, sf_dir):
    files = _docs(spark, sf_dir).withColumn("device_id", F.col("id") % 3)
    roots = files.where("source_root not like '%web'").select("source_root", F.lit(1).cast("long").alias("root_device_id")).distinct()
    return index.on_device(files, roots).select("id", "source_root", "cross_device")


@query(
    f"with m as ({fixtures.ZIP_MEMBERS}), w as (select distinct archive_container as source_root, id // 1000 % 4 as k from m), "
    "e as (select source_root, case k when 0 then 'missing' when 1 then 'not a folder' when 2 then 'not readable' end as error from w) select source_root, error from e where error is not null"
)
def missing_roots(spark, sf_dir):
    roots = fixtures.zip_members(spark, sf_dir).select(F.col("archive_container").alias("source_root"), F.expr("id div 1000 % 4").alias("_k")).distinct()
    there = roots.where("_k > 0").select("source_root", (F.col("_k") > 1).alias("is_dir"), (F.col("_k") > 2).alias("readable"))
    return index.missing_roots(roots.select("source_root"), there)


@query(
    sql.DOCS + f" select id, name, lower(suffix) as extension, {sql.human_bytes('size')} as shown_size, strftime(ts, '%Y-%m-%d %H:%M') as shown_time, parent as folder, substr(sha256(content), 1, 16) as short_hash from files"
)
def file_cards(spark, sf_dir):
    files = _docs(spark, sf_dir)
    return report.file_cards(files.withColumn("hash_value", contents.content_digest(F.col("content"), F.col("size"))))


_SESSIONS = "strftime(to_timestamp(1735689600 + id % 1000 * 60) at time zone 'UTC', '%Y%m%d_%H%M%S')"


@query(_EXACT_EXTRAS + f" select max({_SESSIONS}) as session from extras")
def latest_session(spark, sf_dir):
    rows = duplicates.extras(duplicates.exact(_docs(spark, sf_dir)))
    session = F.date_format(F.timestamp_seconds(F.lit(1735689600) + F.col("id") % 1000 * 60), "yyyyMMdd_HHmmss")
    manifests = rows.select(F.concat(F.lit("/quarantine/"), session, F.lit("/"), names.basename(F.col("path"))).alias("quarantine"), "path")
    # a hidden folder beside the sessions is none
    hidden = manifests.select(F.lit("/quarantine/.trash/x").alias("quarantine"), "path")
    return layout.latest_session(manifests.unionByName(hidden), "/quarantine")


@query(
    sql.DOCS + ", p as (select id, size, content, count(*) over (partition by size, substr(content, 1, 64)) as n from files) select id, size, case when n > 1 or size <= 64 then sha256(content) end as digest from p"
)
def two_phase(spark, sf_dir):
    return duplicates.two_phase_digest(_docs(spark, sf_dir), 64)
