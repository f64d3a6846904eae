"""Projections of the driver's tables onto the engine's tables, for queries, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartulary.schema import as_files
from cartulary.session import table

FILES_DOCS = """
select doc_id as id,
  concat('/vault/', source, '/',
    case doc_id % 5 when 0 then 'downloads'
      when 1 then concat(cast(2015 + doc_id % 8 as string), '/', lpad(cast(1 + doc_id % 12 as string), 2, '0'))
      when 2 then cast(2015 + doc_id % 8 as string)
      when 3 then 'pdf' else lang end, '/',
    case when doc_id % 50 = 7 then 'invoice_' else 'report_' end,
    cast(cast(floor(doc_id / 3) as bigint) as string),
    case doc_id % 3 when 0 then '' when 1 then ' (1)' else '_copy' end,
    case doc_id % 8 when 0 then '.pdf' when 1 then '.DOCX' when 2 then '.txt' when 3 then '.md'
      when 4 then '.jpg' when 5 then '.mp4' when 6 then '.zip' else '' end) as path,
  n_chars as size,
  cast(1420070400 + (doc_id * 7919 % 3000) * 86400 as double) as modified,
  concat('/vault/', source) as source_root,
  text as content
from documents"""

FILES_ITEMS = """
select l_orderkey * 10 + l_linenumber as id,
  concat('/drive', cast(l_suppkey % 4 as string), '/', cast(year(l_shipdate) as string), '/',
    lpad(cast(month(l_shipdate) as string), 2, '0'), '/item_', cast(l_partkey as string),
    case l_linenumber % 4 when 0 then '.jpg' when 1 then '.pdf' when 2 then '.mp4' else '.zip' end) as path,
  cast(floor(l_extendedprice) as bigint) as size,
  cast(1420070400 + (l_partkey * 7919 % 3000) * 86400 as double) as modified,
  concat('/drive', cast(l_suppkey % 4 as string)) as source_root
from lineitem"""

ZIP_MEMBERS = """
select conv_id * 1000 + turn as id,
  concat('/vault/src', cast(conv_id % 20 as string), '/conv_', cast(conv_id as string), '.zip') as archive_container,
  concat(role, '/turn_', cast(turn as string), '.txt') as archive_member,
  turn as member_ord, cast(length(text) as bigint) as size,
  cast(1704067200 + conv_id as double) as modified, text as content
from conversations"""

LISTING_OUTCOMES = """
select event_id as id,
  case event_id % 7 when 0 then 'symlink' when 1 then 'unreadable' when 2 then 'cross_device' else 'file' end as outcome
from events"""

MEDIA_GRID = """
select vec_id as id, slice(embedding, 1, 64) as grid from embeddings"""

#: Photos with copies: of each third a second one with the same pixels, of each fourth one with one pixel's sign turned round.
PHOTO_COPIES = """
select vec_id * 3 as id, vec_id, grid from (select vec_id, slice(embedding, 1, 64) as grid from embeddings)
union all select vec_id * 3 + 1, vec_id, grid from (select vec_id, slice(embedding, 1, 64) as grid from embeddings) where vec_id % 3 = 0
union all select vec_id * 3 + 2, vec_id, transform(grid, (x, i) -> if(i = vec_id % 40, -x, x)) from (select vec_id, slice(embedding, 1, 64) as grid from embeddings) where vec_id % 4 = 0"""

#: Files named by the beginning of their text.
NAMED_FILES = """
select doc_id as id, concat('/named/', substr(regexp_replace(lower(text), '[^a-z]+', ' '), 1, 24), '.txt') as path, n_chars as size, cast(doc_id as double) as modified, '/named' as source_root
from documents where text is not null"""

FILES_MEDIA = """
select vec_id as id, concat('/vault/photos/img_', cast(vec_id as string), '.jpg') as path,
  reverse(array_join(transform(v, x -> if(cast(x as double) >= m, '1', '0')), '')) as bits
from (select vec_id, v, aggregate(v, 0D, (a, x) -> a + cast(x as double)) / size(v) as m
      from (select vec_id, slice(embedding, 1, 64) as v from embeddings))"""


def _query(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {name}", "from {source}"), source=table(spark, sf_dir, name))


def files_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(_query(spark, sf_dir, "documents", FILES_DOCS))


def files_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(_query(spark, sf_dir, "lineitem", FILES_ITEMS))


def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "conversations", ZIP_MEMBERS)


def member_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members as rows of the files table, with their content and the checksum that an archive's directory holds."""
    rows = zip_members(spark, sf_dir)
    return as_files(rows.withColumn("path", F.col("archive_container")).withColumn("zip_crc", F.crc32(F.col("content").cast("binary"))))


def listing_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "events", LISTING_OUTCOMES)


def files_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "embeddings", FILES_MEDIA)


def media_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "embeddings", MEDIA_GRID)


def photo_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded grids (id, vec_id, grid), copies and near copies among them."""
    return spark.sql(PHOTO_COPIES.replace("from embeddings", "from {source}"), source=table(spark, sf_dir, "embeddings"))


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(_query(spark, sf_dir, "documents", NAMED_FILES))
