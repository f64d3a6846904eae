"""Each query against its SQL in DuckDB, over the smallest tables."""

import decimal

import duckdb
import pytest

from cartulary.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    return round(float(v), 6) if isinstance(v, (int, float, decimal.Decimal)) else v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert ours == theirs


def test_member_copies_of_equal_members_and_checksums(spark, tmp_path):
    """Members that copy one another and a file, and two texts of one size and CRC-32; on the smallest tables no member has a copy."""
    spark.createDataFrame([(1, "plumless", "en", "web", 8), (2, "plumless", "en", "web", 8)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", "plumless"), (1, 1, "user", "buckeroo"), (2, 0, "assistant", "buckeroo"), (3, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    theirs = sorted(c.sql(registry.ORACLE_SQL["member_copies"]).fetchall())
    assert len(theirs) == 5 and sorted(tuple(r) for r in registry.QUERIES["member_copies"](spark, str(tmp_path)).collect()) == theirs
