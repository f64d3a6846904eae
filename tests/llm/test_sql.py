"""The operators' queries against their SQL in DuckDB."""

import duckdb
import pytest

from cartulary.llm import registry
from tests.test_oracle import TABLES


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    found = con.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert ours == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
