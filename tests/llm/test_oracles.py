"""Queries that SQL can express give DuckDB's rows."""

import os

import duckdb
import pytest

from plumbline.llm.queries import ORACLE_SQL, QUERIES

AT = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_the_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    got = QUERIES[name](spark, AT)
    found = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(map(str, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in found.fetchall())
