"""Every query with SQL gives DuckDB's rows."""

import math
import os

import duckdb
import pytest

from plumbline import scenarios  # noqa: F401
from plumbline.queries import ORACLE_SQL, QUERIES

AT = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return f"{v:.9g}" if math.isfinite(v) else str(v)
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_is_the_sql(spark, db, name):
    got = QUERIES[name](spark, AT)
    names = sorted(got.columns)
    found = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(n)] for n in names) for r in found.fetchall()]
    have = [tuple(r[n] for n in names) for r in got.collect()]
    assert plain(have) == plain(want)
    assert have


def test_split_reconstruction_returns_candidates_of_any_length(spark, monkeypatch):
    from pyspark.sql import functions as F

    from plumbline.operators import splits

    found = splits.split_candidates

    def with_chance_hit(*args):
        own = found(*args)
        return own.unionByName(own.where("boundary = 1").withColumn("declared_total_bytes", F.lit(90).cast(own.schema["declared_total_bytes"].dataType)))

    before = QUERIES["split_reconstruction"](spark, AT).count()
    monkeypatch.setattr(splits, "split_candidates", with_chance_hit)
    assert QUERIES["split_reconstruction"](spark, AT).count() == before + 1
