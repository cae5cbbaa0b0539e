"""Every registered query against its oracle SQL, at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest
from compare import TABLES, rows

from corrobora import plans

PLANS, ORACLES = plans.plans(), plans.oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query(name, spark, sf_dir, duck):
    got = PLANS[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, got.columns) == rows(want, want.columns)


def test_places_whose_numbers_read_as_error_pages(spark, tmp_path):
    rows_ = [(i, f"Customer#{i:09}") for i in (4, 404, 4041, 4042, 4043, 1404, 14043, 5043)]
    spark.createDataFrame(rows_, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(map(tuple, PLANS["validate_places"](spark, str(tmp_path)).select("c_custkey", "reason", "name").collect()))
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(con.sql(f"SELECT c_custkey, reason, name FROM ({ORACLES['validate_places']})").fetchall()) == got
    assert (14043, "navigation", None) in got and (5043, None, "Customer#000005043") in got


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(PLANS)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["o_orderkey", "c_name", "n_name", "o_totalprice"]
    assert set(e.oracle_sql()) <= set(e.queries())
