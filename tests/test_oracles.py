"""Every registered query against its SQL on the smallest data set."""

import duckdb
import pytest

import check_oracles
from docgauge.plans import load

SF = "/root/testdata/sf0.001"
CATALOG = load()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check_oracles.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(CATALOG.QUERIES))
def test_matches_sql(spark, con, name):
    line = check_oracles.check(spark, con, name, CATALOG.QUERIES[name], CATALOG.ORACLES.get(name), SF)
    assert line.startswith(("OK", "ROWS")), line
