"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from speechlake import catalog, catalog_records, catalog_scalars, catalog_store  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "customer documents embeddings events labels lineitem nation orders pages part region supplier benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(table):
    names = sorted(table.column_names)
    cols = [table[c].to_pylist() for c in names]
    return names, sorted(zip(*cols, strict=True), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    assert got.num_rows > 0
    if name in catalog.ORACLES:
        assert norm(got) == norm(duck.sql(catalog.ORACLES[name]).to_arrow_table())
