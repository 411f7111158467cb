"""The queries that have SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpusloom.llm import op_queries, oracles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def rows(table):
    columns = sorted(table.column_names)
    return columns, sorted(str([row[c] for c in columns]) for row in table.to_pylist())


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    assert rows(op_queries.QUERIES[name](spark, DATA).toArrow()) == rows(con.execute(oracles.ORACLE_SQL[name]).to_arrow_table())
