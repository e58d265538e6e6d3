"""Aliases of codes: rows that are there twice, codes of more than six digits, and missing ones, as in the query's SQL."""

import duckdb
import pytest

from tidewell.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = {
    "repeated": ("SELECT s.* REPLACE (s_suppkey + 1000 * i AS s_suppkey) FROM s, range(1 + s_suppkey % 2) r(i)", "SELECT * FROM c"),
    "repeated candidates": ("SELECT * FROM s", "SELECT c.* FROM c, range(1 + c_custkey % 2)"),
    "long codes": ("SELECT * FROM s", "SELECT c.* REPLACE (c_custkey + 10000000 * i AS c_custkey) FROM c, range(2) r(i)"),
    "missing": ("SELECT * FROM s UNION ALL SELECT NULL, '123', 3, 0.0 UNION ALL SELECT 7, NULL, 3, 0.0 UNION ALL SELECT -77, 'y', 3, 0.0", "SELECT * FROM c UNION ALL SELECT NULL, 'x123', 3, 0.0, 'a' UNION ALL SELECT 900, NULL, 3, 0.0, 'a'"),
}


@pytest.mark.parametrize("case", TABLES)
def test_aliases_equal_their_sql_on_odd_tables(spark, tmp_path, case):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW s AS SELECT s_suppkey, s_name, s_suppkey % 5 AS s_nationkey, s_acctbal FROM '{DATA}/supplier.parquet' UNION ALL SELECT c_custkey + 100, c_name, c_custkey % 5, 0.0 FROM '{DATA}/customer.parquet'")
    duck.sql(f"CREATE VIEW c AS SELECT c_custkey, c_name, c_custkey % 5 AS c_nationkey, c_acctbal, c_mktsegment FROM '{DATA}/customer.parquet'")
    for name, rows in zip(("supplier", "customer"), TABLES[case], strict=True):
        duck.sql(f"COPY ({rows}) TO '{tmp_path}/{name}.parquet'")
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = sorted(map(tuple, QUERIES["j13_match_aliases"](spark, str(tmp_path)).select("market", "code", "alias", "score").collect()), key=str)
    assert got == sorted(duck.sql(f"SELECT market, code, alias, score FROM ({ORACLES['j13_match_aliases']})").fetchall(), key=str) and got
