"""Every query that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from gridloom.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, tmp_path, name):
    df = QUERIES[name](spark, SF)
    df.write.parquet(f"{tmp_path}/out")
    columns = ", ".join(f'"{c}"' for c in sorted(df.columns))
    con.execute(f"create or replace table o as {ORACLE_SQL[name]}")
    assert sorted(r[0] for r in con.execute("describe o").fetchall()) == sorted(df.columns)
    con.execute(f"create or replace table s as select * from '{tmp_path}/out/*.parquet'")
    assert con.execute("select count(*) from o").fetchall() == con.execute("select count(*) from s").fetchall()
    for a, b in (("o", "s"), ("s", "o")):
        assert con.execute(f"select {columns} from {a} except all select {columns} from {b} limit 3").fetchall() == []


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
