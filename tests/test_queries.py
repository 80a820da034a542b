import os

import duckdb
import pytest

from shiftlens import file_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_equals_its_sql(spark, oracle, name):
    got = queries.QUERIES[name](spark, SF)
    cursor = oracle.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(str(r) for r in cursor.fetchall())
    assert sorted(str(tuple(r)) for r in got.select(*(f"`{n}`" for n in names)).collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("balance", [None, -995.0, -905.0, 1225.0])
def test_number_formats_equals_its_sql_beyond_ten_suppliers(spark, tmp_path, balance):
    got = spark.read.parquet(f"{SF}/supplier.parquet").selectExpr("explode(array(s_suppkey, s_suppkey + 10, s_suppkey * 5870)) as s_suppkey", "s_acctbal")
    if balance:
        got = got.selectExpr("s_suppkey", f"{balance}D as s_acctbal")
    got.write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = sorted(map(str, con.execute(queries.ORACLES["number_formats"]).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES["number_formats"](spark, str(tmp_path)).collect()) == want
