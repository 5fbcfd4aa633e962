import os

import pytest

import __spark_entry__
from tallystream.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_sql_belongs_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
@pytest.mark.parametrize("name", ["pointer_orders", "numeric_stats", "psi_features", "blend_search", "stream_velocity_events"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, expected))
