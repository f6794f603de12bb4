"""The registered queries against their SQL on small tables."""

import os

import duckdb
import pytest

from fathom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    rows = sorted(repr(list(r)) for r in df.select(*columns).collect())
    assert rows == sorted(repr(list(r)) for r in found.project(",".join(columns)).fetchall())


def test_every_operator_has_a_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names and "groupby_q1" in names
