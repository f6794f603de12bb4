"""Every catalogue query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from fathom import catalog
from fathom.dsl import group_by, pipeline
from fathom.engine import Engine
from fathom.schema import EntityType

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    rows = sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect())
    if name in catalog.ORACLE:
        found = duck.sql(catalog.ORACLE[name])
        assert sorted(found.columns) == names
        assert rows == sorted(repr([plain(v) for v in r]) for r in found.project(",".join(f'"{n}"' for n in names)).fetchall())


@pytest.mark.parametrize("name", ["pipe_running_sum_ties", "pipe_rank_dense", "pipe_topn", "pipe_derive_chain", "pipe_lag_lead", "pipe_reads_join_step", "pipe_left_join", "authz_join_on", "pipe_filter_agg_having", "pipe_join_type_composite"])
def test_sql_without_limit_keeps_all_rows(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "LIMIT" not in catalog.ORACLE[name] and "Limit" not in plan.replace("WindowGroupLimit", "")


def test_rows_beyond_the_default_limit(spark):
    df = spark.range(10_001).withColumnRenamed("id", "k")
    own = Engine(spark).register(EntityType.of_frame("many", "k", df), df)
    step = lambda: pipeline("many").step("s", lambda s: s.derive("twice", "k * 2"))
    assert own.pipeline(step().all_rows().build()).count() == 10_001 and own.group_by(group_by("many").key("k").all_rows().build()).count() == 10_001
    assert own.pipeline(step().build()).count() == 10_000 and own.group_by(group_by("many").key("k").build()).count() == 10_000
