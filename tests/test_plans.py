"""What plans look like, and that other ways of running a request give the same rows."""

import random

import pytest
from pyspark.sql import functions as F, Window as W

from fathom import catalog
from fathom.dsl import Op, Window, aggregate, query
from fathom.engine import Engine
from fathom.errors import QueryError
from fathom.operators import windows
from fathom.plans import predicates
from fathom.schema import Column, EntityType, Relation

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return plan(df).count("FileScan parquet")


@pytest.fixture
def orders(spark):
    return catalog.engine(spark, DATA, "orders")


@pytest.mark.parametrize(
    "op, value, pushed",
    [
        (Op.GREATER_THAN, 10, "GreaterThan(o_custkey,10)"), (Op.EQUALS, 10, "EqualTo(o_custkey,10)"), (Op.EQUALS, 10.0, "EqualTo(o_custkey,10)"), (Op.LESS_THAN_OR_EQUALS, -3, "LessThanOrEqual(o_custkey,-3)"),
        (Op.IN, ["7", 8, "x", "07"], "In(o_custkey, [7,8])"),
    ],
)
def test_integer_filters_reach_the_scan(orders, op, value, pushed):
    found = predicates.condition(F.col("o_custkey"), op, value, orders.frames["orders"].schema["o_custkey"].dataType)
    assert pushed in plan(orders.frames["orders"].where(found))


def test_search_pushes_and_prunes(orders):
    text = plan(orders.search(query("orders").where("o_custkey").gt(10).where("o_orderkey").eq(7).fields("o_custkey").order_by("o_orderkey").limit(5).build()))
    assert "GreaterThan(o_custkey,10)" in text and "EqualTo(o_orderkey,7)" in text and "o_orderstatus" not in text


def test_numbers_of_integer_columns(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (2**31 - 1,)], "n int")
    kind = df.schema["n"].dataType
    rows = lambda op, value: sorted(r.n for r in df.where(predicates.condition(F.col("n"), op, value, kind)).collect())
    assert rows(Op.GREATER_THAN, 1.5) == [2, 2**31 - 1] and rows(Op.LESS_THAN, 2**40) == [1, 2, 2**31 - 1] and rows(Op.EQUALS, 2.0) == [2] and rows(Op.EQUALS, "2") == [2]
    assert rows(Op.IN, ["02", "2", " 1", "-0"]) == [2] and rows(Op.IN, ["x"]) == []
    assert df.where(~predicates.condition(F.col("n"), Op.IN, ["x"], kind)).count() == 3
    with pytest.raises(QueryError):
        predicates.condition(F.col("n"), Op.EQUALS, object(), kind)


def test_facets_read_once(spark):
    for name in ("agg_multi", "agg_having_scalar", "agg_terms", "agg_avg"):
        assert scans(catalog.QUERIES[name](spark, DATA)) == 1, name


def test_facets_together_equal_single_ones(spark, monkeypatch):
    rng = random.Random(1)
    pick = lambda values: rng.choice(values)
    rows = [(i, pick(["a", "b|c", "a|b", None]), pick(["c", "b", None, "b|c"]), pick([1, 2, 3, None]), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x string, y string, n int, v double")
    own = Engine(spark).register(EntityType.of_frame("t", "id", df), df)

    def parts(size, having):
        out = [
            lambda a: a.terms_of(["x", "y"], "xy", size), lambda a: a.terms("x", "x", 2), lambda a: a.range("n", "r", [("low", None, 2), ("rest", 2, None)]), lambda a: a.sum("v", "s"), lambda a: a.count("x", "d"), lambda a: a.count_all("all"),
            lambda a: a.avg("n", "m"), lambda a: a.terms("n", "n", 10),
        ]
        return [(lambda a, f=f: f(a).having("doc_count", Op.GREATER_THAN, 20)) if having else f for f in out]

    show = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    for having in (False, True):
        for large in (10**12, 0):
            monkeypatch.setattr(windows, "LARGE_BYTES", large)
            all_ = aggregate("t")
            for f in parts(5, False):
                all_ = f(all_)
            if having:
                all_ = all_.having("doc_count", Op.GREATER_THAN, 20)
            single = sum((own.aggregate(f(aggregate("t")).build()).collect() for f in parts(5, having)), [])
            assert show(own.aggregate(all_.build())) == sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in single)
    keys = [r.bucket_key for r in own.aggregate(aggregate("t").terms_of(["x", "y"], "xy", 100).build()).collect()]
    assert keys.count("a|b|c") == 2 and "a|" in keys and "|c" in keys and None not in keys
    empty = own.aggregate(aggregate("t").where("id", Op.LESS_THAN, 0).terms("x", "x").sum("v", "s").count_all("n").build()).collect()
    assert sorted((r.name, r.metric_val) for r in empty) == [("n", 0.0), ("s", None)]


@pytest.mark.parametrize("key", ["n", "d", "s", "t"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranges_equal_one_window(spark, key, descending):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(12)]), rng.choice([None, 0.5, 1.5, -2.0, 7.25]), rng.choice([None, "", "a", "ab", "abcdefgh", "abcdefgi", "é", "z"]), rng.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, n int, d double, s string, v int").withColumn("t", F.timestamp_seconds(F.col("n") * 1000))
    order = F.col(key).desc() if descending else F.col(key).asc()
    for kind, field in ((Window.RANK, None), (Window.DENSE_RANK, None), (Window.RUNNING_SUM, "v"), (Window.RUNNING_AVG, "v")):
        plain = df.withColumn("w", windows.function(kind, F.col(field) if field else None, 1).over(W.orderBy(order)))
        cut = windows.over_ranges(df, kind, "w", key, descending, field, 4)
        assert cut.schema == plain.schema or kind is Window.RUNNING_AVG
        assert {r.i: r.w for r in cut.collect()} == {r.i: r.w for r in plain.collect()}, kind
        assert "SinglePartition" not in plan(cut).split("BroadcastExchange")[0]
    numbers = windows.over_ranges(df, Window.ROW_NUMBER, "w", key, descending, None, 4).orderBy("w").collect()
    assert [r.w for r in numbers] == list(range(1, 301))
    ranks = {r.i: r.w for r in df.withColumn("w", F.rank().over(W.orderBy(order))).collect()}
    assert [ranks[r.i] for r in numbers] == sorted(ranks.values())


def test_large_tables_take_ranges(spark, monkeypatch):
    monkeypatch.setattr(windows, "LARGE_BYTES", 0)
    df = catalog.QUERIES["pipe_derive_chain"](spark, DATA)
    assert sorted(r.rn for r in df.collect()) == list(range(1, df.count() + 1))


def test_relations_of_one_entity_read_its_children_only(spark):
    own = catalog._related(spark, DATA)
    assert "LeftSemi" in plan(own.get("customer", 5, depth=1)) and len(own.get("customer", 5, depth=1).first().orders or []) >= 0
    a = EntityType("A", "Id", (Column("Id"), Column("Ids", array=True)), (Relation("Bs", "many_to_many", "B", "Ids"),))
    b = EntityType("B", "Id", (Column("Id"),))
    many = Engine(spark).register(a, spark.createDataFrame([("1", ["x", "y"]), ("2", ["z"])], a.spark_schema())).register(b, spark.createDataFrame([("x",), ("z",)], b.spark_schema()))
    assert [x.Id for x in many.get("A", "1", depth=1).first().Bs] == ["x"]


def test_batch_search_is_no_cross_join(spark):
    text = plan(catalog.QUERIES["vec_batch_topk"](spark, DATA))
    assert "NestedLoop" not in text and "Cartesian" not in text
