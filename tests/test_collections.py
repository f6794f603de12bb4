import pytest
from pyspark.sql import functions as F

from fathom.errors import SchemaError
from fathom.operators import collections as C, similarity, writes
from fathom.schema import Column, EntityType
from fathom.sources import seed
from fathom.streaming import projection as P


def test_collections(spark):
    t = EntityType("UserNote", "Id", (Column("Id"), Column("Size", "int32"), Column("Tags", "float", array=True), Column("At", "datetime")))
    assert C.collection_name(t, "acme", True) == "user_note_chunks_acme" and C.payload_indexes(t) == {"id": "keyword", "size": "integer", "tags": "keyword", "at": "datetime"}
    with pytest.raises(SchemaError):
        C.collection_name(t, "a--b")
    points = spark.createDataFrame([("1", [1.0, 0.0], "x"), ("2", None, None)], "Id string, v array<double>, kind string")
    assert "w" in C.ensure(points, ["v", "w"], 2).columns
    with pytest.raises(SchemaError):
        C.ensure(points, ["v"], 3)
    assert [r.Id for r in C.by_ids(points, spark.createDataFrame([("1",), ("9",), ("1",)], "Id string"), "Id", "v").collect()] == ["1"]
    assert [r.Id for r in C.delete_where(points, F.col("kind") == "x").collect()] == ["2"]
    new = spark.createDataFrame([("2", [0.0, 1.0]), ("7", [1.0, 1.0])], "Id string, v array<double>")
    assert {r.Id: r.v for r in writes.update_vectors(points, new, "Id").collect()} == {"1": [1.0, 0.0], "2": [0.0, 1.0]}


def test_batch_search(spark):
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id int, v array<double>")
    queries = spark.createDataFrame([(1, [5.0, 1.0]), (2, [0.0, 1.0])], "query_id int, query_vector array<double>")
    got = similarity.search_batch(queries, points, "v", 2, "id").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 5), (1, 4), (2, 0), (2, 1)]


def test_writes_on_frames(spark, tmp_path):
    stored = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "Id string, Name string, N int")
    change = spark.createDataFrame([("2", "c"), ("3", "d"), (None, "e")], "Id string, name string")
    assert sorted(tuple(r) for r in writes.upsert(stored, change, "Id").collect()) == [("1", "a", 1), ("2", "c", None), ("3", "d", None)]
    assert sorted(tuple(r) for r in writes.update_columns(stored, change, "Id").collect()) == [("1", "a", 1), ("2", "c", 2)]
    t = EntityType("X", "Id", (Column("Id"), Column("Name", search_order=0), Column("N", "int32")), tenant_field="Name")
    writes.create_table(stored, t, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("Name = 'a'").count() == 1


def test_seed_and_restart(spark):
    rows = seed.articles(spark, 500, 10)
    assert rows.where("OwnerId = 'known-user'").count() == 5 and rows.groupBy("Category").count().count() == 5 and seed.authors(spark, 10).count() == 10
    calls = []

    class Query:
        def awaitTermination(self):
            calls.append(1)
            if len(calls) < 3:
                raise RuntimeError

    assert P.keep_running(Query, wait=0) == 2




def test_versions_pages_and_alias(spark, tmp_path):
    own = C.Collection(spark, str(tmp_path / "c"))
    with pytest.raises(SchemaError):
        own.read()
    points = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(250)], "id int, v array<double>")
    assert own.replace(points) == 0 and own.read().count() == 250
    assert own.migrate(["v", "w"], 2) and own.current() == 1 and own.read().columns == ["id", "v", "w"] and not own.migrate(["w"], 2)
    with pytest.raises(SchemaError):
        own.migrate(["v"], 3)
    own.clear()
    assert own.read().count() == 250
    seen, after = [], None
    while rows := C.page(own.read(), "id", after).collect():
        assert len(rows) <= 100
        seen, after = seen + [r.id for r in rows], rows[-1].id
    assert seen == list(range(250))


def test_tenants():
    from fathom.errors import Breaker, DeniedError, PreconditionError, QueryError, UnavailableError, status
    from fathom.tenants import Tenants

    t = EntityType("X", "Id", (Column("Id"),))
    calls = []
    own = Tenants(set_up=lambda tenant, kind: calls.append((tenant, kind.name)))
    own.add("acme")
    assert own.active("acme") and not own.active("other") and not own.active(None) and own.database("acme") == "entities_tenant_acme"
    assert own.ensure("acme", t) and not own.ensure("acme", t) and calls == [("acme", "X")]
    own.suspend("acme")
    for act in (lambda: own.ensure("acme", t), lambda: own.delete("other"), lambda: own.add("a--b"), lambda: own.database("A")):
        with pytest.raises(SchemaError):
            act()
    assert [status(e) for e in (QueryError(), DeniedError(), PreconditionError(), UnavailableError(), KeyError())] == ["invalid_argument", "permission_denied", "failed_precondition", "unavailable", "internal"]
    now, down = [0.0], [True]

    def call(x):
        if down[0]:
            raise OSError
        return x

    breaker = Breaker(call, 2, 10, lambda: now[0])
    for _ in range(3):
        with pytest.raises(UnavailableError):
            breaker(1)
    down[0] = False
    with pytest.raises(UnavailableError):
        breaker(1)
    now[0] = 11
    assert breaker(1) == 1 and breaker.failed == 0
