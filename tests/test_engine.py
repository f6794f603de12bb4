"""Operators against small rows with known results."""

import datetime as dt

import pytest

from fathom import authz
from fathom.dsl import Agg, Clause, JoinKind, Logic, Metric, Op, PipelineRequest, Step, StepJoin, aggregate, chunks, group_by, pipeline, query, similar
from fathom.engine import Coordinator, Engine
from fathom.errors import DeniedError, PreconditionError, QueryError, SchemaError, UnavailableError
from fathom.operators import similarity
from fathom.schema import Chunking, Column, EntityType, Registry, Relation, check, drift, migrate

AUTHOR = EntityType("Author", "Id", (Column("Id"), Column("Name"), Column("Bio"), Column("Rating", "int32"), Column("PublishedAt", "datetime")))
ARTICLE = EntityType("Article", "Id", (Column("Id"), Column("Title"), Column("AuthorId")))
PIPE = EntityType("PipeArticle", "Id", (Column("Id", "int32"), Column("AuthorId"), Column("WordCount", "int32"), Column("PublishedAt", "datetime")))


def day(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture
def engine(spark):
    rows = [("1", "Alice", None, 3, day("2026-01-15")), ("2", "Alice", None, 5, day("2026-01-20")), ("3", "Bob", "x", 2, day("2026-02-01"))]
    own = Engine(spark).register(AUTHOR, spark.createDataFrame(rows, AUTHOR.spark_schema()))
    own.register(ARTICLE, spark.createDataFrame([("a", "Hello", "1"), ("b", "World", "3")], ARTICLE.spark_schema()))
    pipes = [(1, "A", 100, day("2026-01-01")), (2, "A", 200, day("2026-02-01")), (3, "A", 300, day("2026-03-01")), (4, "A", 400, day("2026-04-01")), (5, "B", 500, day("2026-01-15")), (6, "B", 600, day("2026-02-15"))]
    return own.register(PIPE, spark.createDataFrame(pipes, PIPE.spark_schema()))


def ids(df, name="Id"):
    return [r[name] for r in df.collect()]


def test_search_operators(engine):
    assert ids(engine.search(query("author").where("name").starts_with("Al").order_by("Id").build())) == ["1", "2"]
    assert ids(engine.search(query("author").where("name").ends_with("ob").build())) == ["3"]
    assert ids(engine.search(query("author").where("rating").gte(3).order_by_desc("rating").build())) == ["2", "1"]
    assert ids(engine.search(query("author").where("name").in_(["Bob", "Carl"]).build())) == ["3"]
    assert ids(engine.search(query("author").must_not("bio").eq("y").build())) == ["3"]
    assert len(ids(engine.search(query("author").where("nope").eq(1).build()))) == 3
    assert ids(engine.search(query("author").where("name").eq(None).build())) == []


def test_search_projection_and_joins(engine):
    out = engine.search(query("author").join("Id", "Article", "AuthorId").fields("Name", "Article.Title", "Article.Id").order_by("author.Id").build())
    assert out.columns == ["Id", "Name", "Title", "Article_Id"] and len(ids(out)) == 2
    assert len(ids(engine.search(query("author").join("Id", "Article", "AuthorId", JoinKind.LEFT).build()))) == 3
    with pytest.raises(QueryError):
        engine.search(query("author").join("Id", "Article", "AuthorId").join("Id", "Article", "AuthorId").build())
    with pytest.raises(QueryError):
        engine.search(query("author").join_from("Article", "AuthorId", "Author", "Id").build())


def facets(df):
    return {(r.name, r.bucket_key): r.doc_count for r in df.collect()}


def test_facets(engine):
    out = engine.aggregate(aggregate("author").terms("name", "n").date_histogram("PublishedAt", "m", "month").date_histogram("PublishedAt", "q", "quarter").range("rating", "r", [("low", None, 3), ("mid", 3, 5), ("high", 5, None)]).build())
    assert facets(out) == {("n", "Alice"): 2, ("n", "Bob"): 1, ("m", "2026-01"): 2, ("m", "2026-02"): 1, ("q", "2026-Q1"): 3, ("r", "low"): 1, ("r", "mid"): 1, ("r", "high"): 1}
    assert facets(engine.aggregate(aggregate("author").terms("name", "n").having("doc_count", Op.GREATER_THAN, 1).build())) == {("n", "Alice"): 2}
    values = {r.name: r.metric_val for r in engine.aggregate(aggregate("author").sum("rating", "s").count("name", "c").count_all("n").build()).collect()}
    assert values == {"s": 10.0, "c": 2.0, "n": 3.0}
    assert engine.total(aggregate("author").where("name", Op.EQUALS, "Alice").terms("name", "n").build()) == 2


def test_week_buckets(spark):
    from pyspark.sql import functions as F

    from fathom.functions.dates import bucket_key

    days = [dt.date(1998, 1, 1) + dt.timedelta(i) for i in range(0, 12000, 13)]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in days], "d date").select(bucket_key(F.col("d"), "week")).collect()]

    def expected(d):
        first = dt.date(d.year, 1, 1)
        monday = first - dt.timedelta(first.weekday())
        start = monday if first.weekday() <= 3 else monday + dt.timedelta(7)
        return f"{d.year}-{(d - start).days // 7 + 1:02d}" if d >= start else f"{d.year}-00"

    assert got == [expected(d) for d in days]


def test_group_by(engine):
    out = engine.group_by(group_by("author").key("Name").sum("Rating", "total").count_all("n").order_by_desc("total").build())
    assert [tuple(r) for r in out.collect()] == [("Alice", 8, 2), ("Bob", 2, 1)]
    out = engine.group_by(group_by("author").join("Id", "Article", "AuthorId").where("Title", Op.EQUALS, "Hello").key("Name").count_all().build())
    assert [r.Name for r in out.collect()] == ["Alice"]
    for bad in (group_by("author").key("nope").count_all(), group_by("author").key("Name").sum("nope"), group_by("author").key("Name").sum_expr("Rating; 1", "x"), group_by("author").key("Name").sum_expr("CASE", "x"), group_by("author").key("Name").count_all("n").order_by("zzz")):
        with pytest.raises(QueryError):
            engine.group_by(bad.build())
    with pytest.raises(QueryError):
        group_by("author").count_all().build()


def test_pipelines(engine):
    top = pipeline("PipeArticle").step("ranked", lambda s: s.row_number("rn", order_by="PublishedAt", descending=True, partition_by="AuthorId")).step("top", lambda s: s.where("rn", Op.LESS_THAN_OR_EQUALS, 2)).sort_on("Id")
    assert ids(engine.pipeline(top.build())) == [3, 4, 5, 6]
    many = pipeline("PipeArticle").where("WordCount", Op.GREATER_THAN_OR_EQUALS, 200).step("per", lambda s: s.group_by("AuthorId").count_all("n").having("n", Op.GREATER_THAN_OR_EQUALS, 3))
    assert ids(engine.pipeline(many.build()), "AuthorId") == ["A"]
    months = pipeline("PipeArticle").step("m", lambda s: s.group_by("PublishedAt", "month").count_all("n")).step("t", lambda s: s.running_sum("total", "n", order_by="PublishedAt_month")).sort_on("PublishedAt_month")
    rows = engine.pipeline(months.build()).collect()
    assert len(rows) == 4 and rows[-1].total == 6
    share = pipeline("PipeArticle").step("a", lambda s: s.group_by("AuthorId").count_all("n")).step("b", lambda s: s.derive("pct", "100.0 * n / SUM(n) OVER ()"))
    assert {r.AuthorId: round(r.pct, 3) for r in engine.pipeline(share.build()).collect()} == {"A": 66.667, "B": 33.333}
    back = pipeline("PipeArticle").step("per", lambda s: s.group_by("AuthorId").count_all("n")).step("j", lambda s: s.reads("base").join("per", "AuthorId", "AuthorId").select(lambda x: x.pick("base", "Id").pick("per", "n")))
    assert sorted((r.Id, r.n) for r in engine.pipeline(back.build()).collect()) == [(1, 4), (2, 4), (3, 4), (4, 4), (5, 2), (6, 2)]


@pytest.mark.parametrize(
    "step",
    [
        Step("base"), Step("1x"), Step("Author"), Step("s", reads="later"), Step("s", clauses=(Clause("nope", Op.EQUALS, 1),)),
        Step("s", metrics=(Metric("n", Agg.COUNT),)), Step("s", keys=(("nope", None),)), Step("s", keys=(("AuthorId", "era"),)), Step("s", keys=(("AuthorId", None),), metrics=(Metric("bad name", Agg.COUNT),)),
        Step("s", keys=(("AuthorId", None),), metrics=(Metric("n", Agg.SUM),)), Step("s", keys=(("AuthorId", None),), metrics=(Metric("n", Agg.TERMS, "Id"),)), Step("s", keys=(("AuthorId", None),), having=(Clause("Id", Op.EQUALS, 1),)),
        Step("s", joins=(StepJoin("Author", (("AuthorId", "Id"),)),)), Step("s", derive=(("x", "nope + 1"),)), Step("s", derive=(("x", "Id -- 1"),)), Step("s", derive=(("Id", "Id + 1"),)),
    ],
)
def test_pipeline_rejects(engine, step):
    with pytest.raises(QueryError):
        engine.pipeline(PipelineRequest("PipeArticle", (step,)))


def test_builders_reject():
    with pytest.raises(QueryError):
        query("a").facet(Agg.TERMS, "x").build()
    with pytest.raises(QueryError):
        query("a").order_by("x").build_aggregate()
    with pytest.raises(QueryError):
        aggregate("a").terms("x", "n").sum("y", "N")
    with pytest.raises(QueryError):
        pipeline("a").step("s", lambda s: s.rank("r", order_by="x").group_by("x"))
    with pytest.raises(QueryError):
        pipeline("a").step("s", lambda s: s.reads("t"))
    with pytest.raises(QueryError):
        similar("a", "b").where("c", Op.CONTAINS, "x")
    with pytest.raises(QueryError):
        chunks("a", "b").where("c", Op.IN, ["x"])
    assert query("a").facet(Agg.TERMS, "x").build_aggregate().specs[0].name == "x_terms"
    assert query("a").with_logic(Logic.OR).build().logic is Logic.OR


def test_keyed_reads(engine):
    rows = engine.get_many("author", ["3", "9", "1", "3"]).collect()
    assert [(r.requested_key, r.found, r.Name) for r in rows] == [("3", True, "Bob"), ("9", False, None), ("1", True, "Alice")]
    assert [r.found for r in engine.get_many("nothing", ["1", "1"]).collect()] == [False, False]
    assert engine.get("author", "2").first().Rating == 5 and engine.get("author", "x").first() is None


def test_relations(spark):
    a = EntityType("A", "Id", (Column("Id"), Column("BId"), Column("CIds", array=True)), (Relation("B", "many_to_one", "B", "BId"), Relation("Cs", "many_to_many", "C", "CIds")))
    b = EntityType("B", "Id", (Column("Id"),), (Relation("As", "one_to_many", "A", "BId"),))
    c = EntityType("C", "Id", (Column("Id"), Column("X", "int32")))
    own = Engine(spark).register(a, spark.createDataFrame([("1", "b", ["y", "gone", "x", "y"]), ("2", None, None)], a.spark_schema()))
    own.register(b, spark.createDataFrame([("b",)], b.spark_schema())).register(c, spark.createDataFrame([("x", 1), ("y", 2)], c.spark_schema()))
    rows = {r.Id: r for r in own.related("A", 2).collect()}
    assert rows["1"].B.Id == "b" and [x.X for x in rows["1"].Cs] == [2, 1] and [x.Id for x in rows["1"].B.As] == ["1"]
    assert rows["2"].B is None and rows["2"].Cs is None
    assert "B" not in own.get("A", "1", depth=0).columns


SECURED = EntityType("Doc", "Id", (Column("Id"), Column("Title"), Column("Pay", "int32"), Column("Owner"), Column("Tenant")), tenant_field="Tenant", owner_field="Owner")


@pytest.fixture
def secured(spark):
    rows = [("1", "a", 1, "u", "t"), ("2", "b", 2, "v", "t"), ("3", "c", 3, "u", "s")]
    rules = {"doc": authz.Rules(bypass_roles=frozenset({"admin"}), hidden={"Pay": frozenset({"hr"}), "Id": frozenset()})}
    return Engine(spark, rules=rules).register(SECURED, spark.createDataFrame(rows, SECURED.spark_schema()))


def test_authorization(secured):
    user, admin = authz.Caller("u", "t"), authz.Caller("x", "t", frozenset({"admin"}))
    out = secured.search(query("doc").build(), user)
    assert ids(out) == ["1"] and "Pay" not in out.columns
    assert sorted(ids(secured.search(query("doc").build(), admin))) == ["1", "2"] and "Pay" in secured.search(query("doc").build(), admin).columns
    for nobody in (None, authz.Caller(None, "t"), authz.Caller("u", None), authz.Caller("u", "a--b")):
        assert ids(secured.search(query("doc").build(), nobody)) == []
    for bad in (query("doc").where("Pay").gt(1).build(), query("doc").order_by("Pay").build()):
        with pytest.raises(QueryError):
            secured.search(bad, user)
    with pytest.raises(QueryError):
        secured.group_by(group_by("doc").key("Title").sum_expr("Pay * 2", "x").build(), user)
    with pytest.raises(QueryError):
        secured.pipeline(pipeline("doc").step("s", lambda s: s.derive("x", "Pay + 1")).build(), user)
    assert "Pay" not in secured.pipeline(pipeline("doc").step("s", lambda s: s.derive("x", "Title")).build(), user).columns
    with pytest.raises(DeniedError):
        secured.search(query("doc").build(), authz.Caller("u", "t", suspended=True))
    assert not secured.get_many("doc", ["2"], user).first().found


def test_writes(secured):
    user = Coordinator(secured, "Doc", authz.Caller("u", "t"))
    key = user.persist({"title": "new", "Tenant": "other", "Owner": "other"})
    assert user.get(key) == {"Id": key, "Title": "new", "Owner": "u", "Tenant": "t"}
    user.update({"Id": key, "Title": "newer"})
    assert user.get(key)["Title"] == "newer" and len(user.search(query("doc").build())) == 2
    with pytest.raises(DeniedError):
        user.update({"Id": "2", "Title": "x"})
    with pytest.raises(DeniedError):
        user.persist({"Title": "x", "Pay": 5})
    assert user.delete(key) and not user.delete(key) and user.get(key) is None and [r["Id"] for r in user.get_many(["1", "2"])] == ["1"]


def test_schema_checks(spark):
    check(SECURED)
    for bad in (
        EntityType("x y", "Id", (Column("Id"),), tenant_field="Id"), EntityType("X", "Id", (Column("Id"),)), EntityType("X", "Id", (Column("Id"), Column("id")), tenant_field="Id"),
        EntityType("X", "Id", (Column("Id"), Column("N", "int32")), tenant_field="N"), EntityType("X", "Id", (Column("Id"), Column("T", search_order=0, large=True)), tenant_field="Id"),
        EntityType("X", "Id", (Column("Id"), Column("T", metadata=True, embedding=True)), tenant_field="Id"), EntityType("X", "Id", (Column("Id"), Column("Text", metadata=True)), tenant_field="Id"),
        EntityType("X", "Id", (Column("Id"), Column("T", enrichment="extracted")), tenant_field="Id"), EntityType("X", "Id", (Column("Id"), Column("T", chunk=Chunking(0))), tenant_field="Id"),
    ):
        with pytest.raises(SchemaError):
            check(bad)
    old = spark.createDataFrame([("1", 5)], "Id string, Gone int")
    new = EntityType("X", "Id", (Column("Id"), Column("Added", "int64")))
    assert drift(old.schema, new) == {"add": ["added"], "remove": ["gone"], "changed": []}
    assert migrate(old, new).collect()[0] == ("1", None)
    with pytest.raises(SchemaError):
        migrate(spark.createDataFrame([(1,)], "Id int"), new)
    many = EntityType("P", "Id", (Column("Id"), Column("UserArticleId")), (Relation("xs", "one_to_many", "Q", "PId"),))
    assert not many.columnar and AUTHOR.columnar and EntityType("UserArticle", "Id", ()).table_name == "user_articles"
    found = Registry().register(AUTHOR, many).discover(lambda t: {"Name"} if t.name == "Author" else None)
    assert [c.name for c in found[0].columns] == ["Id", "Name"] and len(found) == 1


def test_disabled_stores(engine):
    engine.columnar = False
    with pytest.raises(PreconditionError):
        engine.search(query("author").build())
    with pytest.raises(UnavailableError):
        engine.similar(similar("author", "Name").text("x").build())


def test_similar_and_passages(spark):
    from fathom.operators.ingest import passage_frame, point_frame

    t = EntityType("Note", "Id", (Column("Id"), Column("Title", embedding=True), Column("Body", chunk=Chunking(8, 2)), Column("Kind", metadata=True), Column("At", "datetime", metadata=True)))
    rows = spark.createDataFrame([("1", "red apple", "apples are red " * 6, "f", day("2026-01-01")), ("2", "blue sky", "the sky is blue", "s", day("2026-01-01")), ("3", None, None, "s", None)], t.spark_schema())
    embed = similarity.HashingEmbedder(32)
    passages = passage_frame(rows, t, "Body", embed)
    points = point_frame(rows, t, embed, {"Body": passages})
    own = Engine(spark, vectors=similarity.VectorStore({"note": points}, {"note": passages}, embed)).register(t, rows)
    now = day("2026-01-01")
    best = own.similar(similar("note", "Title").text("blue sky").top_k(2).build(), now=now).collect()
    assert best[0].Id == "2" and len(best) == 2
    assert [r.Id for r in own.similar(similar("note", "Title").text("blue sky").where("Kind", Op.EQUALS, "f").build(), now=now).collect()] == ["1"]
    hits = own.chunks(chunks("note", "Body").text("the sky is blue").top_k(1).build()).collect()
    assert hits[0].parent_id == "2" and hits[0].text == "the sky is blue"
    assert {r.parent_id for r in own.chunks(chunks("note", "Body").text("red").where("Id", Op.EQUALS, "1").build()).collect()} == {"1"}
    with pytest.raises(QueryError):
        own.similar(similar("note", "Kind").text("x").build())


def test_unknown_tenants_are_denied(secured):
    from fathom.tenants import Tenants

    secured.tenants = Tenants()
    with pytest.raises(DeniedError):
        secured.search(query("doc").build(), authz.Caller("u", "t"))
    secured.tenants.add("t")
    assert secured.search(query("doc").build(), authz.Caller("u", "t")).count() >= 0
    secured.tenants.suspend("t")
    with pytest.raises(DeniedError):
        secured.get("doc", "1", authz.Caller("u", "t"))


def test_writes_are_logged_and_published(spark, tmp_path):
    from fathom.streaming.outbox import Log

    sent, down = [], [True]

    def produce(events):
        if down[0]:
            raise ConnectionError
        sent.extend((e.op, e.key) for e in events.collect())

    base = spark.createDataFrame([("1", "Hello", "a")], ARTICLE.spark_schema())
    own = Engine(spark, log=Log(spark, str(tmp_path / "log")), produce=produce).register(ARTICLE, base)
    key = own.persist("Article", {"title": "New", "AuthorId": "b"})
    assert key[14] == "7" and own.get("Article", key).first().Title == "New"
    own.persist("Article", {"Id": "1", "Title": "Changed"}, update=True)
    assert own.get("Article", "1").first().AuthorId is None and tuple(own.log.counts().first()) == (2, 0, 0)
    down[0] = False
    assert own.delete("Article", "1") and not own.delete("Article", "1")
    assert sent == [("created", key), ("updated", "1"), ("deleted", "1")] and tuple(own.log.counts().first()) == (0, 0, 3)
    assert own.log.events().where("op = 'deleted'").first().payload == '{"Id":"1","Title":"Changed"}'
    again = Engine(spark, log=Log(spark, str(tmp_path / "log"))).register(ARTICLE, base)
    assert [r.Id for r in again.search(query("Article").build()).collect()] == [key]
    assert again.get("nothing", "1").first() is None


def test_many_writes_keep_one_plan(spark):
    own = Engine(spark).register(ARTICLE, spark.createDataFrame([("1", "Hello", "a")], ARTICLE.spark_schema()))
    size = lambda: len(own.search(query("Article").build())._jdf.queryExecution().optimizedPlan().toString())
    own.persist("Article", {"Title": "0"})
    first = size()
    for k in range(6):
        own.persist("Article", {"Title": str(k)})
    assert size() < 1.2 * first and own.search(query("Article").build()).count() == 8


def test_keys_with_signs_are_found(spark):
    t = EntityType("K", "Id", (Column("Id"),))
    odd = ["it's", "a\\b", 'q"uote', "x'; --", "Ünï", "%_", ""]
    own = Engine(spark).register(t, spark.createDataFrame([(k,) for k in odd], t.spark_schema()))
    assert [r.Id for r in own.get_many("K", odd).collect()] == odd
    assert [r.found for r in own.get_many("K", ["IT'S", "a\\\\b", "\\"]).collect()] == [True, False, False]
    n = EntityType("N", "Id", (Column("Id", "int64"),))
    many = Engine(spark).register(n, spark.createDataFrame([(1,), (-7,), (10**17,)], n.spark_schema()))
    assert [r.Id for r in many.get_many("N", ["x", "-7", "99999999999999999999", str(10**17), "1"]).collect()] == [None, -7, None, 10**17, 1]
    assert many.get_many("N", ["x"]).first().found is False
