"""Named queries over the test tables with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import authz
from .dsl import Agg, JoinKind, Op, aggregate, chunks, group_by, pipeline, query, similar
from .engine import Engine
from .functions import vectors as V
from .operators import collections, ingest, retrieval, similarity
from .operators.writes import delete, latest, update_columns, update_vectors, upsert
from .schema import Chunking, Column, EntityType, Registry, Relation
from .sources import tables
from .sources.tables import KEYS, REPEATED, parquet
from .streaming import letters, outbox, projection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, *names: str, rules=None, **types: dict) -> Engine:
    own = Engine(spark, Registry(), rules=rules)
    for n in names:
        df = parquet(spark, sf_dir, n)
        own.register(EntityType.of_frame(n, KEYS[n], df, unique=n not in REPEATED, **types.get(n, {})), df)
    return own


def add(name: str, sql: str | None = None):
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return wrap


def searching(name: str, tables: str, build: Callable, sql: str) -> None:
    first = tables.split()[0]
    add(name, sql)(lambda spark, d: engine(spark, d, *tables.split()).search(build(query(first)).build()))


def grouping(name: str, tables: str, build: Callable, sql: str) -> None:
    first = tables.split()[0]
    add(name, sql)(lambda spark, d: engine(spark, d, *tables.split()).group_by(build(group_by(first)).build()))


def faceting(name: str, tables: str, build: Callable, sql: str) -> None:
    first = tables.split()[0]
    add(name, sql)(lambda spark, d: engine(spark, d, *tables.split()).aggregate(build(aggregate(first)).build()))


def piping(name: str, tables: str, build: Callable, sql: str) -> None:
    first = tables.split()[0]
    add(name, sql)(lambda spark, d: engine(spark, d, *tables.split()).pipeline(build(pipeline(first)).build()))


# --- search: predicates, projection, sorting, paging, joins

ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
ordered = lambda q: q.order_by("o_orderkey").limit(100)
searching("search_eq", "orders", lambda q: ordered(q.where("o_orderstatus").eq("F")), f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
searching("search_neq", "orders", lambda q: ordered(q.where("o_orderstatus").neq("F")), f"SELECT {ORDER} FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 100")
searching("search_gt_lt", "orders", lambda q: ordered(q.where("o_totalprice").gt(1000).where("o_totalprice").lt(200000.5)), f"SELECT {ORDER} FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 200000.5 ORDER BY o_orderkey LIMIT 100")
searching("search_gte_lte", "orders", lambda q: ordered(q.where("o_orderdate").gte("1996-01-01").where("o_orderdate").lte("1996-12-31")), f"SELECT {ORDER} FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31' ORDER BY o_orderkey LIMIT 100")
searching("search_in", "orders", lambda q: ordered(q.where("o_orderstatus").in_(["F", "P"])), f"SELECT {ORDER} FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderkey LIMIT 100")
searching("search_in_empty", "orders", lambda q: ordered(q.where("o_orderstatus").in_([])), f"SELECT {ORDER} FROM orders ORDER BY o_orderkey LIMIT 100")
searching("search_eq_null", "orders", lambda q: ordered(q.where("o_orderstatus").eq(None)), f"SELECT {ORDER} FROM orders WHERE o_orderstatus = NULL ORDER BY o_orderkey LIMIT 100")
PART = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"
parts = lambda q: q.order_by("p_partkey").limit(200)
searching("search_contains", "part", lambda q: parts(q.where("p_name").contains("a")), f"SELECT {PART} FROM part WHERE p_name LIKE '%a%' ORDER BY p_partkey LIMIT 200")
searching("search_starts", "part", lambda q: parts(q.where("p_brand").starts_with("Brand#1")), f"SELECT {PART} FROM part WHERE p_brand LIKE 'Brand#1%' ORDER BY p_partkey LIMIT 200")
searching("search_ends", "part", lambda q: parts(q.where("p_brand").ends_with("3")), f"SELECT {PART} FROM part WHERE p_brand LIKE '%3' ORDER BY p_partkey LIMIT 200")
searching("search_like_wildcard", "part", lambda q: parts(q.where("p_brand").contains("d#_3")), f"SELECT {PART} FROM part WHERE p_brand LIKE '%d#_3%' ORDER BY p_partkey LIMIT 200")
searching("search_must_not", "orders", lambda q: ordered(q.must_not("o_orderstatus").eq("O").must_not("o_orderpriority").starts_with("1")), f"SELECT {ORDER} FROM orders WHERE NOT (o_orderstatus = 'O') AND NOT (o_orderpriority LIKE '1%') ORDER BY o_orderkey LIMIT 100")


def _or(q):
    from .dsl import Logic

    return ordered(q.where("o_orderstatus").eq("P").where("o_totalprice").gt(300000).with_logic(Logic.OR))


searching("search_or_logic", "orders", _or, f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 300000 ORDER BY o_orderkey LIMIT 100")
searching("search_unknown_field_ignored", "orders", lambda q: ordered(q.where("nothing").eq("x").where("O_ORDERSTATUS").eq("F").order_by("nowhere")), f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
searching("search_fields", "customer", lambda q: q.fields("C_NAME", "c_acctbal", "nope").order_by("c_custkey").limit(300), "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 300")
searching("search_sort_multi", "customer", lambda q: q.order_by("c_mktsegment").order_by_desc("c_acctbal").order_by("c_custkey").limit(150), "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_mktsegment NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey LIMIT 150")
searching("search_page2", "customer", lambda q: q.order_by("c_custkey").limit(25).offset(2), "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
searching("search_default_size", "customer", lambda q: q.order_by("c_custkey").limit(0), "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 50")
searching("search_join_inner", "customer nation", lambda q: q.join("c_nationkey", "nation", "n_nationkey").where("n_name").starts_with("N").fields("c_name", "nation.n_name").order_by("c_custkey").limit(200), "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE 'N%' ORDER BY c_custkey LIMIT 200")
searching("search_join_left", "customer orders", lambda q: q.join("c_custkey", "orders", "o_custkey", JoinKind.LEFT).fields("orders.o_orderkey").order_by("c_custkey").order_by("o_orderkey").limit(500), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY c_custkey, o_orderkey NULLS FIRST LIMIT 500")
searching("search_join_right", "orders customer", lambda q: q.join("o_custkey", "customer", "c_custkey", JoinKind.RIGHT).fields("customer.c_custkey").order_by("c_custkey").order_by("o_orderkey").limit(500), "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey ORDER BY c_custkey, o_orderkey NULLS FIRST LIMIT 500")
searching("search_join_full", "nation supplier", lambda q: q.join("n_nationkey", "supplier", "s_nationkey", JoinKind.FULL).fields("supplier.s_suppkey").order_by("n_nationkey").order_by("s_suppkey").limit(3000), "SELECT n_nationkey, s_suppkey FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey ORDER BY n_nationkey NULLS FIRST, s_suppkey NULLS FIRST LIMIT 3000")
searching("search_multihop", "customer nation region", lambda q: q.join("c_nationkey", "nation", "n_nationkey").join_from("nation", "n_regionkey", "region", "r_regionkey").where("r_name").eq("EUROPE").fields("nation.n_name", "region.r_name").order_by("c_custkey").limit(300), "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' ORDER BY c_custkey LIMIT 300")
searching("search_join_primary_only", "orders customer", lambda q: q.join("o_custkey", "customer", "c_custkey").where("c_mktsegment").eq("BUILDING").order_by("o_orderkey").limit(100), f"SELECT {ORDER} FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_orderkey LIMIT 100")

# --- facets

NULLS = "CAST(NULL AS DOUBLE) AS metric_val"


def bucketed(name: str, kind: str, key: str, table: str, where: str = "", more: str = "", limit: str = "") -> str:
    return f"SELECT '{name}' AS name, '{kind}' AS type, bucket_key, doc_count, {NULLS} FROM (SELECT {key} AS bucket_key, count(*) AS doc_count FROM {table} {where} GROUP BY 1 {more} {limit}) WHERE bucket_key IS NOT NULL"


TOP = "ORDER BY doc_count DESC, bucket_key NULLS FIRST LIMIT"
faceting("agg_terms", "orders", lambda a: a.terms("o_orderpriority", "priorities", 5), bucketed("priorities", "terms", "o_orderpriority", "orders", limit=f"{TOP} 5"))
faceting("agg_terms_default_size", "customer", lambda a: a.terms("c_nationkey", "nations", 0), bucketed("nations", "terms", "CAST(c_nationkey AS VARCHAR)", "customer", limit=f"{TOP} 10"))
faceting("agg_terms_multi_key", "orders", lambda a: a.terms_of(["o_orderstatus", "o_orderpriority"], "both", 8), bucketed("both", "terms", "o_orderstatus || '|' || o_orderpriority", "orders", limit=f"{TOP} 8"))
faceting("agg_terms_having", "orders", lambda a: a.terms("o_orderstatus", "statuses").having("doc_count", Op.GREATER_THAN, 4000), bucketed("statuses", "terms", "o_orderstatus", "orders", more="HAVING count(*) > 4000", limit=f"{TOP} 10"))


@add("agg_terms_null_drop", bucketed("q", "terms", "CAST(quality AS VARCHAR)", "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", limit=f"{TOP} 3"))
def agg_terms_null_drop(spark, d):
    docs = parquet(spark, d, "documents").join(parquet(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality")
    own = Engine(spark).register(EntityType.of_frame("judged", "doc_id", docs), docs)
    return own.aggregate(aggregate("judged").terms("quality", "q", 3).build())


WEEK = "CAST(year({c}) AS VARCHAR) || '-' || lpad(CAST(CAST(floor(date_diff('day', date_trunc('week', make_date(year({c}), 1, 4)), CAST({c} AS DATE)) / 7) + 1 AS INTEGER) AS VARCHAR), 2, '0')"
HIST = {
    "minute": "strftime({c}, '%Y-%m-%d %H:%M')", "hour": "strftime({c}, '%Y-%m-%d %H')", "day": "strftime({c}, '%Y-%m-%d')", "week": WEEK,
    "month": "strftime({c}, '%Y-%m')", "quarter": "CAST(year({c}) AS VARCHAR) || '-Q' || CAST(quarter({c}) AS VARCHAR)", "year": "strftime({c}, '%Y')",
}
for _unit, _sql in HIST.items():
    _table, _column = ("events", "ts") if _unit in ("minute", "hour", "day") else ("orders", "o_orderdate")
    faceting(f"agg_hist_{_unit}", _table, lambda a, u=_unit, c=_column: a.date_histogram(c, "h", u), bucketed("h", "date_histogram", _sql.format(c=_column), _table))
faceting("agg_hist_tz", "events", lambda a: a.date_histogram("ts", "h", "day", "America/New_York"), bucketed("h", "date_histogram", "strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d')", "events"))
faceting("agg_range", "part", lambda a: a.range("p_size", "r", [("low", None, 10), ("mid", 10, 30), ("high", 30, None)]), bucketed("r", "range", "CASE WHEN p_size < 10 THEN 'low' WHEN p_size >= 10 AND p_size < 30 THEN 'mid' WHEN p_size >= 30 THEN 'high' END", "part"))
faceting("agg_range_overlap", "part", lambda a: a.range("p_retailprice", "r", [("a", 900, 1200), ("b", 1000, 1500), ("none", None, None)]), bucketed("r", "range", "CASE WHEN p_retailprice >= 900 AND p_retailprice < 1200 THEN 'a' WHEN p_retailprice >= 1000 AND p_retailprice < 1500 THEN 'b' END", "part"))
faceting("agg_range_empty", "part", lambda a: a.range("p_size", "r", []), bucketed("r", "range", "CAST(NULL AS VARCHAR)", "part"))


def scalar(name: str, kind: str, expr: str, table: str, where: str = "") -> str:
    return f"SELECT '{name}' AS name, '{kind}' AS type, CAST(NULL AS VARCHAR) AS bucket_key, CAST(NULL AS BIGINT) AS doc_count, CAST({expr} AS DOUBLE) AS metric_val FROM {table} {where}"


faceting("agg_avg", "lineitem", lambda a: a.avg("l_quantity", "m"), scalar("m", "avg", "avg(l_quantity)", "lineitem"))
faceting("agg_sum", "lineitem", lambda a: a.sum("l_quantity", "m"), scalar("m", "sum", "sum(l_quantity)", "lineitem"))
faceting("agg_min", "lineitem", lambda a: a.min("l_extendedprice", "m"), scalar("m", "min", "min(l_extendedprice)", "lineitem"))
faceting("agg_max", "lineitem", lambda a: a.max("l_extendedprice", "m"), scalar("m", "max", "max(l_extendedprice)", "lineitem"))
faceting("agg_count_distinct", "lineitem", lambda a: a.count("l_suppkey", "m"), scalar("m", "count", "count(DISTINCT l_suppkey)", "lineitem"))
faceting("agg_count_all", "lineitem", lambda a: a.count_all("m"), scalar("m", "count", "count(*)", "lineitem"))
faceting("agg_expr", "part", lambda a: a.metric_expr(Agg.SUM, "COALESCE(p_size, 0) * 2 + ABS(p_partkey % 7)", "m"), scalar("m", "sum", "sum(coalesce(p_size, 0) * 2 + abs(p_partkey % 7))", "part"))
faceting("agg_having_scalar", "part", lambda a: a.sum("p_size", "big").sum("p_partkey", "small").having("metric_val", Op.GREATER_THAN, 100000), "SELECT 'big' AS name, 'sum' AS type, CAST(NULL AS VARCHAR) AS bucket_key, CAST(NULL AS BIGINT) AS doc_count, CASE WHEN sum(p_size) > 100000 THEN CAST(sum(p_size) AS DOUBLE) END AS metric_val FROM part UNION ALL SELECT 'small', 'sum', NULL, NULL, CASE WHEN sum(p_partkey) > 100000 THEN CAST(sum(p_partkey) AS DOUBLE) END FROM part")
faceting("agg_empty_input", "part", lambda a: a.where("p_brand", Op.EQUALS, "none").sum("p_size", "m").count_all("n"), " UNION ALL ".join([scalar("m", "sum", "sum(p_size)", "part", "WHERE p_brand = 'none'"), scalar("n", "count", "count(*)", "part", "WHERE p_brand = 'none'")]))
faceting(
    "agg_multi", "orders",
    lambda a: a.where("o_orderstatus", Op.NOT_EQUALS, "P").terms("o_orderpriority", "t", 5).range("o_totalprice", "r", [("low", None, 100000), ("high", 100000, None)]).date_histogram("o_orderdate", "h", "month").count("o_custkey", "c").min("o_totalprice", "lo").max("o_totalprice", "hi"),
    " UNION ALL ".join([
        bucketed("t", "terms", "o_orderpriority", "orders", "WHERE o_orderstatus <> 'P'", limit=f"{TOP} 5"),
        bucketed("r", "range", "CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice >= 100000 THEN 'high' END", "orders", "WHERE o_orderstatus <> 'P'"),
        bucketed("h", "date_histogram", "strftime(o_orderdate, '%Y-%m')", "orders", "WHERE o_orderstatus <> 'P'"),
        *[scalar(n, k, e, "orders", "WHERE o_orderstatus <> 'P'") for n, k, e in (("c", "count", "count(DISTINCT o_custkey)"), ("lo", "min", "min(o_totalprice)"), ("hi", "max", "max(o_totalprice)"))],
    ]),
)
faceting("agg_join", "orders customer", lambda a: a.join("o_custkey", "customer", "c_custkey").where("c_mktsegment", Op.EQUALS, "BUILDING").terms("o_orderstatus", "t"), bucketed("t", "terms", "o_orderstatus", "orders JOIN customer ON o_custkey = c_custkey", "WHERE c_mktsegment = 'BUILDING'", limit=f"{TOP} 10"))

# --- group-by

grouping(
    "groupby_q1", "lineitem",
    lambda g: g.where("l_shipdate", Op.LESS_THAN_OR_EQUALS, "1998-09-02").keys("l_returnflag", "l_linestatus").sum("l_quantity", "sum_qty").sum("l_extendedprice", "sum_base_price").sum_expr("l_extendedprice * (1 - l_discount)", "sum_disc_price").avg("l_quantity", "avg_qty").count_all("count_order").order_by("l_returnflag").order_by("l_linestatus"),
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price, sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, avg(l_quantity) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2",
)
grouping("groupby_join_where", "orders customer", lambda g: g.join("o_custkey", "customer", "c_custkey").where("c_mktsegment", Op.IN, ["BUILDING", "MACHINERY"]).key("o_orderstatus").count_all("n").min("o_totalprice", "least").max("c_acctbal", "most"), "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS least, max(c_acctbal) AS most FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")


def _having_or(g):
    from .dsl import Logic

    return g.key("c_nationkey").count_all("n").max("c_acctbal", "most").having("n", Op.GREATER_THAN, 65).having("most", Op.LESS_THAN, 9800).with_having_logic(Logic.OR)


grouping("groupby_having_or", "customer", _having_or, "SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS most FROM customer GROUP BY 1 HAVING count(*) > 65 OR max(c_acctbal) < 9800")
grouping("groupby_order_alias", "orders", lambda g: g.key("o_custkey").count_all("n").order_by_desc("n").order_by("o_custkey").limit(20), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20")
grouping("groupby_count_vs_distinct", "orders", lambda g: g.key("o_orderstatus").count("o_custkey", "counted"), "SELECT o_orderstatus, count(o_custkey) AS counted FROM orders GROUP BY 1")
grouping("groupby_not", "orders", lambda g: g.not_("o_orderstatus", Op.EQUALS, "O").keys("o_orderstatus", "o_orderpriority").min("o_orderdate", "first").max("o_orderdate", "last"), "SELECT o_orderstatus, o_orderpriority, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE NOT (o_orderstatus = 'O') GROUP BY 1, 2")

# --- pipelines

piping("pipe_topn", "orders", lambda p: p.step("ranked", lambda s: s.row_number("rn", order_by="o_orderkey", descending=True, partition_by="o_custkey")).step("top", lambda s: s.where("rn", Op.LESS_THAN_OR_EQUALS, 2)).all_rows(), f"SELECT {ORDER}, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn <= 2")
piping("pipe_filter_agg_having", "orders", lambda p: p.where("o_totalprice", Op.GREATER_THAN_OR_EQUALS, 1000).step("per", lambda s: s.group_by("o_custkey").count_all("n").max("o_totalprice", "most").having("n", Op.GREATER_THAN_OR_EQUALS, 12)).all_rows(), "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_totalprice >= 1000 GROUP BY 1 HAVING count(*) >= 12")
piping("pipe_running_sum", "orders", lambda p: p.step("months", lambda s: s.group_by("o_orderdate", "month").count_all("n")).step("total", lambda s: s.running_sum("so_far", "n", order_by="o_orderdate_month")), "SELECT o_orderdate_month, n, CAST(sum(n) OVER (ORDER BY o_orderdate_month) AS BIGINT) AS so_far FROM (SELECT date_trunc('month', o_orderdate) AS o_orderdate_month, count(*) AS n FROM orders GROUP BY 1)")
piping("pipe_running_sum_ties", "customer", lambda p: p.step("t", lambda s: s.running_sum("so_far", "c_custkey", order_by="c_mktsegment", partition_by="c_nationkey").select(lambda x: x.pick("base", "c_custkey"))).all_rows(), "SELECT c_custkey, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS so_far FROM customer")
piping("pipe_running_avg", "orders", lambda p: p.step("t", lambda s: s.running_avg("mean_key", "o_custkey", order_by="o_orderkey", partition_by="o_orderpriority").select(lambda x: x.pick("base", "o_orderkey"))).sort_on("o_orderkey").limit(1000), "SELECT o_orderkey, avg(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS mean_key FROM orders ORDER BY o_orderkey LIMIT 1000")
piping("pipe_rank_dense", "part", lambda p: p.step("t", lambda s: s.rank("r", order_by="p_size", partition_by="p_brand").dense_rank("dr", order_by="p_size", partition_by="p_brand").select(lambda x: x.pick("base", "p_partkey"))).all_rows(), "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part")
piping("pipe_lag_lead", "orders", lambda p: p.step("t", lambda s: s.lag("before", "o_totalprice", order_by="o_orderkey", partition_by="o_custkey").lead("after", "o_orderkey", order_by="o_orderkey", offset=2, partition_by="o_custkey").select(lambda x: x.pick("base", "o_orderkey"))).all_rows(), "SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS before, lead(o_orderkey, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
for _unit in ("month", "quarter", "week"):
    piping(f"pipe_trunc_{_unit}", "orders", lambda p, u=_unit: p.step("t", lambda s: s.group_by("o_orderdate", u).group_by("o_orderstatus").count_all("n")), f"SELECT date_trunc('{_unit}', o_orderdate) AS o_orderdate_{_unit}, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
piping("pipe_ratio", "orders", lambda p: p.step("per", lambda s: s.group_by("o_orderpriority").count_all("n")).step("share", lambda s: s.derive("part", "100.0 * n / SUM(n) OVER ()")), "SELECT o_orderpriority, n, CAST(100.0 * n / sum(n) OVER () AS DOUBLE) AS part FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
piping("pipe_derive_chain", "part", lambda p: p.step("t", lambda s: s.row_number("rn", order_by="p_partkey").derive("twice", "p_size * 2").derive("more", "twice + rn").derive("none", "p_size / NULLIF(p_size - p_size, 0)")).all_rows(), f"SELECT {PART}, rn, p_size * 2 AS twice, p_size * 2 + rn AS more, CAST(NULL AS DOUBLE) AS none FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS rn FROM part)")
piping("pipe_reads_join_step", "orders", lambda p: p.step("per", lambda s: s.group_by("o_custkey").count_all("n")).step("back", lambda s: s.reads("base").join("per", "o_custkey", "o_custkey").select(lambda x: x.pick("base", "o_orderkey").pick("per", "n", "orders_of_customer"))).all_rows(), "SELECT o_orderkey, n AS orders_of_customer FROM orders JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = k")
piping("pipe_join_type_composite", "lineitem orders", lambda p: p.where("l_quantity", Op.GREATER_THAN, 45).step("j", lambda s: s.join_all("orders", [("l_orderkey", "o_orderkey"), ("l_linenumber", "o_custkey")]).select(lambda x: x.pick("base", "l_orderkey").pick("base", "l_linenumber").pick("orders", "o_custkey"))).all_rows(), "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = o_custkey WHERE l_quantity > 45")
piping("pipe_select_all_pick", "nation region", lambda p: p.step("j", lambda s: s.join("region", "n_regionkey", "r_regionkey").select(lambda x: x.all_from("base").pick("region", "r_name", "region_name"))), "SELECT n_nationkey, n_name, n_regionkey, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey")
piping("pipe_left_join", "customer orders", lambda p: p.step("j", lambda s: s.join("orders", "c_custkey", "o_custkey", JoinKind.LEFT).select(lambda x: x.pick("base", "c_custkey").pick("orders", "o_orderkey"))).step("n", lambda s: s.group_by("c_custkey").count("o_orderkey", "n")).all_rows(), "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")

# --- keyed reads and relations


@add("get_many_ordered", "SELECT CAST(p AS INTEGER) AS position, k AS requested_key, o_orderkey IS NOT NULL AS found, " + ORDER + " FROM (VALUES (0, '7'), (1, '-1'), (2, '3'), (3, '100')) t(p, k) LEFT JOIN orders ON o_orderkey = CAST(k AS BIGINT)")
def get_many_ordered(spark, d):
    return engine(spark, d, "orders").get_many("orders", ["7", "-1", "3", "7", "100"])


@add("get_by_key", f"SELECT {ORDER} FROM orders WHERE o_orderkey = 7")
def get_by_key(spark, d):
    return engine(spark, d, "orders").get("orders", 7)


@add("get_by_foreign_key", f"SELECT {ORDER} FROM orders WHERE o_custkey = 5")
def get_by_foreign_key(spark, d):
    return retrieval.by_foreign_key(engine(spark, d, "orders").context(), "orders", "o_custkey", 5)


@add("get_many_repeated", "SELECT CAST(p AS INTEGER) AS position, k AS requested_key, n > 0 AS found FROM (VALUES (0, '1'), (1, '-1'), (2, '3')) t(p, k) LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = CAST(k AS BIGINT)")
def get_many_repeated(spark, d):
    return engine(spark, d, "lineitem").get_many("lineitem", ["1", "-1", "3"]).select("position", "requested_key", F.when(F.col("requested_key") != "-1", F.col("found")).alias("found"))


@add("get_json", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation WHERE n_nationkey = 7")
def get_json(spark, d):
    found = retrieval.get_json(engine(spark, d, "nation").context(), "nation", 7)
    return found.select(F.col("key").cast("string").alias("key"), F.get_json_object("json", "$.n_name").alias("name"))


@add("raw_sql", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1")
def raw_sql(spark, d):
    parquet(spark, d, "nation").createOrReplaceTempView("raw_sql_nation")
    return tables.sql(spark, "SELECT n_regionkey, count(*) AS n FROM raw_sql_nation WHERE n_nationkey > :least GROUP BY 1", least=3)


@add("write_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -c_custkey, 'new', NULL FROM customer WHERE c_custkey % 5 = 0 AND c_custkey > 0")
def write_upsert(spark, d):
    stored = parquet(spark, d, "customer")
    changed = stored.where("c_custkey % 5 = 0")
    new = changed.select("c_custkey").unionAll(changed.where("c_custkey > 0").select(-F.col("c_custkey"))).withColumn("C_NAME", F.lit("new"))
    return upsert(stored, new, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@add("write_update_columns", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def write_update_columns(spark, d):
    stored = parquet(spark, d, "customer")
    new = stored.where("c_custkey % 5 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")).unionAll(spark.createDataFrame([(-1, 0.0)], "k long, v double"))
    return update_columns(stored, new, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


def _related(spark, d):
    own = Engine(spark)
    customer, orders, nation = (parquet(spark, d, n) for n in ("customer", "orders", "nation"))
    own.register(EntityType.of_frame("customer", "c_custkey", customer, relations=(Relation("nation", "many_to_one", "nation", "c_nationkey"), Relation("orders", "one_to_many", "orders", "o_custkey"))), customer)
    own.register(EntityType.of_frame("orders", "o_orderkey", orders), orders)
    return own.register(EntityType.of_frame("nation", "n_nationkey", nation), nation)


@add("relations_many_to_one", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def relations_many_to_one(spark, d):
    return _related(spark, d).related("customer").select("c_custkey", F.col("nation.n_name").alias("n_name"))


@add("relations_one_to_many", "SELECT c_custkey, count(o_orderkey) AS n, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def relations_one_to_many(spark, d):
    out = _related(spark, d).related("customer").withColumn("rows", F.coalesce("orders", F.array()))
    return out.select("c_custkey", F.size("rows").cast("long").alias("n"), F.try_element_at("rows", F.lit(1))["o_orderkey"].alias("first_order"))


@add("relations_many_to_many", "SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def relations_many_to_many(spark, d):
    nation = parquet(spark, d, "nation")
    ids = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey"), asc=False).alias("nationIds"))
    region = parquet(spark, d, "region").join(ids, F.col("r_regionkey") == F.col("n_regionkey")).drop("n_regionkey")
    own = Engine(spark).register(EntityType.of_frame("region", "r_regionkey", region, relations=(Relation("nations", "many_to_many", "nation", "nationIds"),)), region)
    own.register(EntityType.of_frame("nation", "n_nationkey", nation), nation)
    return own.related("region").select("r_regionkey", F.array_join(F.transform("nations", lambda n: n["n_name"]), ",").alias("names"))


# --- vectors and passages

QUERY = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)"


def _probe(spark, d) -> list[float]:
    # one row by its key
    return parquet(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@add("vec_topk", f"SELECT vec_id, round({COSINE}, 9) AS score FROM embeddings, {QUERY} ORDER BY {COSINE} DESC, vec_id LIMIT 10")
def vec_topk(spark, d):
    return similarity.top_k(parquet(spark, d, "embeddings"), "embedding", _probe(spark, d), 10, "vec_id").select("vec_id", F.round("score", 9).alias("score"))


@add("vec_filtered_topk", f"SELECT vec_id, label, round({COSINE}, 9) AS score FROM embeddings, {QUERY} WHERE label = 3 ORDER BY {COSINE} DESC, vec_id LIMIT 10")
def vec_filtered_topk(spark, d):
    return similarity.top_k(parquet(spark, d, "embeddings"), "embedding", _probe(spark, d), 10, "vec_id", F.col("label") == 3).select("vec_id", "label", F.round("score", 9).alias("score"))


@add("vec_centroid_by_label", "SELECT label, \"at\", round(avg(x / n), 9) AS mean FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS \"at\", sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) GROUP BY 1, 2")
def vec_centroid_by_label(spark, d):
    own = V.centroids(parquet(spark, d, "embeddings"), ["label"], "embedding")
    return own.select("label", F.posexplode("centroid").alias("at", "mean")).select("label", F.col("at").cast("long").alias("at"), F.round("mean", 9).alias("mean"))


@add("vec_fused", f"SELECT vec_id, round((0.6 * {COSINE} + 0.1 * least(1.0, pow(0.5, label * 30 / 180.0))) / 0.7, 9) AS score FROM embeddings, {QUERY}")
def vec_fused(spark, d):
    rows = parquet(spark, d, "embeddings")
    base = V.cosine(F.col("embedding"), V.literal_vector(_probe(spark, d)))
    now = F.lit("2026-01-01").cast("timestamp")
    when = F.timestamp_seconds(now.cast("long") - F.col("label") * 30 * 86400)
    return rows.select("vec_id", F.round(V.fuse(base, None, V.decay(when, now)), 9).alias("score"))


def _diversified(candidates: str, k: int) -> str:
    """SQL for the (i, vec_id, score) that maximal marginal relevance picks of candidates (i, vec_id, score, v), i in the order of their scores."""
    return f"""
        RECURSIVE cand AS ({candidates}), sims AS (SELECT a.i AS i, b.i AS j, list_cosine_similarity(a.v, b.v) AS s FROM cand a, cand b),
        picks AS (
            SELECT 1 AS step, [1::BIGINT] AS chosen
            UNION ALL
            SELECT p.step + 1, list_append(p.chosen, (SELECT arg_min(m.i, struct_pack(a := -m.mark, b := m.i)) FROM (
                SELECT c.i, 0.7 * c.score - 0.3 * max(s.s) AS mark FROM cand c JOIN sims s ON s.i = c.i WHERE list_contains(p.chosen, s.j) AND NOT list_contains(p.chosen, c.i) GROUP BY c.i, c.score
            ) m)) FROM picks p WHERE p.step < {k}
        )
        SELECT vec_id, round(score, 9) AS score FROM cand JOIN (SELECT unnest(chosen) AS i FROM picks WHERE step = {k}) USING (i)
    """


@add("vec_mmr", "WITH " + _diversified(f"SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS i, vec_id, score, v FROM (SELECT vec_id, {COSINE} AS score, CAST(embedding AS DOUBLE[]) AS v FROM embeddings, {QUERY} ORDER BY 2 DESC, 1 LIMIT 40)", 10))
def vec_mmr(spark, d):
    hits = similarity.top_k(parquet(spark, d, "embeddings"), "embedding", _probe(spark, d), 40, "vec_id")
    return similarity.rank(hits, "vec_id", None, _probe(spark, d), None, None, "embedding", 10).select("vec_id", F.round("score", 9).alias("score"))


# entities with a name's vector, a body whose passages' mean is the name's vector turned around, and a time in days by label
_POINT = EntityType("point", "vec_id", (Column("vec_id", "int64"), Column("label", "int32", metadata=True), Column("at", "datetime", metadata=True), Column("name", embedding=True), Column("body", chunk=Chunking())))
_NOW = "2026-01-01"


def _points(spark, d, t: EntityType, centroid: bool = True) -> Engine:
    rows = parquet(spark, d, "embeddings")
    when = F.timestamp_seconds(F.lit(_NOW).cast("timestamp").cast("long") - F.col("label") * 30 * 86400)
    points = rows.select("vec_id", "label", when.alias("at"), F.col("embedding").alias("name_vector"), *([F.reverse("embedding").alias("body_centroid")] if centroid else []))
    probe = _probe(spark, d)
    own = Engine(spark, vectors=similarity.VectorStore({"point": points}, {}, lambda text: probe))
    return own.register(t, points.select("vec_id", "label", "at", F.lit("n").alias("name"), F.lit("b").alias("body")))


def _now():
    import datetime

    return datetime.datetime.fromisoformat(_NOW).replace(tzinfo=datetime.timezone.utc)


FUSED = f"SELECT vec_id, (0.6 * {COSINE} + 0.3 * list_cosine_similarity(list_reverse(CAST(embedding AS DOUBLE[])), q) + 0.1 * least(1.0, pow(0.5, label * 30 / 180.0))) AS score, list_reverse(CAST(embedding AS DOUBLE[])) AS v FROM embeddings, {QUERY}"


@add("similar_reranked", "WITH " + _diversified(f"SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS i, vec_id, score, v FROM ({FUSED} WHERE vec_id IN (SELECT vec_id FROM embeddings, {QUERY} ORDER BY {COSINE} DESC, vec_id LIMIT 20))", 5))
def similar_reranked(spark, d):
    found = _points(spark, d, _POINT).similar(similar("point", "name").text("probe").top_k(5).build(), now=_now())
    return found.select("vec_id", F.round("score", 9).alias("score"))


@add("similar_filtered", f"SELECT vec_id, label, round({COSINE}, 9) AS score FROM embeddings, {QUERY} WHERE label = 3 OR NOT (label <= 5) ORDER BY {COSINE} DESC, vec_id LIMIT 10")
def similar_filtered(spark, d):
    from .dsl import Logic

    plain = EntityType("point", "vec_id", (Column("vec_id", "int64"), Column("label", "int32", metadata=True), Column("name", embedding=True)))
    request = similar("point", "name").text("probe").top_k(10).where("label", Op.EQUALS, 3.2).not_("label", Op.LESS_THAN_OR_EQUALS, 5).with_logic(Logic.OR).build()
    return _points(spark, d, plain, False).similar(request).select("vec_id", "label", F.round("score", 9).alias("score"))


@add("vec_batch_topk", f"SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 12) DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 3")
def vec_batch_topk(spark, d):
    rows = parquet(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return similarity.search_batch(asked, rows, "embedding", 3, "vec_id").select("query_id", "vec_id", "rank")


@add("vec_by_ids", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id IN (3, 5, 8)")
def vec_by_ids(spark, d):
    ids = spark.createDataFrame([(3,), (5,), (5,), (8,), (-1,)], "vec_id long")
    return collections.by_ids(parquet(spark, d, "embeddings"), ids, "vec_id", "embedding").select("vec_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


def _named(spark, d):
    return parquet(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"), F.array(F.col("label").cast("double")).alias("b"))


@add("vec_upsert", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 1.0 ELSE CAST(label AS DOUBLE) END AS b, vec_id % 7 <> 0 AS has_a FROM embeddings")
def vec_upsert(spark, d):
    points = _named(spark, d)
    new = points.where("vec_id % 7 = 0").select("vec_id", F.array(F.lit(1.0)).alias("b"))
    return upsert(points, new, "vec_id").select("vec_id", F.element_at("b", 1).alias("b"), F.col("a").isNotNull().alias("has_a"))


@add("vec_update_named", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 1.0 ELSE CAST(label AS DOUBLE) END AS b, true AS has_a FROM embeddings")
def vec_update_named(spark, d):
    points = _named(spark, d)
    new = points.where("vec_id % 7 = 0").select("vec_id", F.array(F.lit(1.0)).alias("b"))
    return update_vectors(points, new, "vec_id").select("vec_id", F.element_at("b", 1).alias("b"), F.col("a").isNotNull().alias("has_a"))


@add("vec_delete", "SELECT vec_id FROM embeddings WHERE NOT (label = 2) AND vec_id <> 4")
def vec_delete(spark, d):
    points = collections.delete_where(parquet(spark, d, "embeddings"), F.col("label") == 2)
    return delete(points, spark.createDataFrame([(4,)], "vec_id long"), "vec_id").select("vec_id")


_DOC = EntityType("documents", "doc_id", (Column("doc_id", "int64"), Column("text", chunk=Chunking(128, 16)), Column("lang", metadata=True)))


def _passages(spark, d, embed=None):
    return ingest.passage_frame(parquet(spark, d, "documents").select("doc_id", "text", "lang"), _DOC, "text", embed)


STARTS = "SELECT doc_id, text, unnest(range(0, length(text), 448)) AS start FROM documents"
CUT = f"SELECT doc_id, text, start, least(start + 512, length(text)) AS stop FROM ({STARTS})"
BACK = f"SELECT *, CASE WHEN stop < length(text) AND NOT regexp_full_match(substr(text, stop + 1, 1), '\\s') THEN (SELECT max(i) FROM (SELECT unnest(range(stop - least(stop - start, 50) + 1, stop + 1)) AS i) WHERE substr(text, i + 1, 1) = ' ' AND i > start) END AS space FROM ({CUT})"


@add("chunk_documents", f"SELECT CAST(doc_id AS VARCHAR) AS parent_id, CAST(start // 448 AS INTEGER) AS chunk_index, regexp_replace(substr(text, start + 1, coalesce(space, stop) - start), '^\\s+|\\s+$', '', 'g') AS text FROM ({BACK})")
def chunk_documents(spark, d):
    return _passages(spark, d).select("parent_id", "chunk_index", "text")


@add("chunk_counts", "SELECT CAST(doc_id AS VARCHAR) AS parent_id, CAST(ceil(length(text) / 448.0) AS BIGINT) AS n FROM documents")
def chunk_counts(spark, d):
    return _passages(spark, d).groupBy("parent_id").agg(F.count("*").alias("n"))


VOWELS = "aeiou"


def _vowels(text: str) -> list[float]:
    """A model that SQL knows as well: how often each vowel is in a text."""
    return [float(text.count(v)) for v in VOWELS]


CHUNKS = f"SELECT doc_id, start, regexp_replace(substr(text, start + 1, coalesce(space, stop) - start), '^\\s+|\\s+$', '', 'g') AS t FROM ({BACK})"
COUNTED = f"SELECT doc_id, start, t, [{', '.join(f"CAST(length(t) - length(replace(t, '{v}', '')) AS DOUBLE)" for v in VOWELS)}] AS v FROM ({CHUNKS})"


@add("chunk_centroid", f"SELECT CAST(doc_id AS VARCHAR) AS parent_id, \"at\", round(avg(v[\"at\" + 1] / sqrt(list_dot_product(v, v))), 9) AS mean FROM ({COUNTED}), range({len(VOWELS)}) r(\"at\") WHERE list_dot_product(v, v) > 0 GROUP BY 1, 2")
def chunk_centroid(spark, d):
    own = V.centroids(_passages(spark, d, _vowels), ["parent_id"], "text_vector")
    return own.select("parent_id", F.posexplode("centroid").alias("at", "mean")).select("parent_id", F.col("at").cast("long").alias("at"), F.round("mean", 9).alias("mean"))


@add("chunk_search", f"SELECT round(max(list_cosine_similarity(v, [3.0, 1.0, 2.0, 1.0, 0.0])), 9) AS score FROM ({COUNTED}) WHERE list_dot_product(v, v) > 0 AND start IS NOT NULL")
def chunk_search(spark, d):
    docs = parquet(spark, d, "documents").select("doc_id", "text", "lang")
    own = Engine(spark, vectors=similarity.VectorStore({}, {"documents": _passages(spark, d, _vowels)}, _vowels)).register(_DOC, docs)
    return own.chunks(chunks("documents", "text").text("aaaeiio").top_k(1).build()).select(F.round("score", 9).alias("score"))


@add("chunk_best_passage", f"SELECT CAST(doc_id AS VARCHAR) AS parent_id, round(max(list_cosine_similarity(v, [3.0, 1.0, 2.0, 1.0, 0.0])), 9) AS score FROM ({COUNTED}) WHERE list_dot_product(v, v) > 0 GROUP BY 1")
def chunk_best_passage(spark, d):
    scored = _passages(spark, d, _vowels).withColumn("score", V.cosine(F.col("text_vector"), V.literal_vector(_vowels("aaaeiio")))).where("score IS NOT NULL")
    return similarity.best_passage(scored).select("parent_id", F.round("score", 9).alias("score"))


def _fnv(text: str) -> str:
    return f"list_reduce(list_prepend({V.FNV_OFFSET}::HUGEINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, CAST(i AS INTEGER), 1))::HUGEINT)), lambda h, b: (xor(h, b) * {V.FNV_PRIME}::HUGEINT) % {1 << 64}::HUGEINT)"


def _wrapped(number: str) -> str:
    return f"CAST(CASE WHEN {number} >= {1 << 63}::HUGEINT THEN {number} - {1 << 64}::HUGEINT ELSE {number} END AS BIGINT)"


@add("chunk_ids", f"SELECT doc_id, chunk_index, {_wrapped('xor(parent, (((field * 1000003 + chunk_index) % 18446744073709551616::HUGEINT) * 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT)')} AS chunk_id FROM (SELECT doc_id, CAST(start // 448 AS INTEGER) AS chunk_index, {_fnv('CAST(doc_id AS VARCHAR)')} AS parent, {_fnv(chr(39) + 'text' + chr(39))} AS field FROM ({STARTS}))")
def chunk_ids(spark, d):
    return _passages(spark, d).select(F.col("parent_id").cast("long").alias("doc_id"), "chunk_index", "chunk_id")


@add("doc_decay", "SELECT o_orderkey, round(least(1.0, pow(0.5, date_diff('second', o_orderdate, TIMESTAMP '2001-08-02') / 86400.0 / 180)), 9) AS decay FROM orders")
def doc_decay(spark, d):
    own = V.decay(F.col("o_orderdate"), F.lit("2001-08-02").cast("timestamp"))
    return parquet(spark, d, "orders").select("o_orderkey", F.round(own, 9).alias("decay"))


# --- authorization: status is the tenant and priority the owner of an order

_RULES = {"orders": authz.Rules(bypass_roles=frozenset({"admin"}), hidden={"o_totalprice": frozenset({"finance"})}), "customer": authz.Rules(bypass_roles=frozenset({"user", "admin"}))}
_CALLER = authz.Caller("1-URGENT", "f", frozenset({"user"}))


def _secured(spark, d, *names: str) -> Engine:
    own = Engine(spark, rules=_RULES)
    orders = parquet(spark, d, "orders").withColumn("o_orderstatus", F.lower("o_orderstatus"))
    own.register(EntityType.of_frame("orders", "o_orderkey", orders, tenant_field="o_orderstatus", owner_field="o_orderpriority"), orders)
    for n in names:
        own.register(EntityType.of_frame(n, KEYS[n], parquet(spark, d, n)), parquet(spark, d, n))
    return own


VISIBLE = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"


@add("authz_owner_tenant", f"SELECT o_orderkey, o_custkey FROM orders WHERE {VISIBLE} AND o_custkey > 10 ORDER BY o_orderkey LIMIT 500")
def authz_owner_tenant(spark, d):
    return _secured(spark, d).search(query("orders").where("o_custkey").gt(10).fields("o_custkey").order_by("o_orderkey").limit(500).build(), _CALLER)


@add("authz_join_on", f"SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE {VISIBLE}) ON c_custkey = o_custkey GROUP BY 1")
def authz_join_on(spark, d):
    return _secured(spark, d, "customer").group_by(group_by("customer").join("c_custkey", "orders", "o_custkey", JoinKind.LEFT).key("c_custkey").count("o_orderkey", "n").all_rows().build(), _CALLER)


@add("authz_mask", f"SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus, o_orderdate, o_orderpriority FROM orders WHERE {VISIBLE} ORDER BY o_orderkey LIMIT 100")
def authz_mask(spark, d):
    return _secured(spark, d).search(query("orders").order_by("o_orderkey").limit(100).build(), _CALLER)


@add("authz_denied_is_empty", "SELECT o_orderkey FROM orders WHERE false")
def authz_denied_is_empty(spark, d):
    return _secured(spark, d).search(query("orders").fields("o_orderkey").build(), None).select("o_orderkey")


# --- changelogs: an event table read as creates, updates and deletes of its users' state


def _changelog(spark, d):
    events = parquet(spark, d, "events")
    row = F.to_json(F.struct(F.col("user_id"), F.col("event_type"), F.col("value")))
    return events.select(
        F.when(F.col("event_type") == "error", "deleted").otherwise("updated").alias("op"), F.lit("usr").alias("type"), F.col("user_id").cast("string").alias("key"),
        F.when(F.col("event_id") % 97 == 0, "{broken").otherwise(row).alias("payload"), F.lit(1).alias("targets"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("occurred_at"),
    )


_USER = EntityType("usr", "user_id", (Column("user_id", "int64"), Column("event_type"), Column("value", "double")))
LAST = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 97 <> 0 OR event_type = 'error'"


@add("stream_last_write_wins", f"SELECT user_id, event_type, value FROM ({LAST}) WHERE rn = 1 AND event_type <> 'error'")
def stream_last_write_wins(spark, d):
    empty = spark.createDataFrame([], "user_id long, event_type string, value double")
    return projection.merge(empty, _changelog(spark, d), _USER)


@add("stream_out_of_order", f"SELECT user_id, event_type, value FROM ({LAST}) WHERE rn = 1 AND event_type <> 'error'")
def stream_out_of_order(spark, d):
    """Batches that come last first, one of them twice."""
    events = _changelog(spark, d)
    batches = [projection.delta(events.where(F.col("offset") % 3 == k), _USER) for k in (2, 0, 1, 2)]
    return projection.living(reduce(DataFrame.unionByName, batches), _USER)


_OWNED = EntityType("usr", "user_id", (Column("user_id", "int64"), Column("event_type"), Column("value", "double"), Column("tenant")), tenant_field="tenant")


@add("stream_rederived", f"SELECT user_id, value, 't' || CAST(user_id % 3 AS VARCHAR) AS tenant FROM ({LAST}) WHERE rn = 1 AND event_type <> 'error' AND user_id % 5 <> 0")
def stream_rederived(spark, d):
    """Tenants of the stored records, not those that payloads claim; users without a record are passed over."""
    users = parquet(spark, d, "events").where("user_id % 5 <> 0").select("user_id", F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant")).distinct()
    forged = _changelog(spark, d).withColumn("payload", F.replace("payload", F.lit("}"), F.lit(',"tenant":"forged"}')))
    empty = spark.createDataFrame([], "user_id long, event_type string, value double, tenant string")
    return projection.merge(empty, forged, _OWNED, records=users).select("user_id", "value", "tenant")


def _tries(spark, d):
    """(entries, marks): an outbox of every event, with as many failed tries as its number says and a success for each fourth."""
    entries = _changelog(spark, d)
    tries = parquet(spark, d, "events").select(F.col("event_id").alias("offset"))
    failed = tries.where("offset % 13 > 0").select("offset", F.explode(F.sequence(F.lit(1), (F.col("offset") % 13).cast("int"))), F.lit(False).alias("ok"))
    return entries, failed.select("offset", "ok").unionAll(tries.where("offset % 4 = 0").select("offset", F.lit(True).alias("ok")))


TRIED = "SELECT event_id, event_id % 13 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS attempts, event_id % 4 = 0 AS published FROM events"


@add("outbox_counts", f"SELECT count(*) FILTER (NOT published AND attempts < 10) AS pending, count(*) FILTER (NOT published AND attempts >= 10) AS exhausted, count(*) FILTER (published) AS published FROM ({TRIED})")
def outbox_counts(spark, d):
    return outbox.counts(*_tries(spark, d))


@add("outbox_pending", f'SELECT event_id AS "offset", attempts FROM ({TRIED}) WHERE NOT published AND attempts < 10 ORDER BY event_id LIMIT 100')
def outbox_pending(spark, d):
    return outbox.pending(*_tries(spark, d)).select("offset", "attempts")


def _letters(spark, d):
    _, bad = projection.split_events(_changelog(spark, d), _USER)
    rows = bad.withColumn("id", F.concat_ws(":", "type", "key", "offset"))
    return rows, rows.where("offset % 2 = 0").select("id")


@add("dlq_replay_counts", "SELECT count(*) FILTER (event_id % 2 = 1) AS unreplayed, count(*) FILTER (event_id % 2 = 0) AS replayed FROM events WHERE event_id % 97 = 0 AND event_type <> 'error'")
def dlq_replay_counts(spark, d):
    return letters.counts(*_letters(spark, d))


@add("dlq_unreplayed", "SELECT event_id AS \"offset\" FROM events WHERE event_id % 97 = 0 AND event_type <> 'error' AND event_id % 2 = 1")
def dlq_unreplayed(spark, d):
    return letters.unreplayed(*_letters(spark, d)).select("offset")


@add("topic_round_trip", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 97 <> 0 OR event_type = 'error') WHERE rn = 1 AND event_type <> 'error'")
def topic_round_trip(spark, d):
    """Events as messages of a topic and back; the broker's offset orders them."""
    events = _changelog(spark, d)
    sent = tables.encode_events(events.withColumn("key", F.concat_ws("|", "key", "offset")), "00-trace-01")
    came = sent.select(F.split("key", "[|]")[0].cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.split("key", "[|]")[1].cast("long").alias("offset"), F.current_timestamp().alias("timestamp"))
    return projection.living(projection.delta(tables.decode_events(came), _USER), _USER)


@add("stream_delete", f"SELECT user_id FROM ({LAST}) WHERE rn = 1 AND event_type = 'error'")
def stream_delete(spark, d):
    good, _ = projection.split_events(_changelog(spark, d), _USER)
    return projection.last_events(good).where("op = 'deleted'").select(F.col("key").cast("long").alias("user_id"))


@add("stream_dlq_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 97 = 0 AND event_type <> 'error' GROUP BY 1")
def stream_dlq_counts(spark, d):
    _, bad = projection.split_events(_changelog(spark, d), _USER)
    kinds = parquet(spark, d, "events").select(F.col("event_id").alias("offset"), "event_type")
    return bad.join(kinds, "offset").groupBy("event_type").agg(F.count("*").alias("n"))


@add("keyed_latest", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def keyed_latest(spark, d):
    return latest(parquet(spark, d, "conversations"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role")


_ENRICHED = EntityType("documents", "doc_id", (Column("doc_id", "int64"), Column("text"), Column("lang"), Column("source"), Column("n_chars", "int64"), Column("summary", enrichment="summary")))


@add("enrich_hash_changed", "SELECT doc_id, sha256(text || chr(31) || lang || chr(31) || source || chr(31) || 'summary=summary:') AS hash FROM documents WHERE doc_id % 3 <> 0")
def enrich_hash_changed(spark, d):
    docs = parquet(spark, d, "documents").withColumn("summary", F.lit(None).cast("string"))
    state = docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("key"), projection.enrichment_hash(_ENRICHED).alias("hash"))
    return projection.to_enrich(docs, _ENRICHED, state).select("doc_id", F.col("_hash").alias("hash"))


@add("reconcile_events", "SELECT 'nation' AS type, CAST(n_nationkey AS VARCHAR) AS key, 'updated' AS op FROM nation")
def reconcile_events(spark, d):
    df = parquet(spark, d, "nation")
    return projection.reconcile(df, EntityType.of_frame("nation", "n_nationkey", df)).select("type", "key", "op")
