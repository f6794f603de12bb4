"""

Each workload runs once to warm up and then several times; its figure is the median in seconds. Types are registered
once, as in a running service; every run plans and executes its request anew.
"""

from __future__ import annotations

import json
import os
import statistics
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def main() -> None:
    from fathom import catalog, session
    from fathom.dsl import Op, aggregate, query

    spark = session.local(CPUS, int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    own = catalog.engine(spark, SF_DIR, "orders", "part", "customer", "lineitem")
    keys = [str(r[0]) for r in own.frames["orders"].select("o_orderkey").orderBy("o_orderkey").limit(5000).collect()][::10]
    probe = catalog._probe(spark, SF_DIR)
    vectors = catalog.parquet(spark, SF_DIR, "embeddings")
    fields = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    one = query("orders").where("o_orderstatus").eq("F").fields(*fields).limit(50).build()
    two = query("orders").where("o_orderstatus").eq("F").where("o_totalprice").gt(100000).order_by_desc("o_orderdate").order_by("o_orderkey").fields(*fields).limit(50).build()
    like = query("part").where("p_size").gt(5).where("p_brand").contains("1").order_by("p_partkey").limit(50).build()
    single = aggregate("orders").terms("o_orderpriority", "t", 5).build()
    six = aggregate("orders").terms("o_orderpriority", "t", 5).range("o_totalprice", "r", [("low", None, 100000), ("high", 100000, None)]).date_histogram("o_orderdate", "h", "month").avg("o_totalprice", "a").min("o_totalprice", "lo").max("o_totalprice", "hi").build()
    wide = aggregate("lineitem").where("l_quantity", Op.GREATER_THAN, 10).terms("l_returnflag", "t").sum("l_extendedprice", "s").count("l_suppkey", "n").build()
    from fathom.operators import similarity

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    work = {
        "search_1_clause": lambda: own.search(one).collect(),
        "search_2_clauses_sort": lambda: own.search(two).collect(),
        "search_like_sort": lambda: own.search(like).collect(),
        "aggregate_1_spec": lambda: own.aggregate(single).collect(),
        "aggregate_6_specs": lambda: own.aggregate(six).collect(),
        "aggregate_lineitem": lambda: own.aggregate(wide).collect(),
        **{f"get_many_{n}": lambda n=n: own.get_many("orders", keys[:n]).collect() for n in (1, 10, 100, 500)},
        "vector_topk": lambda: similarity.top_k(vectors, "embedding", probe, 10, "vec_id").select("vec_id", "score").collect(),
        "groupby_q1": lambda: catalog.QUERIES["groupby_q1"](spark, SF_DIR).collect(),
        "pipe_topn": lambda: noop(catalog.QUERIES["pipe_topn"](spark, SF_DIR)),
        "relations_one_to_many": lambda: noop(catalog.QUERIES["relations_one_to_many"](spark, SF_DIR)),
        "changelog_merge": lambda: noop(catalog.QUERIES["stream_last_write_wins"](spark, SF_DIR)),
    }
    figures = {}
    for name, run in work.items():
        run()
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        figures[name] = round(statistics.median(times), 4)
    print(json.dumps({"metric": "sum of median latencies", "value": round(sum(figures.values()), 4), "unit": "sec", "queries": figures, "sf": SF_DIR}))
    spark.stop()


if __name__ == "__main__":
    main()
