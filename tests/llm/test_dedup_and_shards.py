import hashlib
import math
import zlib
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings, strategies as st

from fathom.llm import exact_dedup, sharding

SCHEMA = "doc_id long, text string"


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_dedup_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(exact_dedup.dedup_groups(odd)) == brute_groups(rows)
    assert sorted((r.doc_id or 0) for r in exact_dedup.dedup(odd).collect()) == [0, 2, 2, 4, 6, 7, 8]
    assert exact_dedup.dedup(odd).columns == odd.columns


def test_exact_dedup_empty(spark):
    assert exact_dedup.dedup_groups(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.one_of(st.none(), st.text("ab", max_size=12))), min_size=1, max_size=25))
def test_exact_dedup_any_prefixes(spark, rows):
    # tiny blocks, so that texts end at and around block borders
    assert got(exact_dedup.dedup_groups(spark.createDataFrame(rows, SCHEMA), first_block=2, growth=2)) == brute_groups(rows)


def draw(key, shard):
    return (int(hashlib.md5(f"{shard}:{'null' if key is None else key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def shard(key, weights):
    return min((-math.log(draw(key, i)) / w, i) for i, w in enumerate(weights) if w > 0)[1]


def test_sharding(spark, odd):
    rows = sharding.assign(odd).collect()
    assert len(rows) == odd.count()
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts)
    for r in rows:
        assert r.law == "key" and r.shard == shard(r.doc_id, [1] * 8) and r.grown_shard == shard(r.doc_id, [1] * 9) and r.grown_shard in (r.shard, 8)


def test_sharding_slots_and_weights(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    rows = sharding.assign(df, weights=[1, 1, 2, 0]).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {k: len(s) for k, s in slots.items()}
    assert 3 not in sizes and 0.4 < sizes[2] / 4000 < 0.6 and sum(r.grown_shard == 4 for r in rows) / 4000 < 0.25
    assert sharding.assign(df.limit(0)).collect() == []
    plan = sharding.assign(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
