"""Vector maths, ids and passages against values worked out by hand."""

import math
import uuid

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fathom.functions import vectors as V


def test_fuse_and_decay(spark):
    one = spark.range(1)
    full = one.select(V.fuse(F.lit(0.9), F.lit(0.5), F.lit(0.8))).first()[0]
    assert math.isclose(full, 0.77)
    assert one.select(V.fuse(F.lit(0.9), F.lit(None).cast("double"), F.lit(None).cast("double"))).first()[0] == 0.9
    days = [0, 180, 360, -5]
    frame = spark.createDataFrame([(d,) for d in days], "d int").select(V.decay(F.timestamp_seconds(F.lit(10**9) - F.col("d") * 86400), F.timestamp_seconds(F.lit(10**9))))
    assert [round(r[0], 9) for r in frame.collect()] == [1.0, 0.5, 0.25, 1.0]
    assert one.select(V.decay(F.lit("soon"), F.current_timestamp())).first()[0] is None


def test_cosine_and_centroid(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (1, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.0, 0.0])], "k int, v array<double>")
    assert [(r.k, [round(x, 9) for x in r.centroid]) for r in V.centroids(rows, ["k"], "v").collect()] == [(1, [0.8, 0.4])]
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in pairs.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(got[0], math.sqrt(0.5)) and got[1:] == [None, None, None]


def test_diversify():
    pick = lambda c, k: [x[0] for x in V.diversify(c, k)]
    assert pick([(1, 1.0, [1, 0]), (2, 0.9, [1, 0]), (3, 0.8, [0, 1])], 3) == [1, 3, 2]
    assert pick([(1, 1.0, [1, 0]), (2, 0.95, [1, 0]), (3, 0.6, [0, 1])], 2) == [1, 3]
    assert pick([(1, 1.0, [1, 0]), (2, 0.9, [1, 0]), (3, 0.8, [1, 0])], 3) == [1, 2, 3]
    assert pick([(1, 1.0, None), (2, 0.9, [math.nan, 1.0]), (3, 0.8, [0, 0])], 2) == [1, 2]
    assert pick([], 3) == [] and pick([(1, 1.0, [1])], 5) == [1]


def test_ids():
    assert V.fnv1a(b"") == 0xCBF29CE484222325 and V.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    own = uuid.UUID("00112233-4455-6677-8899-aabbccddeeff")
    assert V.point_id(str(own)) == int.from_bytes(own.bytes[8:], "little") and V.point_id("x") == V.fnv1a(b"x")
    assert V.chunk_point_id(5, "Body", 0) != V.chunk_point_id(5, "Body", 1) and 0 <= V.chunk_point_id(5, "Body", 7) < 1 << 64
    assert V.signed((1 << 64) - 1) == -1


def test_passages():
    assert V.split_passages("") == [] and V.split_passages(None) == []
    assert V.split_passages("abcd efgh ijkl", 2, 0) == ["abcd", "h ijkl"]


@settings(deadline=None, max_examples=50)
@given(st.text("ab ", max_size=300), st.integers(1, 20), st.integers(0, 25))
def test_passages_cover(text, size, overlap):
    parts = V.split_passages(text, size, overlap)
    step = max(size * 4 - overlap * 4, size * 2)
    assert len(parts) == -(-len(text) // step) and all(len(p) <= size * 4 for p in parts)
