"""Vector maths, ids of points and passages of text."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

# Weights of the fused score, half-life of the recency decay, trade-off of diversification.
BASE_WEIGHT, CENTROID_WEIGHT, DECAY_WEIGHT = 0.60, 0.30, 0.10
HALF_LIFE_DAYS, LAMBDA = 180.0, 0.70
# FNV-1a of 64 bits, and what a passage's id is mixed with.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
INDEX_PRIME, GOLDEN = 1_000_003, 0x9E3779B97F4A7C15
CHARS_PER_TOKEN, LOOK_BACK = 4, 50
_MASK = (1 << 64) - 1


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a side is null, has another length or no magnitude."""
    sizes = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (sizes > 0), dot(a, b) / sizes)


def normalised(v: Column) -> Column:
    """v of length 1; null if it has no magnitude."""
    own = norm(v)
    return F.when(own > 0, F.transform(v, lambda x: x.cast("double") / own))


def literal_vector(v: Sequence[float]) -> Column:
    """An array of doubles, parsed at once: a call for each number would take longer than most searches."""
    return F.expr("array(" + ",".join(f"{float(x)!r}D" if math.isfinite(x) else f"double('{float(x)!r}')" for x in v) + ")")


def cosine_to(a: Column, v: Sequence[float]) -> Column:
    """cosine() of a column and one vector, whose magnitude is taken once."""
    total = 0.0
    for x in v:
        total += float(x) * float(x)
    sizes = norm(a) * F.lit(math.sqrt(total))
    return F.when((F.size(a) == F.lit(len(v))) & (sizes > 0), dot(a, literal_vector(v)) / sizes)


def centroids(df: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """For each group the mean of its normalised vectors, not normalised again; vectors without magnitude are left out.

    Sums are taken by whole vectors, so a task sends one of each group on. Where a group has vectors of several lengths,
    the commonest length holds (of two, the greater).
    """
    own = df.select(*keys, normalised(F.col(vector)).alias("_v")).where("_v IS NOT NULL")
    means = own.groupBy(*keys, F.size("_v").alias("_n")).agg(Summarizer.mean(array_to_vector("_v")).alias("_mean"), F.count("*").alias("_rows"))
    return means.groupBy(*keys).agg(F.max_by(vector_to_array("_mean"), F.struct("_rows", "_n")).alias(out))


def decay(when: Column, now: Column) -> Column:
    """Recency from 1 down, halved every HALF_LIFE_DAYS; null if the time is null or not a time."""
    days = (now.cast("timestamp").cast("double") - when.cast("timestamp").cast("double")) / 86400.0
    return F.when(days.isNotNull(), F.least(F.lit(1.0), F.pow(F.lit(0.5), days / HALF_LIFE_DAYS)))


def fuse(base: Column, centroid: Column | None = None, recency: Column | None = None) -> Column:
    """Weighted mean of the signals that are there; the base score itself if it is alone."""
    total, weight = base * BASE_WEIGHT, F.lit(BASE_WEIGHT)
    alone = F.lit(True)
    for signal, part in ((centroid, CENTROID_WEIGHT), (recency, DECAY_WEIGHT)):
        if signal is not None:
            total = total + F.coalesce(signal * part, F.lit(0.0))
            weight = weight + F.when(signal.isNotNull(), F.lit(part)).otherwise(F.lit(0.0))
            alone = alone & signal.isNull()
    return F.when(alone, base).otherwise(total / weight)


def similarity(a: Sequence[float] | None, b: Sequence[float] | None) -> float | None:
    """Cosine of two Python vectors; None where it does not exist."""
    if a is None or b is None or len(a) != len(b) or not len(a):
        return None
    sizes = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    value = sum(x * y for x, y in zip(a, b)) / sizes if sizes > 0 else math.nan
    return None if math.isnan(value) else value


def diversify(candidates: Sequence[tuple], k: int) -> list[tuple]:
    """Maximal marginal relevance over (id, score, vector), best first: at most k, their scores unchanged.

    The first is the top one; then the one with the best LAMBDA * score - (1 - LAMBDA) * (similarity to what is
    chosen), earlier ones first among equals. Without a similarity there is no penalty. The pool is a request's few
    candidates, so this runs on one machine.
    """
    pool, chosen = list(candidates), []
    worst: list[float | None] = [None] * len(pool)
    while pool and len(chosen) < max(0, k):
        best = 0
        if chosen:
            marks = [LAMBDA * c[1] - (1 - LAMBDA) * w if w is not None else LAMBDA * c[1] for c, w in zip(pool, worst)]
            best = max(range(len(pool)), key=lambda i: (marks[i], -i))
        pick = pool.pop(best)
        worst.pop(best)
        chosen.append(pick)
        for i, c in enumerate(pool):
            s = similarity(pick[2], c[2])
            if s is not None and (worst[i] is None or s > worst[i]):
                worst[i] = s
    return chosen


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & _MASK
    return h


def point_id(key: str) -> int:
    """Unsigned 64-bit id of a key: the last eight bytes of a GUID, little-endian; otherwise FNV-1a."""
    try:
        own = uuid.UUID(key) if len(key) == 36 else None
    except ValueError:
        own = None
    return int.from_bytes(own.bytes[8:], "little") if own else fnv1a(key.encode())


def chunk_point_id(parent: int, field: str, index: int) -> int:
    return parent ^ ((((fnv1a(field.encode()) * INDEX_PRIME + index) & _MASK) * GOLDEN) & _MASK)


def signed(value: int) -> int:
    """An unsigned id as the signed long that Spark stores."""
    return value - (1 << 64) if value >= 1 << 63 else value


def split_passages(text: str | None, max_tokens: int = 512, overlap: int = 64) -> list[str]:
    """Windows of max_tokens, each starting so many tokens less the overlap after the one before, trimmed.

    A window that would end inside a word ends at the last space of its last LOOK_BACK characters instead.
    """
    if max_tokens < 1:
        raise ValueError("a passage needs one token at least")
    size, shared = max_tokens * CHARS_PER_TOKEN, max(0, overlap) * CHARS_PER_TOKEN
    step = max(size - shared, size // 2)
    out, text = [], text or ""
    for start in range(0, len(text), step):
        end = min(start + size, len(text))
        if end < len(text) and not text[end].isspace():
            space = text.rfind(" ", end - min(end - start, LOOK_BACK) + 1, end + 1)
            end = space if space > start else end
        out.append(text[start:end].strip())
    return out
