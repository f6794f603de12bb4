"""Vector search over entities and passages: exact cosine top-k, fused with other signals and diversified."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from ..dsl import Clause, Logic
from ..errors import QueryError, UnavailableError
from ..functions import vectors as V
from ..plans import predicates
from ..schema import EntityType, camel
from .relational import Context

OVER_FETCH = 4
#: Bytes of the query vectors that a worker gets at once.
QUERY_BYTES = 8 << 20


class HashingEmbedder:
    """A deterministic stand-in for a model: hashed words, signed, of length 1."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, text: str) -> list[float]:
        out = [0.0] * self.dimension
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % self.dimension] += 1.0 if h >> 63 else -1.0
        size = math.sqrt(sum(x * x for x in out))
        return [x / size for x in out] if size else out


@dataclass
class VectorStore:
    """Points of each type: (key, <property>_vector, <property>_centroid, payload columns) and passages of each."""

    points: dict[str, DataFrame | Callable[[], DataFrame]]
    passages: dict[str, DataFrame]
    embed: Callable[[str], Sequence[float]]

    def points_of(self, t: EntityType) -> DataFrame | None:
        """The points of a type; None if there are none or they cannot be read now."""
        own = self.points.get(t.name.lower())
        try:
            return own() if callable(own) else own
        except Exception:
            return None

    def dimension(self) -> int:
        """How many numbers the model gives, by a probe."""
        return len(self.embed("probe"))


def top_k(df: DataFrame, vector: str, query: Sequence[float], k: int, key: str, where: Column | None = None) -> DataFrame:
    """The k rows nearest by cosine, with their score; ties by key. Filters come before the ranking."""
    rows = df if where is None else df.where(where)
    scored = rows.withColumn("score", V.cosine_to(F.col(f"`{vector}`"), query)).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), F.asc(f"`{key}`")).limit(max(1, k))


def search_batch(queries: DataFrame, df: DataFrame, vector: str, k: int, key: str, query_key: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """The k nearest rows for each query vector, exactly: (query_id, key, score, rank). Ties by key.

    Queries go to the workers in blocks of at most QUERY_BYTES, each one reading of df; a batch of rows is scored against a
    block by one product of matrices and only its best rows for each query leave the worker.
    """
    bytes_each = queries.agg(F.max(F.size(query_vector)).alias("n")).first().n or 1
    rows = queries.where(F.col(query_vector).isNotNull()).select(query_key, query_vector)
    schema = T.StructType([queries.schema[query_key], df.schema[key], T.StructField("score", T.DoubleType())])
    size = max(1, QUERY_BYTES // (8 * bytes_each))
    block, parts = [], []

    def scored(own: list) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((pa.array([r[0] for r in own], _arrow(schema[0].dataType)), [r[1] for r in own]))
        return df.where(F.col(f"`{vector}`").isNotNull()).select(F.col(f"`{key}`"), V.doubles(F.col(f"`{vector}`"))).mapInArrow(_nearest(shared, k, schema.names), schema)

    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == size:
            parts.append(scored(block))
            block = []
    if block or not parts:
        parts.append(scored(block))
    found = reduce(DataFrame.unionAll, parts)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(key)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _nearest(shared, k: int, names: list[str]):
    """Batches (key, vector) to (query, key, score): each batch's k best for each query, and those that tie with the last."""

    def run(batches):
        ids, vectors = shared.value
        lengths = {}
        for i, v in enumerate(vectors):
            lengths.setdefault(len(v), []).append(i)
        asked = {n: (np.array(rows), _units(np.array([vectors[i] for i in rows], float))) for n, rows in lengths.items()}
        for batch in batches:
            found = batch.column(1)
            sizes = pc.list_value_length(found).to_numpy(zero_copy_only=False)
            for n, (which, queries) in asked.items():
                rows = np.flatnonzero(sizes == n)
                if not len(rows) or not n:
                    continue
                own = _units(found.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), n))
                scores = own @ queries.T
                for column, query in enumerate(which):
                    s = scores[:, column]
                    fine = np.flatnonzero(~np.isnan(s))
                    if len(fine) > k:
                        fine = fine[s[fine] >= np.partition(s[fine], -k)[-k]]
                    if len(fine):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(fine), query))), batch.column(0).take(pa.array(rows[fine])), pa.array(s[fine])], names)

    return run


def _units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; of NaN if a row has no magnitude."""
    norms = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norms > 0, norms, np.nan)


def decay_field(t: EntityType) -> str | None:
    """The one metadata column of a type that is a time; None if there is none or more than one."""
    own = [c.name for c in t.columns if c.metadata and c.kind == "datetime" and not c.array]
    return own[0] if len(own) == 1 else None


def _filter(ctx: Context, t: EntityType, df: DataFrame, clauses: Sequence[Clause], logic: Logic) -> DataFrame:
    limit = ctx.limit(t)
    names = {c.lower(): c for c in df.columns}

    def resolve(name: str):
        own = t.column(name)
        if own is None and name.lower() != t.key.lower():
            return None
        if limit is not None and not limit.permits(name):
            raise QueryError(f"field '{name}' is not permitted")
        found = names.get(name.lower()) or names.get(camel(name).lower())
        return F.col(f"`{found}`") if found else None

    held = predicates.payload(clauses, logic is Logic.OR, resolve)
    df = df if held is None else df.where(held)
    return limit.rows(df) if limit is not None else df


def rank(hits: DataFrame, key: str, centroid: str | None, query: Sequence[float], when: str | None, now, diversity: str | None, k: int) -> DataFrame:
    """hits with their fused score, diversified down to k; reported scores are the fused ones."""
    signal = V.cosine_to(F.col(f"`{centroid}`"), query) if centroid else None
    recency = V.decay(F.col(f"`{when}`"), F.lit(now)) if when else None
    fused = hits.withColumn("score", V.fuse(F.col("score"), signal, recency)).orderBy(F.desc("score"), F.asc(f"`{key}`"))
    if diversity is None:
        return fused.limit(k)
    # at most OVER_FETCH * k candidates of one request come to the driver
    pool = [(r[key], r["score"], r[diversity]) for r in fused.select(key, "score", diversity).collect()]
    order = {c[0]: i for i, c in enumerate(V.diversify(pool, k))}
    places = hits.sparkSession.createDataFrame([(k_, i) for k_, i in order.items()], T.StructType([hits.schema[key], T.StructField("_place", T.IntegerType())]))
    return fused.join(F.broadcast(places), key).orderBy("_place").drop("_place")


def similar(ctx: Context, store: VectorStore, t: EntityType, prop: str, text: str, k: int = 10, clauses: Sequence[Clause] = (), logic: Logic = Logic.AND, now=None) -> DataFrame:
    """Entities whose property is nearest to a text: (columns, score). Types without points have no results."""
    own = t.column(prop)
    if own is None or not own.embedding:
        raise QueryError(f"'{prop}' is not an embedded property of {t.name}")
    if ctx.limit(t) is None:
        return ctx.frames[t.name.lower()].withColumn("score", F.lit(0.0)).where(F.lit(False))
    points = store.points_of(t)
    if points is None:
        return ctx.frames[t.name.lower()].withColumn("score", F.lit(0.0)).where(F.lit(False))
    try:
        query = list(store.embed(text))
    except Exception as e:
        raise UnavailableError("the embedding model cannot be reached") from e
    k = max(1, k)
    centroid = next((f"{camel(c.name)}_centroid" for c in t.columns if c.chunk and f"{camel(c.name)}_centroid" in points.columns), None)
    when = decay_field(t)
    rows = _filter(ctx, t, points, clauses, logic)
    # neither signal can exist: the nearest k are the result
    plain = centroid is None and when is None
    hits = top_k(rows, f"{camel(own.name)}_vector", query, k if plain else OVER_FETCH * k, t.key)
    out = hits if plain else rank(hits, t.key, centroid, query, when, now, centroid, k)
    limit = ctx.limit(t)
    names = [c for c in out.columns if not c.endswith(("_vector", "_centroid")) and (c == "score" or limit.permits(c))]
    return out.select(*names)


def passages(ctx: Context, store: VectorStore, t: EntityType, prop: str, text: str, k: int = 10, clauses: Sequence[Clause] = ()) -> DataFrame:
    """(parent_id, text, score) of the passages nearest to a text; a parent may come several times."""
    own = t.column(prop)
    if own is None or not own.chunk:
        raise QueryError(f"'{prop}' is not cut into passages in {t.name}")
    rows = store.passages.get(t.name.lower())
    for c in clauses:
        if c.op.name != "EQUALS" or c.negated:
            raise QueryError("passage searches filter by EQUALS only")
        meta = t.column(c.field)
        if c.field.lower() != t.key.lower() and not (meta is not None and meta.metadata):
            raise QueryError(f"'{c.field}' is neither the key nor metadata")
    if rows is None or ctx.limit(t) is None:
        spark = ctx.frames[t.name.lower()].sparkSession
        return spark.createDataFrame([], "parent_id string, text string, score double")
    for c in clauses:
        name = "parent_id" if c.field.lower() == t.key.lower() else camel(t.column(c.field).name)
        rows = rows.where(F.coalesce(F.col(f"`{name}`") == predicates.literal(c.value), F.lit(False)))
    vector, k = f"{camel(own.name)}_vector", max(1, k)
    try:
        query = list(store.embed(text))
    except Exception as e:
        raise UnavailableError("the embedding model cannot be reached") from e
    hits = top_k(rows.where(F.col("field") == own.name), vector, query, OVER_FETCH * k, "chunk_id")
    # without the parents' points there is no centroid signal, but passages
    points = store.points_of(t)
    centroid = f"{camel(own.name)}_centroid"
    if points is not None and centroid in points.columns:
        hits = hits.join(points.select(F.col(f"`{t.key}`").cast("string").alias("parent_id"), F.col(f"`{centroid}`")), "parent_id", "left")
    else:
        centroid = None
    return rank(hits, "chunk_id", centroid, query, None, None, vector if k > 1 else None, k).select("parent_id", "text", "score")


def best_passage(hits: DataFrame) -> DataFrame:
    """(parent_id, score): each parent's best passage."""
    return hits.groupBy("parent_id").agg(F.max("score").alias("score"))
