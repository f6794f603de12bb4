"""From entities to points and passages: the vector projection as frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..schema import EntityType, camel

CONTEXT_CHARS = 2000


#: Texts that a model with a `many` method gets at once.
EMBED_BATCH = 64


def embed_all(embed: Callable[[str], Sequence[float]], texts: Sequence[str | None]) -> list[list[float] | None]:
    """Vectors of texts, in batches if the model takes them; null and empty texts have none."""
    own = [(i, x) for i, x in enumerate(texts) if isinstance(x, str) and x]
    out: list[list[float] | None] = [None] * len(texts)
    many = getattr(embed, "many", None)
    for k in range(0, len(own), EMBED_BATCH):
        part = own[k : k + EMBED_BATCH]
        for (i, _), vector in zip(part, many([x for _, x in part]) if many else map(embed, [x for _, x in part])):
            out[i] = list(vector)
    return out


def passage_frame(df: DataFrame, t: EntityType, property: str, embed: Callable[[str], Sequence[float]] | None = None, context: Callable[[str, str], str] | None = None) -> DataFrame:
    """(chunk_id, parent_id, field, chunk_index, text, <property>_vector, metadata) of one long column.

    context(summary or start of the document, passage) gives a sentence put before the passage for the embedding only;
    if it fails the passage is embedded alone. Null and empty texts have no passages.
    """
    own = t.column(property)
    size, overlap = own.chunk.max_tokens, own.chunk.overlap
    field = own.name

    @F.pandas_udf("array<struct<id:long,text:string,vector:array<double>>>")
    def cut(keys: pd.Series, texts: pd.Series) -> pd.Series:
        def one(key, text):
            out = []
            for i, passage in enumerate(V.split_passages(text, size, overlap)):
                shown = passage
                if context is not None:
                    try:
                        shown = f"{context((text or '')[:CONTEXT_CHARS], passage)}\n{passage}"
                    except Exception:
                        shown = passage
                out.append({"id": V.signed(V.chunk_point_id(V.point_id(str(key)), field, i)), "text": passage, "vector": list(embed(shown)) if embed else None})
            return out

        return pd.Series([one(k, x) for k, x in zip(keys, texts)], dtype=object)

    metadata = [c.name for c in t.columns if c.metadata]
    roles = [n for n in (t.owner_field, t.tenant_field) if n and n not in metadata]
    key = F.col(f"`{t.key}`").cast("string")
    rows = df.select(key.alias("parent_id"), *[F.col(f"`{m}`").alias(camel(m)) for m in metadata + roles], F.posexplode(cut(key, F.col(f"`{field}`"))).alias("chunk_index", "_c"))
    vector = [F.col("_c.vector").alias(f"{camel(field)}_vector")] if embed else []
    return rows.select(F.col("_c.id").alias("chunk_id"), "parent_id", F.lit(field).alias("field"), "chunk_index", F.col("_c.text").alias("text"), *vector, *[camel(m) for m in metadata + roles])


def point_frame(df: DataFrame, t: EntityType, embed: Callable[[str], Sequence[float]], passages: dict[str, DataFrame] | None = None, records: DataFrame | None = None) -> DataFrame:
    """(point_id, key, payload, a vector for each embedded column, a centroid for each column with passages).

    records: the stored rows, of which owner and tenant are taken whatever df says; entities without one have none.
    """
    roles = [c for c in (t.owner_field, t.tenant_field) if c]
    if records is not None and roles:
        stored = records.select(F.col(f"`{t.key}`").cast("string").alias("_key"), *[F.col(f"`{c}`").alias(f"_{c}") for c in roles])
        joined = df.join(stored, df[t.key].cast("string") == F.col("_key"), "left")
        df = joined.select(*[F.col(f"`_{c}`").alias(c) if c in roles else F.col(f"`{c}`") for c in df.columns])

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(embed_all(embed, texts.tolist()), dtype=object)

    @F.pandas_udf("long")
    def number(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: V.signed(V.point_id(str(k)))).astype("int64")

    key = F.col(f"`{t.key}`").cast("string")
    out = df.select(number(key).alias("point_id"), *[F.col(f"`{n}`") for n in t.names], *[vector(F.col(f"`{c.name}`")).alias(f"{camel(c.name)}_vector") for c in t.columns if c.embedding])
    for property, rows in (passages or {}).items():
        name = camel(t.column(property).name)
        own = V.centroids(rows, ["parent_id"], f"{name}_vector", f"{name}_centroid")
        out = out.join(own, out[t.key].cast("string") == own["parent_id"], "left").drop("parent_id")
    return out
