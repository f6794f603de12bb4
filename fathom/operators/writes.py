"""Keyed writes on frames: the latest version of a key wins, deletes are tombstones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..errors import SchemaError
from ..schema import EntityType

GUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by the order given."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those of the same key in full: columns that changes lack become null.

    changes must hold a key once; unknown columns are ignored, rows without a key too.
    """
    own = {c.lower(): c for c in changes.columns}
    rows = changes.select(*[F.col(f"`{own[f.name.lower()]}`").cast(f.dataType).alias(f.name) if f.name.lower() in own else F.lit(None).cast(f.dataType).alias(f.name) for f in stored.schema])
    rows = rows.where(F.col(f"`{key}`").isNotNull())
    return stored.join(rows.select(key), key, "left_anti").select(*stored.columns).unionByName(rows)


def delete(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti").select(*stored.columns)


def update_columns(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The columns that changes has are set where a key is there; other columns and keys stay."""
    names = [c for c in changes.columns if c.lower() != key.lower()]
    new = changes.select(key, F.struct(*[F.col(f"`{c}`") for c in names]).alias("_new"))
    joined = stored.join(new, key, "left")
    by_name = {c.lower(): c for c in names}
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{by_name[c.lower()]}")).otherwise(F.col(f"`{c}`")).alias(c) if c.lower() in by_name else F.col(f"`{c}`") for c in stored.columns])


def update_vectors(points: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Named vectors that changes gives replace the stored ones; those it leaves null stay. Unknown points stay unknown."""
    names = [c for c in changes.columns if c.lower() != key.lower()]
    joined = points.join(changes.select(key, *[F.col(f"`{c}`").alias(f"_new_{c}") for c in names]), key, "left")
    return joined.select(*[F.coalesce(F.col(f"`_new_{c}`"), F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in points.columns])


def create_table(df: DataFrame, t: EntityType, path: str, files: int = 4) -> None:
    """The columnar table of a type: by tenant if it has one, hashed by key, sorted by its search keys."""
    out = df.repartition(files, F.col(f"`{t.key}`"))
    sort = t.search_keys or [t.key]
    out = out.sortWithinPartitions(*([t.tenant_field] if t.tenant_field else []), *sort)
    writer = out.write.mode("overwrite")
    (writer.partitionBy(t.tenant_field) if t.tenant_field else writer).parquet(path)


def validate_relations(t: EntityType, row: dict) -> None:
    """Foreign keys must be GUIDs that are not empty; to-one keys are required unless nullable."""
    empty = "00000000-0000-0000-0000-000000000000"
    for r in t.relations:
        if r.kind == "one_to_many":
            continue
        own = t.column(r.key)
        value = row.get(r.key)
        nested = row.get(r.name)
        if value is None and isinstance(nested, dict):
            value = next((v for k, v in nested.items() if k.lower() in ("id", "key")), None)
        many = r.kind == "many_to_many"
        if value is None or value == "":
            if not many and own is not None and not own.nullable:
                raise SchemaError(f"{t.name}.{r.key} is required")
            continue
        for one in value if many else [value]:
            if own is not None and own.kind == "guid" and (not GUID.match(str(one)) or str(one) == empty):
                raise SchemaError(f"{t.name}.{r.key}: '{one}' is not a valid id")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or any(t.startswith(name.lower()) for t in taken):
        name += "_"
    return name
