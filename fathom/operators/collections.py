"""Vector collections as frames: their shape, migration, copies behind an alias, pages and deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..authz import valid_tenant
from ..errors import SchemaError
from ..schema import EntityType, camel, snake
from ..sources import files

#: Points of a page.
PAGE = 100


def collection_name(t: EntityType, tenant: str, passages: bool = False) -> str:
    """The physical name of a tenant's collection of a type."""
    if not valid_tenant(tenant):
        raise SchemaError(f"'{tenant}' is not a valid tenant")
    return f"{snake(t.name)}{'_chunks' if passages else ''}_{tenant}"


def payload_indexes(t: EntityType) -> dict[str, str]:
    """The index kind of each payload column."""
    kinds = {"int32": "integer", "int64": "integer", "float": "float", "double": "float", "bool": "boolean", "datetime": "datetime"}
    return {camel(c.name): "keyword" if c.array and c.kind == "float" else kinds.get(c.kind, "keyword") for c in t.columns}


def ensure(points: DataFrame, names: list[str], dimension: int) -> DataFrame:
    """points with every named vector: missing ones are null; one of another dimension is an error."""
    have = {c.lower() for c in points.columns}
    for n in names:
        if n.lower() in have:
            sizes = points.where(F.col(f"`{n}`").isNotNull()).select(F.size(F.col(f"`{n}`")).alias("n")).where(F.col("n") != dimension)
            if not sizes.isEmpty():
                raise SchemaError(f"'{n}' holds vectors that have not {dimension} dimensions")
    return points.withColumns({n: F.lit(None).cast("array<double>") for n in names if n.lower() not in have})


def by_ids(points: DataFrame, ids: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) of the ids that exist; ids is the caller's own short list."""
    return points.join(ids.select(key).distinct(), key, "left_semi").select(key, vector)


def page(points: DataFrame, key: str, after=None, size: int = PAGE) -> DataFrame:
    """The next points by key after a key; the last key of a page is where the next one begins."""
    rows = points if after is None else points.where(F.col(f"`{key}`") > F.lit(after))
    return rows.orderBy(F.asc(f"`{key}`")).limit(size)


def delete_where(points: DataFrame, condition: Column) -> DataFrame:
    """points without those whose payload meets a condition; a missing field does not meet it."""
    return points.where(~F.coalesce(condition, F.lit(False)))


@dataclass
class Collection:
    """A collection's versions in a folder; those who read it see the one that its alias names."""

    spark: SparkSession
    path: str

    def current(self) -> int:
        """The version of the newest alias; -1 before the first."""
        return max((int(n[1:]) for n in files.names(self.spark, f"{self.path}/alias")), default=-1)

    def read(self) -> DataFrame:
        version = self.current()
        if version < 0:
            raise SchemaError("the collection does not exist")
        return self.spark.read.parquet(f"{self.path}/v{version}")

    def replace(self, points: DataFrame) -> int:
        """Write all points as a new version and let the alias name it; readers see the old one until then. Its number."""
        version = self.current() + 1
        points.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        # the alias is an empty folder of the version's number: made in one step, the highest one holds
        files.make(self.spark, f"{self.path}/alias/v{version}")
        return version

    def migrate(self, names: list[str], dimension: int) -> bool:
        """Copy the points with every named vector into a new version; False if they have them already."""
        old = self.read()
        new = ensure(old, names, dimension)
        if new.columns == old.columns:
            return False
        self.replace(new)
        return True

    def clear(self) -> None:
        """Delete the versions that the alias does not name any more."""
        now = self.current()
        files.delete(self.spark, *[f"{self.path}/{n}" for n in files.names(self.spark, self.path) if n.startswith("v") and int(n[1:]) < now])
