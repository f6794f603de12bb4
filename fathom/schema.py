"""Entity types: columns, keys, relations, tenancy, and the registry that resolves them by name."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, types as T

from .errors import SchemaError

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
# Scalar kinds and the names that passage records use themselves.
KINDS = {
    "string": T.StringType(), "guid": T.StringType(), "int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampType(), "bytes": T.BinaryType(),
}
PASSAGE_KEYS = ("text", "parent_id", "field", "chunk_index")
OWNERSHIP_KINDS = ("string", "guid", "bytes", "datetime")
RELATIONS = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")


def snake(name: str) -> str:
    """lower_snake_case of a type's name."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def camel(name: str) -> str:
    return name[:1].lower() + name[1:]


@dataclass(frozen=True)
class Chunking:
    """How a long text column is cut into passages, in tokens of four characters."""

    max_tokens: int = 512
    overlap: int = 64
    contextual: bool = False


@dataclass(frozen=True)
class Column:
    name: str
    kind: str = "string"
    array: bool = False
    nullable: bool = True
    search_order: int | None = None
    large: bool = False
    metadata: bool = False
    embedding: bool = False
    chunk: Chunking | None = None
    enrichment: str | None = None  # summary, keywords or extracted
    hint: str = ""
    description: str = ""

    @property
    def spark_type(self) -> T.DataType:
        own = KINDS[self.kind]
        return T.ArrayType(own) if self.array else own

    @property
    def is_foreign_key(self) -> bool:
        return self.name.endswith(("Id", "Ids"))


@dataclass(frozen=True)
class Relation:
    """name: the property that nests related entities; key: the column that points, here or (one_to_many) there."""

    name: str
    kind: str
    target: str
    key: str


@dataclass(frozen=True)
class EntityType:
    name: str
    key: str
    columns: tuple[Column, ...]
    relations: tuple[Relation, ...] = ()
    tenant_field: str | None = None
    owner_field: str | None = None
    table: str = ""
    description: str = ""
    unique: bool = True  # whether no two rows have one key

    @property
    def table_name(self) -> str:
        return self.table or snake(self.name) + "s"

    @property
    def names(self) -> list[str]:
        """The key first, then the other columns as declared."""
        return [self.key, *(c.name for c in self.columns if c.name.lower() != self.key.lower())]

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)

    def spark_schema(self) -> T.StructType:
        own = {c.name.lower(): c for c in self.columns}
        return T.StructType([T.StructField(n, own[n.lower()].spark_type if n.lower() in own else T.StringType(), n != self.key) for n in self.names])

    @property
    def search_keys(self) -> list[str]:
        return [c.name for c in sorted((c for c in self.columns if c.search_order is not None), key=lambda c: c.search_order)]

    @property
    def columnar(self) -> bool:
        """Whether the type is projected to the columnar store: no relation that is kept elsewhere."""
        return not any(r.kind == "one_to_many" or (r.kind == "many_to_many" and self.column(r.key) is None) for r in self.relations)

    @property
    def vectorised(self) -> bool:
        return any(c.embedding or c.chunk for c in self.columns)

    @property
    def vector_names(self) -> list[str]:
        return [f"{camel(c.name)}_vector" for c in self.columns if c.embedding] + [f"{camel(c.name)}_centroid" for c in self.columns if c.chunk]

    @staticmethod
    def of_frame(name: str, key: str, df: DataFrame, **more) -> EntityType:
        """A type with the columns of a frame."""
        kinds = {T.StringType: "string", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "bool", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.BinaryType: "bytes"}
        columns = []
        for f in df.schema:
            array = isinstance(f.dataType, T.ArrayType)
            kind = kinds.get(type(f.dataType.elementType if array else f.dataType), "string")
            columns.append(Column(f.name, kind, array=array, nullable=f.nullable))
        return EntityType(name, key, tuple(columns), **more)


def check(t: EntityType, require_tenant: bool = True) -> None:
    """Raise SchemaError for what registration rejects."""

    def bad(why: str):
        raise SchemaError(f"{t.name}: {why}")

    for n in (t.name, *t.names):
        if not IDENTIFIER.match(n):
            bad(f"'{n}' is not an identifier")
    if not t.key:
        bad("a key is required")
    if len({c.name.lower() for c in t.columns}) != len(t.columns):
        bad("two columns have one name")
    if require_tenant and not t.tenant_field:
        bad("a tenant field is required")
    chunked = any(c.chunk for c in t.columns)
    for role in (t.tenant_field, t.owner_field):
        if role:
            own = t.column(role)
            if own is None or own.array or own.kind not in OWNERSHIP_KINDS:
                bad(f"'{role}' must be a column that holds strings")
            if chunked and camel(role) in PASSAGE_KEYS:
                bad(f"'{role}' collides with a key of passages")
    source = any(c.kind == "string" and c.enrichment is None and c.name != t.key for c in t.columns)
    for c in t.columns:
        if c.kind not in KINDS:
            bad(f"'{c.name}' has the unknown kind '{c.kind}'")
        if c.search_order is not None and c.large:
            bad(f"'{c.name}' is both a search key and a large field")
        if c.metadata and (c.embedding or c.chunk or c.array or c.large):
            bad(f"'{c.name}' cannot be metadata")
        if c.metadata and camel(c.name) in PASSAGE_KEYS:
            bad(f"metadata '{c.name}' collides with a key of passages")
        if c.chunk and c.chunk.max_tokens < 1:
            bad(f"'{c.name}' needs passages of one token at least")
        if c.enrichment:
            if c.kind != "string" or c.array or c.name.lower() in {x.lower() for x in (t.key, t.tenant_field, t.owner_field) if x}:
                bad(f"'{c.name}' cannot be filled by enrichment")
            if c.embedding or c.chunk:
                bad(f"'{c.name}' is enriched and embedded")
            if c.enrichment == "extracted" and not c.hint:
                bad(f"'{c.name}' needs a hint")
            if not source:
                bad("enrichment has no source column")
    for r in t.relations:
        if r.kind not in RELATIONS:
            bad(f"relation '{r.name}' has the unknown kind '{r.kind}'")


def drift(stored: T.StructType, t: EntityType) -> dict[str, list[str]]:
    """How a stored table differs from a type: columns to add, to remove, and whose type changed."""
    old, new = {f.name.lower(): f.dataType for f in stored}, {f.name.lower(): f.dataType for f in t.spark_schema()}
    return {"add": sorted(new.keys() - old.keys()), "remove": sorted(old.keys() - new.keys()), "changed": sorted(n for n in new.keys() & old.keys() if new[n] != old[n])}


def migrate(df: DataFrame, t: EntityType) -> DataFrame:
    """A stored frame in the shape of a type: added columns are null, removed ones go, a changed type is an error."""
    from pyspark.sql import functions as F

    found = drift(df.schema, t)
    if found["changed"]:
        raise SchemaError(f"{t.name}: the type of {', '.join(found['changed'])} changed")
    own = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(own[f.name.lower()]).alias(f.name) if f.name.lower() in own else F.lit(None).cast(f.dataType).alias(f.name) for f in t.spark_schema()])


@dataclass
class Registry:
    """Types by name, whatever the case."""

    types: dict[str, EntityType] = field(default_factory=dict)
    require_tenant: bool = False

    def register(self, *types: EntityType) -> Registry:
        for t in types:
            check(t, self.require_tenant)
        self.types |= {t.name.lower(): t for t in types}
        return self

    def remove(self, name: str) -> None:
        self.types.pop(name.lower(), None)

    def get(self, name: str) -> EntityType | None:
        return self.types.get(name.lower())

    def __iter__(self) -> Iterable[EntityType]:
        return iter(self.types.values())

    def discover(self, readable) -> list[EntityType]:
        """The types that readable(type) allows, with its fields only; readable gives None or the allowed columns.

        A relation goes if its target or its local key is not readable.
        """
        seen = {t.name.lower(): (t, allowed) for t in self if (allowed := readable(t)) is not None}
        out = []
        for t, allowed in seen.values():
            names = {a.lower() for a in allowed} | {t.key.lower()}
            kept = tuple(r for r in t.relations if r.target.lower() in seen and (r.kind == "one_to_many" or t.column(r.key) is None or r.key.lower() in names))
            out.append(replace(t, columns=tuple(c for c in t.columns if c.name.lower() in names), relations=kept))
        return out
