"""Names in a request to columns of frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, StructType

from ..authz import OPEN, Constraint
from ..errors import QueryError
from ..schema import EntityType


@dataclass
class Scope:
    """The types that a request has in its FROM, in order, each under an alias that is its name."""

    types: list[EntityType] = field(default_factory=list)
    limits: dict[str, Constraint] = field(default_factory=dict)
    schemas: dict[str, StructType] = field(default_factory=dict)

    def add(self, t: EntityType, limit: Constraint = OPEN, schema: StructType | None = None) -> None:
        self.types.append(t)
        self.limits[t.name.lower()] = limit
        if schema is not None:
            self.schemas[t.name.lower()] = schema

    def has(self, name: str) -> bool:
        return any(t.name.lower() == name.lower() for t in self.types)

    def find(self, name: str) -> tuple[EntityType, str] | None:
        """(type, column) of `Field` or `Type.Field`; None if there is none or a bare name is ambiguous."""
        owner, dot, bare = name.rpartition(".")
        found = []
        for t in self.types:
            if dot and t.name.lower() != owner.lower():
                continue
            found += [(t, n) for n in t.names if n.lower() == bare.lower()]
        return found[0] if len(found) == 1 else None

    def check_permitted(self, t: EntityType, name: str) -> None:
        if not self.limits[t.name.lower()].permits(name):
            raise QueryError(f"field '{name}' is not permitted")

    def column(self, name: str) -> Column | None:
        """The column, None if the name does not resolve; a field kept from the caller is an error."""
        found = self.find(name)
        if found is None:
            return None
        self.check_permitted(*found)
        return F.col(f"`{found[0].name}`.`{found[1]}`")

    def kind(self, name: str) -> DataType | None:
        """The type of a column as it is stored; None if it is not known."""
        found = self.find(name)
        schema = self.schemas.get(found[0].name.lower()) if found else None
        return next((f.dataType for f in schema if f.name.lower() == found[1].lower()), None) if schema is not None else None

    def require(self, name: str, what: str) -> Column:
        own = self.column(name)
        if own is None:
            raise QueryError(f"unknown or ambiguous {what} '{name}'")
        return own

