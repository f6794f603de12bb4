"""FROM, JOIN and WHERE of a request, which Search, GroupBy and Aggregate share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..authz import OPEN, Constraint
from ..dsl import Clause, Join, Logic
from ..errors import QueryError
from ..plans import predicates
from ..plans.resolve import Scope
from ..schema import EntityType, Registry


@dataclass
class Context:
    """Where types and their rows come from, and what the caller is held to. limits None: no authorization."""

    registry: Registry
    frames: dict[str, DataFrame]
    limits: dict[str, Constraint | None] | None = None

    def type(self, name: str) -> EntityType:
        found = self.registry.get(name)
        if found is None:
            raise QueryError(f"type '{name}' is not registered")
        return found

    def limit(self, t: EntityType) -> Constraint | None:
        """None if the caller is denied."""
        return OPEN if self.limits is None else self.limits.get(t.name.lower())

    def rows(self, t: EntityType) -> DataFrame:
        """The rows of a type that the caller may see, in declared columns."""
        df = self.frames[t.name.lower()]
        limit = self.limit(t)
        if limit is None:
            raise QueryError(f"type '{t.name}' is not permitted")
        return limit.rows(df)

    def denied(self, name: str) -> bool:
        return self.limit(self.type(name)) is None


def joined(ctx: Context, type_name: str, joins: Sequence[Join]) -> tuple[DataFrame, Scope]:
    """The primary type's rows joined as asked, each type under its name.

    Owner and tenant filters are on each input, before the join: the same for INNER and LEFT, and RIGHT and FULL show
    no row that the caller may not see.
    """
    primary = ctx.type(type_name)
    scope = Scope()
    scope.add(primary, ctx.limit(primary) or OPEN, ctx.frames[primary.name.lower()].schema)
    df = ctx.rows(primary).alias(primary.name)
    for join in joins:
        left, right = ctx.type(join.left_type), ctx.type(join.right_type)
        if not scope.has(left.name):
            raise QueryError(f"join from '{left.name}', which is not joined before")
        if scope.has(right.name):
            raise QueryError(f"'{right.name}' is joined twice")
        one = Scope([left], scope.limits).require(join.left_field, "join field")
        scope.add(right, ctx.limit(right) or OPEN, ctx.frames[right.name.lower()].schema)
        other = Scope([right], scope.limits).require(join.right_field, "join field")
        df = df.join(ctx.rows(right).alias(right.name), one == other, join.kind.value)
    return df, scope


def filtered(df: DataFrame, scope: Scope, clauses: Sequence[Clause], logic: Logic) -> DataFrame:
    """df held to the clauses; those whose field is unknown are left out."""
    found = predicates.where(clauses, logic is Logic.OR, scope.column, scope.kind)
    return df if found is None else df.where(found)


def having(df: DataFrame, clauses: Sequence[Clause], logic: Logic, strict: bool = True) -> DataFrame:
    """df held to clauses on its own output columns."""
    names = {c.lower(): c for c in df.columns}

    def own(name: str) -> str | None:
        found = names.get(name.lower()) or names.get(name.rpartition(".")[2].lower())
        if found is None and strict:
            raise QueryError(f"HAVING names '{name}', which is not an output")
        return found

    found = predicates.where(clauses, logic is Logic.OR, lambda n: F.col(f"`{own(n)}`") if own(n) else None, lambda n: df.schema[own(n)].dataType)
    return df if found is None else df.where(found)


def having_predicate(fields: dict[str, Column], clauses: Sequence[Clause], logic: Logic) -> Column | None:
    """The clauses on a row that is not in a frame yet; those that name none of its fields are left out."""
    return predicates.where(clauses, logic is Logic.OR, lambda n: fields.get(n.lower()) if n.lower() in fields else fields.get(n.rpartition(".")[2].lower()))
