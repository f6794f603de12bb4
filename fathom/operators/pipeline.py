"""Pipeline: named steps over a base, each a frame that later steps read or join.

A step is a chain of small transformations of one table: rows, groups, or joined and windowed columns and a projection.
Each looks its names up in the columns of the frame before it, so a step that names what is not there fails where it
does; nothing is run until the result is asked for.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..authz import OPEN
from ..dsl import BASE, METRICS, Agg, Clause, Logic, PipelineRequest, Step
from ..errors import QueryError
from ..functions.dates import truncate
from ..plans import predicates
from ..plans.exprs import expression
from ..schema import IDENTIFIER
from . import windows
from .grouping import DEFAULT_LIMIT, FUNCTIONS
from .relational import Context

#: Parts of a step that exclude each other, and parts that need another.
APART = (("a grouping", "windows"), ("a grouping", "a select"), ("a grouping", "derived columns"), ("joins", "windows"), ("joins", "derived columns"))
TOGETHER = (("joins", "a select"), ("a grouping", "a key"))


@dataclass(frozen=True)
class Table:
    """A frame, and for what a request calls its columns where they are in it."""

    df: DataFrame
    names: dict[str, str]
    whole: bool = True  # whether all of its columns may be asked for at once

    @staticmethod
    def of(df: DataFrame, whole: bool = True) -> Table:
        return Table(df, {c.lower(): c for c in df.columns}, whole)

    def name(self, name: str | None) -> str:
        found = self.names.get((name or "").lower())
        if found is None:
            raise QueryError(f"unknown column '{name}'")
        return found

    def __getitem__(self, name: str | None) -> Column:
        return F.col(f"`{self.name(name)}`")

    def held(self, clauses: Iterable[Clause], logic: Logic) -> Table:
        found = predicates.where(list(clauses), logic is Logic.OR, self.__getitem__, lambda n: self.df.schema[self.name(n)].dataType)
        return self if found is None else Table(self.df.where(found), self.names, self.whole)


def pipeline(ctx: Context, request: PipelineRequest) -> DataFrame:
    """The last step, sorted, and limited unless all rows are asked for; an empty frame if the caller may not read the primary type."""
    t = ctx.type(request.type)
    if not request.steps:
        raise QueryError("a pipeline needs one step at least")
    rows = ctx.frames[t.name.lower()].where(F.lit(False)) if ctx.denied(request.type) else ctx.rows(t)
    limit = ctx.limit(t) or OPEN
    tables = {BASE: _labelled("the base", lambda: Table.of(rows.select(*[F.col(f"`{n}`") for n in t.names if limit.permits(n)])).held(request.clauses, request.logic))}
    for step in request.steps:
        _check_name(ctx, step.name, tables)
        # a name that is read twice is only planned twice; exchanges that are equal are run once
        tables[step.name.lower()] = _labelled(step.name, lambda step=step: _built(ctx, step, tables))
    last = list(tables.values())[-1]
    order = _labelled("the final sort", lambda: [last[s.field].desc() if s.descending else last[s.field].asc() for s in request.sorts])
    out = last.df.orderBy(*order) if order else last.df
    if request.limit is None:
        return out
    return out.limit(request.limit if request.limit > 0 else DEFAULT_LIMIT)


def _labelled(where: str, build):
    """What build gives; its errors say where they are from."""
    try:
        return build()
    except QueryError as e:
        raise QueryError(f"{where}: {e}") from e


def _check_name(ctx: Context, name: str, tables: dict[str, Table]) -> None:
    if not IDENTIFIER.match(name or ""):
        raise QueryError(f"'{name}' is not a valid step name")
    if name.lower() in tables or ctx.registry.get(name) is not None:
        raise QueryError(f"step name '{name}' is taken by a step or a type")


def _built(ctx: Context, step: Step, tables: dict[str, Table]) -> Table:
    parts = {"a grouping": step.aggregates, "a key": step.keys, "windows": step.windows, "a select": step.select, "derived columns": step.derive, "joins": step.joins}
    for one, other in APART:
        if parts[one] and parts[other]:
            raise QueryError(f"{one} and {other} cannot share a step")
    for one, other in TOGETHER:
        if parts[one] and not parts[other]:
            raise QueryError(f"{one} needs {other}")
    own = (step.reads or list(tables)[-1]).lower()
    if own not in tables:
        raise QueryError(f"it reads '{step.reads}', which is not an earlier step")
    table = tables[own].held(step.clauses, step.logic)
    if step.aggregates:
        return _grouped(table, step)
    if step.joins:
        return _joined(ctx, table, own, step, tables)
    return _widened(table, own, step)


def _new_name(name: str | None, what: str, taken: Iterable[str]) -> str:
    if not IDENTIFIER.match(name or ""):
        raise QueryError(f"'{name}' is not a valid {what}")
    if name.lower() in {t.lower() for t in taken}:
        raise QueryError(f"two outputs are named '{name}'")
    return name


def _plain(df: DataFrame) -> DataFrame:
    """Decimals of derived arithmetic as doubles."""
    own = [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("double") for c in own}) if own else df


def _grouped(table: Table, step: Step) -> Table:
    keys: dict[str, Column] = {}
    for name, unit in step.keys:
        own = table.name(name)
        out = _new_name(f"{own}_{unit.lower()}" if unit else own, "key", keys)
        keys[out] = (truncate(table[name], unit) if unit else table[name]).alias(out)
    metrics: dict[str, Column] = {}
    for m in step.metrics:
        out = _new_name(m.name, "metric name", [*keys, *metrics])
        if m.type not in METRICS:
            raise QueryError(f"{m.type.name} is not a metric")
        given = table[m.field] if m.field else None
        if m.expression:
            given = expression(m.expression, table.names.values(), f"metric '{out}'")
        if given is None and m.type is not Agg.COUNT:
            raise QueryError(f"metric '{out}' needs a field or an expression")
        metrics[out] = FUNCTIONS[m.type](F.lit(1) if given is None else given).alias(out)
    # keys without metrics are their distinct combinations
    df = _plain(table.df.groupBy(*keys.values()).agg(*metrics.values())) if metrics else table.df.select(*keys.values()).distinct()
    return Table.of(df).held(step.having, Logic.AND)


def _joined(ctx: Context, table: Table, own: str, step: Step, tables: dict[str, Table]) -> Table:
    """The input joined to earlier steps or types, and a projection; each source's columns go under names of their own meanwhile."""
    left = _apart(table, 0)
    df, sources = left.df, {own: left}
    if len({j.source.lower() for j in step.joins}) < len(step.joins):
        raise QueryError("a source is joined twice")
    for number, join in enumerate(step.joins, 1):
        name = join.source.lower()
        right = _apart(tables[name] if name in tables else _of_type(ctx, join.source), number)
        if not join.on:
            raise QueryError(f"the join to '{join.source}' needs a condition")
        df = df.join(right.df, reduce(Column.__and__, [left[a] == right[b] for a, b in join.on]), join.kind.value)
        sources[name] = right
    return _projected(df, sources, own, left, step, ())


def _apart(table: Table, number: int) -> Table:
    names = {lower: f"_{number}_{name}" for lower, name in table.names.items()}
    return Table(table.df.select(*[F.col(f"`{table.names[k]}`").alias(v) for k, v in names.items()]), names, table.whole)


def _of_type(ctx: Context, name: str) -> Table:
    """A registered type that the caller may read, with the fields that they may see."""
    t = ctx.registry.get(name)
    if t is None:
        raise QueryError(f"'{name}' is neither an earlier step nor a type")
    limit = ctx.limit(t)
    if limit is None:
        raise QueryError(f"type '{t.name}' is not permitted")
    return Table.of(ctx.rows(t).select(*[F.col(f"`{n}`") for n in t.names if limit.permits(n)]), limit.allowed is None)


def _widened(table: Table, own: str, step: Step) -> Table:
    """The input with window and derived columns, and a projection of it if one is asked for."""
    df, shown = table.df, list(table.names.values()) if not step.select else []
    more: list[str] = []
    for w in step.windows:
        out = _new_name(w.alias, "window name", [*shown, *more])
        field = table.name(w.field) if w.kind in windows.NEEDS_FIELD else None
        df = windows.add(df, w.kind, out, table.name(w.order_by), w.descending, field, table.name(w.partition_by) if w.partition_by else None, w.offset)
        more.append(out)
    for name, text in step.derive:
        out = _new_name(name, "name of a derived column", [*shown, *more])
        df = df.withColumn(out, expression(text, [*table.names.values(), *more], f"'{out}'"))
        more.append(out)
    df = _plain(df) if step.derive else df
    return _projected(df, {own: table}, own, table, step, more) if step.select else Table.of(df, table.whole)


def _projected(df: DataFrame, sources: dict[str, Table], own: str, table: Table, step: Step, more: Iterable[str]) -> Table:
    """The picks of a step's select and what the step adds; the input can be called by its name or, before any step, `base`."""
    out: dict[str, Column] = {}

    def add(label: str, column: Column) -> None:
        out[_new_name(label, "alias", out)] = column.alias(label)

    joined = {j.source.lower() for j in step.joins}
    for pick in step.select:
        name = pick.source.lower()
        source = sources[name] if name in joined else table if name == own else None
        if source is None:
            raise QueryError(f"select source '{pick.source}' is neither the input nor joined")
        if pick.column is None and not source.whole:
            raise QueryError(f"all of '{pick.source}' is not permitted; select single columns")
        for lower in source.names if pick.column is None else [(pick.column or "").lower()]:
            where = source.name(lower)
            add(pick.alias or _shown(where, name in joined or bool(joined)), F.col(f"`{where}`"))
    for name in more:
        add(name, F.col(f"`{name}`"))
    return Table.of(df.select(*out.values()))


def _shown(name: str, apart: bool) -> str:
    """A column's own name, without the number of its source."""
    return name.split("_", 2)[2] if apart else name
