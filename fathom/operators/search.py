"""Search: filter, join, project, sort and page."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..dsl import SearchRequest
from ..errors import QueryError
from .relational import Context, filtered, joined

DEFAULT_SIZE = 50


def projection(scope, fields) -> list:
    """The key first, then the fields as asked; without fields all columns. Unknown fields are left out.

    A field of a joined type must be qualified; it takes the name Type_field if its own is taken.
    """
    primary = scope.types[0]
    limit = scope.limits[primary.name.lower()]
    if not fields:
        return [F.col(f"`{primary.name}`.`{n}`").alias(n) for n in primary.names if limit.permits(n)]
    out = {primary.key.lower(): F.col(f"`{primary.name}`.`{primary.key}`").alias(primary.key)}
    for name in fields:
        if "." not in name:
            own = next((n for n in primary.names if n.lower() == name.lower()), None)
            if own and own.lower() not in out and limit.permits(own):
                out[own.lower()] = F.col(f"`{primary.name}`.`{own}`").alias(own)
            continue
        found = scope.find(name)
        if found and scope.limits[found[0].name.lower()].permits(found[1]):
            t, own = found
            if t is primary and own.lower() in out:
                continue
            label = own if own.lower() not in out else f"{t.name}_{own}"
            out.setdefault(label.lower(), F.col(f"`{t.name}`.`{own}`").alias(label))
    return list(out.values())


def search(ctx: Context, request: SearchRequest) -> DataFrame:
    """The page asked for; an empty frame if the caller may not read the primary type."""
    primary = ctx.type(request.type)
    for join in request.joins:
        if ctx.denied(join.right_type):
            raise QueryError(f"type '{join.right_type}' is not permitted")
    if ctx.denied(request.type):
        return ctx.frames[primary.name.lower()].where(F.lit(False))
    df, scope = joined(ctx, request.type, request.joins)
    df = filtered(df, scope, request.clauses, request.logic)
    order = [c.desc() if s.descending else c.asc() for s in request.sorts if (c := scope.column(s.field)) is not None]
    if order:
        df = df.orderBy(*order)
    size = request.size if request.size > 0 else DEFAULT_SIZE
    if request.page > 0:
        df = df.offset(request.page * size)
    return df.limit(size).select(*projection(scope, request.fields))
