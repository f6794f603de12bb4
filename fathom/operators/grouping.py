"""GroupBy: keys and named metrics in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..dsl import METRICS, Agg, GroupByRequest, Metric
from ..errors import QueryError
from ..plans.exprs import expression
from ..plans.resolve import Scope
from ..schema import IDENTIFIER
from .relational import Context, filtered, having, joined

DEFAULT_LIMIT = 10_000
FUNCTIONS = {Agg.AVG: F.avg, Agg.SUM: F.sum, Agg.MIN: F.min, Agg.MAX: F.max, Agg.COUNT: F.count}


def scope_expression(scope: Scope, text: str, what: str) -> Column:
    """An expression over a scope's bare column names; ambiguous and forbidden ones are errors."""
    names = [n for t in scope.types for n in t.names]
    found = {}
    for n in names:
        own = scope.find(n)
        if own:
            found[n.lower()] = own

    def qualify(name: str) -> str:
        t, own = found[name.lower()]
        scope.check_permitted(t, own)
        return f"`{t.name}`.`{own}`"

    return expression(text, found, what, qualify)


def metric_input(scope: Scope, metric: Metric) -> Column | None:
    """What a metric is taken of; None for COUNT(*). An expression beats a field, but both are checked."""
    if metric.type not in METRICS:
        raise QueryError(f"{metric.type.name} is not a metric")
    own = scope.require(metric.field, "metric field") if metric.field else None
    if metric.expression:
        own = scope_expression(scope, metric.expression, f"metric '{metric.name}'")
    if own is None and metric.type is not Agg.COUNT:
        raise QueryError(f"metric '{metric.name}' needs a field or an expression")
    return own


def group_by(ctx: Context, request: GroupByRequest) -> DataFrame:
    """One row for each combination of keys. COUNT of a field counts its non-null values."""
    if not request.keys:
        raise QueryError("group_by needs one key at least")
    for join in request.joins:
        if ctx.denied(join.right_type):
            raise QueryError(f"type '{join.right_type}' is not permitted")
    denied = ctx.denied(request.type)
    if denied:
        ctx = Context(ctx.registry, {k: v.where(F.lit(False)) for k, v in ctx.frames.items()})
    df, scope = joined(ctx, request.type, request.joins)
    df = filtered(df, scope, request.clauses, request.logic)
    keys = [scope.require(k, "key").alias(k.rpartition(".")[2] if scope.find(k) is None else scope.find(k)[1]) for k in request.keys]
    metrics = []
    for m in request.metrics:
        if not IDENTIFIER.match(m.name or ""):
            raise QueryError(f"'{m.name}' is not a valid metric name")
        own = metric_input(scope, m)
        metrics.append(FUNCTIONS[m.type](own if own is not None else F.lit(1)).alias(m.name))
    # keys without metrics are their distinct combinations
    out = df.groupBy(*keys).agg(*metrics) if metrics else df.select(*keys).distinct()
    names = [c.lower() for c in out.columns]
    if len(set(names)) != len(names):
        raise QueryError("two outputs have one name")
    out = having(out, request.having, request.having_logic)
    order = []
    for s in request.sorts:
        bare = s.field.rpartition(".")[2].lower()
        if bare not in names:
            raise QueryError(f"unknown or ambiguous ORDER BY property '{s.field}'")
        order.append(F.col(f"`{bare}`").desc() if s.descending else F.col(f"`{bare}`").asc())
    if order:
        out = out.orderBy(*order)
    if request.limit is None:
        return out
    return out.limit(request.limit if request.limit > 0 else DEFAULT_LIMIT)
