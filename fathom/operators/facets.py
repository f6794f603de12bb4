"""Aggregate: facets over one filtered input, as rows (name, type, bucket_key, doc_count, metric_val).

A single bucketed facet, and any number of scalar metrics, are one aggregation each. Where they come together, every
row is dealt to all facets and one aggregation by (facet, key) counts them all, so the input is read once; what is
shuffled are counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..dsl import Agg, AggregateRequest, Metric, Spec
from ..errors import QueryError
from ..functions.dates import bucket_key
from ..plans.resolve import Scope
from . import windows
from .grouping import FUNCTIONS, metric_input
from .relational import Context, filtered, having, having_predicate, joined

#: Buckets of a terms facet without a size; parts in which the buckets of large inputs are ranked first.
DEFAULT_TERMS, PARTS = 10, 64
SCHEMA = "name string, type string, bucket_key string, doc_count long, metric_val double"


def range_key(value: Column, spec: Spec) -> Column:
    """The first bucket that holds the value: low inclusive, high exclusive; a bucket without limits is skipped."""
    out = None
    for b in spec.buckets:
        held = [value >= F.lit(float(b.low))] if b.low is not None else []
        held += [value < F.lit(float(b.high))] if b.high is not None else []
        if held:
            test = reduce(Column.__and__, held)
            out = F.when(test, b.key) if out is None else out.when(test, b.key)
    return F.lit(None).cast("string") if out is None else out


def _keys(scope: Scope, spec: Spec) -> list[Column]:
    """What a bucketed facet groups by, as texts."""
    if spec.field is None:
        raise QueryError(f"aggregation '{spec.name}' needs a field")
    own = [scope.require(f, "aggregation field") for f in (spec.group_by if len(spec.group_by) > 1 else [spec.field])]
    if spec.type is Agg.DATE_HISTOGRAM:
        return [bucket_key(own[0], spec.interval, spec.time_zone)]
    if spec.type is Agg.RANGE:
        return [range_key(own[0], spec)]
    return [c.cast("string") for c in own]


def _shown(keys: Column, many: bool) -> Column:
    """A bucket's key as one text; NULL if all of its parts are."""
    if not many:
        return F.element_at(keys, 1)
    return F.when(F.exists(keys, lambda k: k.isNotNull()), F.array_join(F.transform(keys, lambda k: F.coalesce(k, F.lit(""))), "|"))


def _size(spec: Spec) -> int:
    return spec.size if spec.size > 0 else DEFAULT_TERMS


def _bucketed(df: DataFrame, scope: Scope, spec: Spec, request: AggregateRequest) -> DataFrame:
    keys = _keys(scope, spec)
    if len(keys) > 1:
        counted = df.groupBy(F.array(*keys).alias("_keys")).agg(F.count("*").alias("doc_count"))
        out = counted.select(_shown(F.col("_keys"), True).alias("bucket_key"), "doc_count")
    else:
        out = df.groupBy(keys[0].alias("bucket_key")).agg(F.count("*").alias("doc_count"))
    out = having(out, request.having, request.having_logic, strict=False)
    if spec.type is Agg.TERMS:
        out = out.orderBy(F.desc("doc_count"), F.asc("bucket_key")).limit(_size(spec))
    # the bucket of NULL goes after the limit, so it can take up one of the places
    out = out.where("bucket_key IS NOT NULL")
    return out.select(F.lit(spec.name).alias("name"), F.lit(spec.type.value).alias("type"), "bucket_key", "doc_count", F.lit(None).cast("double").alias("metric_val"))


def _input(scope: Scope, spec: Spec) -> Column | None:
    return metric_input(scope, Metric(spec.name, spec.type, spec.field, spec.expression))


def _metric(spec: Spec, own: Column | None) -> Column:
    """COUNT of a field counts its distinct values, as facets do; without one, all rows."""
    if spec.type is Agg.COUNT:
        return F.count(F.lit(1)) if own is None else F.count_distinct(own)
    return FUNCTIONS[spec.type](own)


def _scalar_rows(specs: list[Spec], values: list[Column], request: AggregateRequest) -> Column:
    """One row (a struct) for each metric; HAVING sees it as metric_val, and turns it to null if it fails."""
    rows = []
    for spec, value in zip(specs, values):
        fields = {"name": F.lit(spec.name), "type": F.lit(spec.type.value), "bucket_key": F.lit(None).cast("string"), "doc_count": F.lit(None).cast("long"), "metric_val": value}
        held = having_predicate(fields, request.having, request.having_logic)
        fields["metric_val"] = value if held is None else F.when(held, value)
        rows.append(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return F.array(*rows)


def _scalars(df: DataFrame, scope: Scope, specs: list[Spec], request: AggregateRequest) -> DataFrame:
    """All scalar metrics in one pass, one row each."""
    values = df.agg(*[_metric(s, _input(scope, s)).cast("double").alias(f"m{i}") for i, s in enumerate(specs)])
    return values.select(F.inline(_scalar_rows(specs, [F.col(f"m{i}") for i in range(len(specs))], request)))


def _together(df: DataFrame, scope: Scope, specs: list[Spec], scalars: list[Spec], request: AggregateRequest) -> DataFrame:
    """Bucketed facets and scalar metrics in one aggregation; the scalars are a facet with one bucket."""
    own = [_keys(scope, s) for s in specs]
    inputs = [_input(scope, s) for s in scalars]
    none, last = F.lit(None).cast("array<string>"), len(specs)
    dealt = [F.struct(F.lit(i).alias("facet"), F.array(*k).alias("keys")) for i, k in enumerate(own)]
    dealt += [F.struct(F.lit(last).alias("facet"), none.alias("keys"))] * bool(scalars)
    given = [(F.lit(1) if x is None else x).alias(f"v{i}") for i, x in enumerate(inputs)]
    rows = df.select(F.lit(True).alias("live"), *given, F.inline(F.array(*dealt)))
    if scalars:
        # metrics of no rows have a value, too: a row that nothing counts keeps their bucket
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name.startswith("v")]
        rows = rows.unionAll(df.sparkSession.range(1).select(F.lit(None).cast("boolean").alias("live"), *empty, F.lit(last).alias("facet"), none.alias("keys")))
    mine = lambda i: F.when((F.col("facet") == last) & F.col("live"), F.col(f"v{i}"))
    metrics = [(F.count(mine(i)) if s.type is Agg.COUNT and inputs[i] is None else _metric(s, mine(i))).cast("double").alias(f"m{i}") for i, s in enumerate(scalars)]
    out = rows.groupBy("facet", "keys").agg(F.count("live").alias("doc_count"), *metrics)
    many = F.lit(False)
    for i, k in enumerate(own):
        many = F.when(F.col("facet") == i, F.lit(len(k) > 1)).otherwise(many)
    key = F.when(F.col("facet") < last, F.when(many, _shown(F.col("keys"), True)).otherwise(_shown(F.col("keys"), False)))
    out = out.withColumn("bucket_key", key)
    held = having_predicate({"bucket_key": F.col("bucket_key"), "doc_count": F.col("doc_count")}, request.having, request.having_logic)
    if held is not None:
        out = out.where((F.col("facet") == last) | held)
    out = _limited(out, specs, large=windows.estimated_bytes(df) >= windows.LARGE_BYTES)
    out = out.where((F.col("facet") == last) | F.col("bucket_key").isNotNull())
    names = [F.when(F.col("facet") == i, F.struct(F.lit(s.name).alias("name"), F.lit(s.type.value).alias("type"))) for i, s in enumerate(specs)]
    bucket = F.struct(F.coalesce(*names)["name"].alias("name"), F.coalesce(*names)["type"].alias("type"), "bucket_key", "doc_count", F.lit(None).cast("double").alias("metric_val"))
    if not scalars:
        return out.select(F.inline(F.array(bucket)))
    return out.select(F.inline(F.when(F.col("facet") == last, _scalar_rows(scalars, [F.col(f"m{i}") for i in range(len(scalars))], request)).otherwise(F.array(bucket))))


def _limited(out: DataFrame, specs: list[Spec], large: bool) -> DataFrame:
    """The first buckets of each terms facet; where there can be many, parts of a facet's buckets are cut first."""
    sizes = {i: _size(s) for i, s in enumerate(specs) if s.type is Agg.TERMS}
    if not sizes:
        return out
    most = F.lit(None).cast("int")
    for i, size in sizes.items():
        most = F.when(F.col("facet") == i, F.lit(size)).otherwise(most)
    order = [F.desc("doc_count"), F.asc("bucket_key")]
    for parts in ([["facet", F.pmod(F.xxhash64("keys"), F.lit(PARTS))], ["facet"]] if large else [["facet"]]):
        out = out.withColumn("_rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).where(most.isNull() | (F.col("_rank") <= most)).drop("_rank")
    return out


def aggregate(ctx: Context, request: AggregateRequest) -> DataFrame:
    """Every facet of the request. COUNT of a field counts its distinct values, as facets do; without one, all rows."""
    if not request.specs:
        raise QueryError("one aggregation at least is required")
    for join in request.joins:
        if ctx.denied(join.right_type):
            raise QueryError(f"type '{join.right_type}' is not permitted")
    if ctx.denied(request.type):
        return ctx.frames[ctx.type(request.type).name.lower()].sparkSession.createDataFrame([], SCHEMA)
    df, scope = joined(ctx, request.type, request.joins)
    df = filtered(df, scope, request.clauses, request.logic)
    scalars = [s for s in request.specs if s.type in FUNCTIONS]
    buckets = [s for s in request.specs if s.type not in FUNCTIONS]
    if not buckets:
        return _scalars(df, scope, scalars, request)
    return _together(df, scope, buckets, scalars, request) if len(request.specs) > 1 else _bucketed(df, scope, buckets[0], request)


def total(ctx: Context, request: AggregateRequest) -> int:
    """Rows that the request's filter leaves."""
    df, scope = joined(ctx, request.type, request.joins)
    return filtered(df, scope, request.clauses, request.logic).count()
