"""Reads by key, and the relations of an entity nested into it."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import QueryError
from ..schema import EntityType
from .relational import Context


def _visible(ctx: Context, t: EntityType) -> DataFrame:
    """Rows and columns of a type that the caller may see; none if they are denied."""
    limit = ctx.limit(t)
    df = ctx.frames[t.name.lower()].select(*[F.col(f"`{n}`") for n in t.names])
    return df.where(F.lit(False)) if limit is None else limit.mask(limit.rows(df))


def get(ctx: Context, type_name: str, key) -> DataFrame:
    """The entity of a key, or no row; unknown types have no rows to find."""
    t = ctx.type(type_name)
    return _visible(ctx, t).where(F.col(f"`{t.key}`") == F.lit(key)).limit(1)


def get_json(ctx: Context, type_name: str, key) -> DataFrame:
    """(key, json) of an entity."""
    t = ctx.type(type_name)
    return get(ctx, type_name, key).select(F.col(f"`{t.key}`").alias("key"), F.to_json(F.struct("*")).alias("json"))


#: Keys of integer columns: what a long can hold.
INTEGER = re.compile(r"-?[0-9]{1,18}")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(column: str, literals: Iterable[str]) -> Column:
    """An IN list that is parsed at once: a call for each key would take longer than the read."""
    listed = ",".join(literals)
    return F.expr(f"{column} IN ({listed})") if listed else F.lit(False)


def get_many(ctx: Context, type_name: str, keys: Sequence) -> DataFrame:
    """(position, requested_key, found, the columns): one row for each distinct key, in the order of the request.

    Keys that differ in case only are one. A type that is not registered finds nothing, one row for each key given.
    """
    spark = next(iter(ctx.frames.values())).sparkSession
    t = ctx.registry.get(type_name)
    if t is None:
        rows = [(i, str(k), False) for i, k in enumerate(keys)]
        return spark.createDataFrame(rows, "position int, requested_key string, found boolean")
    seen: dict[str, str] = {}
    for k in keys:
        seen.setdefault(str(k).lower(), str(k))
    wanted = list(seen.values())
    asked = spark.createDataFrame(pa.table({"position": pa.array(range(len(wanted)), pa.int32()), "requested_key": pa.array(wanted, pa.string())})).coalesce(1)
    rows = _visible(ctx, t)
    own, kind = F.col(f"`{t.key}`"), rows.schema[t.key].dataType
    if isinstance(kind, T.StringType):
        # keys compare without case; most are stored in lower case or as asked, but any way of writing must be found
        on, hits = F.lower(own) == F.lower("requested_key"), rows.where(_in(f"lower(`{t.key}`)", map(_quoted, seen)))
    elif isinstance(kind, T.IntegralType):
        on, hits = own == F.col("requested_key").cast(kind), rows.where(_in(f"`{t.key}`", (f"{k}L" for k in wanted if INTEGER.fullmatch(k))))
    else:
        on, hits = own == F.col("requested_key").cast(kind), rows.where(own.isin([F.lit(k).cast(kind) for k in wanted]))
    if not t.unique:
        hits = hits.groupBy(own.alias("_key")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("_row")).select("_row.*")
    # one row a key, so there are at most as many hits as keys in the request; the filter reaches the scan
    return asked.join(F.broadcast(hits), on, "left").select("position", "requested_key", own.isNotNull().alias("found"), *rows.columns).orderBy("position")


def by_foreign_key(ctx: Context, type_name: str, column: str, value) -> DataFrame:
    """Entities whose column holds a value."""
    t = ctx.type(type_name)
    own = t.column(column)
    if own is None:
        raise QueryError(f"'{column}' is not a column of {t.name}")
    return _visible(ctx, t).where(F.col(f"`{own.name}`") == F.lit(value))


def _of_rows(ctx: Context, t: EntityType, r, target: EntityType, rows: DataFrame | None) -> DataFrame | None:
    """The related rows of given rows, before anything is nested into them; None for all."""
    if rows is None:
        return None
    own, other = {"one_to_many": (t.key, r.key)}.get(r.kind, (r.key, target.key))
    wanted = rows.select((F.explode(rows[own]) if r.kind == "many_to_many" else rows[own]).alias("_wanted"))
    related = _visible(ctx, target)
    return related.join(wanted, related[other] == F.col("_wanted"), "left_semi")


def with_relations(ctx: Context, type_name: str, rows: DataFrame | None = None, depth: int = 1) -> DataFrame:
    """rows (all that are visible, if None) with each relation nested under its name, depth levels deep.

    To-one relations are a struct or null; to-many ones an array: in the order of the ids on this row (many_to_many,
    missing ones left out) or by key (one_to_many). A whole set of rows is resolved by one join for each relation.
    """
    t = ctx.type(type_name)
    out = _visible(ctx, t) if rows is None else rows
    if depth <= 0:
        return out
    for r in t.relations:
        target = ctx.registry.get(r.target)
        if target is None or ctx.limit(target) is None:
            continue
        related = with_relations(ctx, r.target, _of_rows(ctx, t, r, target, rows), depth - 1)
        packed = F.struct(*[F.col(f"`{c}`") for c in related.columns])
        if r.kind in ("many_to_one", "one_to_one"):
            other = related.select(F.col(f"`{target.key}`").alias("_key"), packed.alias(r.name))
            out = out.join(other, out[r.key] == F.col("_key"), "left").drop("_key")
        elif r.kind == "one_to_many":
            other = related.groupBy(F.col(f"`{r.key}`").alias("_key")).agg(F.array_sort(F.collect_list(F.struct(F.col(f"`{target.key}`").alias("_order"), packed.alias("_row")))).alias("_rows"))
            other = other.select("_key", F.transform("_rows", lambda x: x["_row"]).alias(r.name))
            out = out.join(other, out[t.key] == F.col("_key"), "left").drop("_key")
        else:
            ids = out.select(F.col(f"`{t.key}`").alias("_own"), F.posexplode(F.array_distinct(out[r.key])).alias("_at", "_id"))
            other = ids.join(related.select(F.col(f"`{target.key}`").alias("_key"), packed.alias("_row")), F.col("_id") == F.col("_key"))
            other = other.groupBy("_own").agg(F.array_sort(F.collect_list(F.struct("_at", "_row"))).alias("_rows")).select("_own", F.transform("_rows", lambda x: x["_row"]).alias(r.name))
            out = out.join(other, out[t.key] == F.col("_own"), "left").drop("_own")
    return out
