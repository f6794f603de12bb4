"""Window functions over a whole table, without one task that holds all rows.

A window with a partition is Spark's own. One without is plain as well while the table is small; a large table is cut
into ranges of the order's key: each range is numbered or summed by itself, and the sums of the ranges before it, one row a
range, are added. Rows with equal keys are in one range, so ties come out as in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from ..dsl import Window
from .writes import fresh

#: Estimated bytes of a table from which it is cut into ranges, and their number.
LARGE_BYTES, RANGES = 256 << 20, 256
#: Functions that ranges can be put together for; the others look at single rows beside them.
BY_RANGE = {Window.ROW_NUMBER, Window.RANK, Window.DENSE_RANK, Window.RUNNING_SUM, Window.RUNNING_AVG}
NEEDS_FIELD = {Window.RUNNING_SUM, Window.RUNNING_AVG, Window.LAG, Window.LEAD}


RANKS = {Window.ROW_NUMBER: F.row_number, Window.RANK: F.rank, Window.DENSE_RANK: F.dense_rank}
SUMS = {Window.RUNNING_SUM: F.sum, Window.RUNNING_AVG: F.avg}
NEIGHBOURS = {Window.LAG: F.lag, Window.LEAD: F.lead}


def function(kind: Window, own: Column | None, offset: int) -> Column:
    if kind in RANKS:
        return RANKS[kind]()
    return SUMS[kind](own) if kind in SUMS else NEIGHBOURS[kind](own, max(1, offset))


def estimated_bytes(df: DataFrame) -> int:
    """What the planner takes the table's size to be; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ordinal(df: DataFrame, key: str) -> Column | None:
    """A number that never falls where the key rises; None for types without one."""
    kind, own = df.schema[key].dataType, F.col(f"`{key}`")
    if isinstance(kind, T.NumericType):
        return own.cast("double")
    if isinstance(kind, T.DateType):
        return F.datediff(own, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(kind, T.TimestampType):
        return own.cast("double")
    if isinstance(kind, T.StringType):
        # the first bytes as one number
        return F.conv(F.substring(F.rpad(F.hex(F.encode(F.substring(own, 1, 6), "UTF-8")), 12, "0"), 1, 12), 16, 10).cast("double")
    return None


def over_ranges(df: DataFrame, kind: Window, alias: str, key: str, descending: bool, field: str | None, ranges: int = RANGES) -> DataFrame | None:
    """df with a window function over all its rows in the order of a key, range by range; None if the key cannot be cut."""
    number = ordinal(df, key)
    if number is None:
        return None
    cuts = df.agg(F.percentile_approx(number, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    place, start, got = (fresh(df, n) for n in ("_range", "_start", "_local"))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= number)) if cuts else F.lit(0)
    # NULL is the least value
    at = F.when(number.isNull(), F.lit(-1)).otherwise(at)
    cut = df.withColumn(place, (-at if descending else at).cast("int"))
    order = F.col(f"`{key}`").desc() if descending else F.col(f"`{key}`").asc()
    inside = W.partitionBy(place).orderBy(order)
    own = F.col(f"`{field}`") if field else None
    totals = {
        Window.ROW_NUMBER: [F.count("*")], Window.RANK: [F.count("*")],
        Window.DENSE_RANK: [F.count_distinct(F.col(f"`{key}`")) + F.max(F.col(f"`{key}`").isNull().cast("long"))],
        Window.RUNNING_SUM: [F.sum(own)] if field else [], Window.RUNNING_AVG: [F.sum(own), F.count(own)] if field else [],
    }[kind]
    before = W.orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy(place).agg(*[t.alias(f"{start}{i}") for i, t in enumerate(totals)])
    # at most one row a range
    sums = sums.select(F.col(place).alias(f"{place}_"), *[F.sum(f"{start}{i}").over(before).alias(f"{start}{i}") for i in range(len(totals))])
    out = cut
    if kind is Window.RUNNING_AVG:
        out = out.withColumn(f"{got}0", F.sum(own).over(inside)).withColumn(f"{got}1", F.count(own).over(inside))
    else:
        out = out.withColumn(f"{got}0", function(kind, own, 1).over(inside))
    out = out.join(F.broadcast(sums), F.col(place) == F.col(f"{place}_"))
    added = [F.coalesce(F.col(f"{got}{i}") + F.col(f"{start}{i}"), F.col(f"{got}{i}"), F.col(f"{start}{i}")) for i in range(len(totals))]
    if kind is Window.RUNNING_AVG:
        value = F.when(added[1] > 0, added[0].cast("double") / added[1])
    else:
        value = added[0] if kind is Window.RUNNING_SUM else added[0].cast("int")
    return out.withColumn(alias, value).select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{alias}`"))


def add(df: DataFrame, kind: Window, alias: str, key: str, descending: bool, field: str | None, partition_by: str | None, offset: int, large: int | None = None) -> DataFrame:
    """df with one more column."""
    if not partition_by and kind in BY_RANGE and estimated_bytes(df) >= (LARGE_BYTES if large is None else large):
        found = over_ranges(df, kind, alias, key, descending, field)
        if found is not None:
            return found
    order = F.col(f"`{key}`").desc() if descending else F.col(f"`{key}`").asc()
    # no frame is given: with an order it runs to the current row and its ties
    over = (W.partitionBy(F.col(f"`{partition_by}`")) if partition_by else W.partitionBy()).orderBy(order)
    return df.withColumn(alias, function(kind, F.col(f"`{field}`") if field else None, offset).over(over))
