"""Filter clauses to Column predicates, in the SQL flavour and in the two-valued payload flavour."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from ..dsl import Clause, Op
from ..errors import QueryError

LIKE = {Op.CONTAINS: "%{}%", Op.STARTS_WITH: "{}%", Op.ENDS_WITH: "%{}"}
COMPARE = {
    Op.EQUALS: lambda c, v: c == v,
    Op.NOT_EQUALS: lambda c, v: c != v,
    Op.GREATER_THAN: lambda c, v: c > v,
    Op.LESS_THAN: lambda c, v: c < v,
    Op.GREATER_THAN_OR_EQUALS: lambda c, v: c >= v,
    Op.LESS_THAN_OR_EQUALS: lambda c, v: c <= v,
}


#: Bits of the integer types, sign included.
INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
PLAIN_INTEGER = re.compile(r"0|-?[1-9][0-9]*")


def literal(value, kind: T.DataType | None = None) -> Column:
    """Times travel as ISO text, numbers as doubles, the rest as it is.

    A whole number that the column's integer type can hold is of that type, so that the comparison reaches the scan; one
    that it cannot hold, and any fraction, is compared as a double.
    """
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return F.lit(value)
    if isinstance(value, (int, float)):
        if isinstance(value, int) or value.is_integer():
            whole = int(value)
            if _fits(whole, kind):
                return F.lit(whole).cast(kind)
        return F.lit(float(value)) if isinstance(value, float) or abs(value) < 1 << 53 else F.lit(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return F.lit(value.isoformat())
    raise QueryError(f"a value of type {type(value).__name__} cannot be compared")


def _fits(value: int, kind: T.DataType | None) -> bool:
    bits = INTEGERS.get(type(kind))
    return bits is not None and -(1 << bits - 1) <= value < 1 << bits - 1


def _one_of(column: Column, values: Sequence, kind: T.DataType | None) -> Column:
    """Equality by text. A number equals its plain text only, so texts that are none of an integer's are left out."""
    texts = [v if isinstance(v, str) else str(v) for v in values]
    if type(kind) not in INTEGERS:
        return column.isin(texts)
    whole = [int(t) for t in texts if PLAIN_INTEGER.fullmatch(t) and _fits(int(t), kind)]
    return column.isin([F.lit(w).cast(kind) for w in whole]) if whole else F.when(column.isNotNull(), F.lit(False))


def condition(column: Column, op: Op, value, kind: T.DataType | None = None) -> Column | None:
    """The predicate of one clause; None if the clause says nothing (IN without a list). kind: the column's type, if it is known."""
    if op is Op.VECTOR_SIMILAR:
        raise QueryError("VECTOR_SIMILAR is not a filter of relational queries")
    if op in LIKE:
        # % and _ inside the value are wildcards, as everywhere in this language; a value that is no string is empty
        return column.like(LIKE[op].format(value if isinstance(value, str) else ""))
    if op is Op.IN:
        if not isinstance(value, (list, tuple)) or not value:
            return None
        return _one_of(column, value, kind)
    if isinstance(value, (list, tuple)):
        raise QueryError(f"{op.name} takes one value")
    return COMPARE[op](column, literal(value, kind))


def combine(found: Sequence[Column], any_of: bool) -> Column | None:
    return reduce(Column.__or__ if any_of else Column.__and__, found) if found else None


def where(clauses: Sequence[Clause], any_of: bool, resolve: Callable[[str], Column | None], kind_of: Callable[[str], T.DataType | None] = lambda name: None) -> Column | None:
    """All clauses as one predicate. What does not resolve is left out; MUST_NOT is SQL's NOT, so NULL never passes."""
    found = []
    for clause in clauses:
        column = resolve(clause.field)
        if column is None:
            if clause.op is Op.VECTOR_SIMILAR:
                raise QueryError("VECTOR_SIMILAR is not a filter of relational queries")
            continue
        one = condition(column, clause.op, clause.value, kind_of(clause.field))
        if one is not None:
            found.append(~one if clause.negated else one)
    return combine(found, any_of)


def payload(clauses: Sequence[Clause], any_of: bool, resolve: Callable[[str], Column | None]) -> Column | None:
    """The filter of vector searches: negation is two-valued, so a missing field passes it; LIKE is rejected."""
    found = []
    for clause in clauses:
        column = resolve(clause.field)
        if column is None:
            raise QueryError(f"'{clause.field}' is not a filterable property")
        op, value = clause.op, clause.value
        if op in LIKE or op is Op.VECTOR_SIMILAR:
            raise QueryError(f"{op.name} is not supported in vector searches")
        negated = clause.negated != (op is Op.NOT_EQUALS)
        if op in (Op.EQUALS, Op.NOT_EQUALS):
            if isinstance(value, float) and not isinstance(value, bool):
                value = round(value)
            one = column == literal(value)
        elif op is Op.IN:
            if not isinstance(value, (list, tuple)):
                raise QueryError("IN takes a list of strings")
            one = column.cast("string").isin([str(v) for v in value])
        else:
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise QueryError(f"{op.name} needs a number")
            one = COMPARE[op](column, F.lit(float(value)))
        one = F.coalesce(one, F.lit(False))
        found.append(~one if negated else one)
    return combine(found, any_of)
