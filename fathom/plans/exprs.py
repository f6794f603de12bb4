"""The expression language of metrics and derived columns: arithmetic over columns and a few functions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..errors import QueryError

TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
# Words that an expression may use beside columns, and signs that it may not.
WORDS = {"SUM", "AVG", "MIN", "MAX", "COUNT", "OVER", "PARTITION", "BY", "ORDER", "ASC", "DESC", "COALESCE", "NULLIF", "ROUND", "ABS", "AND", "OR", "NOT", "NULL"}
FORBIDDEN = (";", "'", "`", '"', "--", "/*", "*/")


def validate(text: str, names: Iterable[str], what: str) -> None:
    """Raise QueryError unless every word is a column or a known function and no forbidden sign is in the text."""
    for sign in FORBIDDEN:
        if sign in text:
            raise QueryError(f"{what} has the forbidden sign {sign}")
    known = {n.lower() for n in names}
    for token in TOKEN.findall(text):
        if token.upper() not in WORDS and token.lower() not in known:
            raise QueryError(f"{what} refers to '{token}', neither a column nor a known function")


def expression(text: str, names: Iterable[str], what: str, qualify=None) -> Column:
    """A validated text as a Column; qualify(name) gives the name to use for a column."""
    names = list(names)
    validate(text, names, what)
    if qualify:
        known = {n.lower() for n in names}
        text = TOKEN.sub(lambda m: qualify(m[0]) if m[0].lower() in known and m[0].upper() not in WORDS else m[0], text)
    return F.expr(text)
