"""Calendar buckets and truncations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..dsl import TRUNCATIONS
from ..errors import QueryError

# The text form of each bucket.
FORMATS = {"minute": "yyyy-MM-dd HH:mm", "hour": "yyyy-MM-dd HH", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def week_of_year(when: Column) -> Column:
    """Monday-based week 00 to 53, where week 1 has four days of the year at least."""
    fourth = F.make_date(F.year(when), F.lit(1), F.lit(4))
    return (F.floor(F.datediff(when, F.date_trunc("week", fourth).cast("date")) / 7) + 1).cast("int")


def bucket_key(when: Column, interval: str, time_zone: str = "UTC") -> Column:
    """The text key of a calendar bucket; an unknown interval is a month. Instants are read as UTC and shown in time_zone."""
    if time_zone and time_zone.upper() != "UTC":
        when = F.from_utc_timestamp(when.cast("timestamp"), time_zone)
    interval = (interval or "month").lower()
    if interval == "week":
        return F.concat(F.year(when), F.lit("-"), F.lpad(week_of_year(when).cast("string"), 2, "0"))
    if interval == "quarter":
        return F.concat(F.year(when), F.lit("-Q"), F.quarter(when))
    return F.date_format(when, FORMATS.get(interval, FORMATS["month"]))


def truncate(when: Column, unit: str) -> Column:
    if unit.lower() not in TRUNCATIONS:
        raise QueryError(f"'{unit}' is not a unit of time")
    return F.date_trunc(unit.lower(), when)
