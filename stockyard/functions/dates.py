"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_key(d: Column | str) -> Column:
    """Date -> integer key YYYYMMDD (portable arithmetic form)."""
    d = _c(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


DATE_PARTS = ("TimeKey", "Date", "Year", "Quarter", "Month", "Week", "Day")


def date_parts(d: Column | str) -> list[Column]:
    """TimeKey, Date, Year, Quarter, Month, ISO Week, Day - the time dimension columns."""
    d = _c(d)
    return [
        time_key(d).alias("TimeKey"),
        d.alias("Date"),
        F.year(d).cast("int").alias("Year"),
        F.quarter(d).cast("int").alias("Quarter"),
        F.month(d).cast("int").alias("Month"),
        F.weekofyear(d).cast("int").alias("Week"),
        F.dayofmonth(d).cast("int").alias("Day"),
    ]
