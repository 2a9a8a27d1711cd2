"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(day: Column) -> Column:
    """yyyymmdd as a whole number."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def is_weekend(day: Column) -> Column:
    """1 on Saturday and Sunday, else 0."""
    return F.when(F.dayofweek(day).isin(1, 7), 1).otherwise(0)


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMMM")


def valid_on(day: Column, start: Column, end: Column) -> Column:
    """Closed interval on both sides; a NULL end is unbounded."""
    return (day >= start) & (end.isNull() | (day <= end))
