"""Pay rates, flags and numeric clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Working days in a month and hours in a day.
WORKING_DAYS = 22
WORKING_HOURS = 8


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even; F.round rounds half away from zero."""
    return F.bround(value, digits)


def daily_rate(income: Column) -> Column:
    return F.greatest(F.lit(1), half_even(income / WORKING_DAYS).cast("int"))


def hourly_rate(income: Column) -> Column:
    return F.greatest(F.lit(1), half_even(daily_rate(income) / WORKING_HOURS).cast("int"))


def monthly_rate(income: Column) -> Column:
    return half_even(income).cast("int")


def whole_or(text: Column, default: int) -> Column:
    """A whole number, or the default where the value cannot be read as a number."""
    number = text.try_cast("double")
    # NaN compares as larger than any number, so it takes the default like an overflow.
    return F.coalesce(F.when(F.abs(number) <= 2_147_483_647, number), F.lit(default)).cast("int")


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.lit(100.0) * part / whole, digits)


def is_high_performer(rating: Column) -> Column:
    return rating >= 4


def is_active(status: Column) -> Column:
    return status == "Active"


def closed_end(status: Column, end: Column) -> Column:
    """An end date only counts for projects that are Completed or On Hold."""
    return F.when(status.isin("Completed", "On Hold"), end)


def allocation_share(employee_id: Column) -> Column:
    """1.00, 0.75 or 0.50 by the remainder of the id."""
    bucket = F.pmod(employee_id, F.lit(3))
    return (
        F.when(bucket == 0, F.lit(1.00)).when(bucket == 1, F.lit(0.75)).otherwise(F.lit(0.50)).cast("decimal(5,2)")
    )
