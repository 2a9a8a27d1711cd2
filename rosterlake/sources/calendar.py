"""Day series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def days_of(df: DataFrame, day: str) -> DataFrame:
    """Every day from the earliest to the latest date in a column, gaps included."""
    bounds = df.filter(F.col(day).isNotNull()).agg(F.min(day).alias("low"), F.max(day).alias("high"))
    series = F.sequence("low", "high", F.expr("interval 1 day"))
    return bounds.filter(F.col("low").isNotNull()).select(F.explode(series).alias("full_date"))


def days_between(spark: SparkSession, low: dt.date, high: dt.date) -> DataFrame:
    series = F.sequence(F.lit(low), F.lit(high), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(series).alias("full_date"))
