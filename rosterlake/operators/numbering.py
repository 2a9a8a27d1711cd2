"""Dense row numbers over tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.session import written

# A table of at most this many rows may be numbered by a single task.
LOOKUP_ROWS = 100_000


def number_rows(
    df: DataFrame, order_by: list[str | Column], name: str, start: int = 1, *, costly: bool = False
) -> DataFrame:
    """Add start, start+1, … in the given order, without sorting the table in one task.

    The rows are range-partitioned and sorted, and written once together with their slice and
    their place in it: a range partitioning samples its input, so slices computed twice need not
    agree. One total per slice then gives each slice its first number. Those totals are as many
    as there are slices, so their window and their broadcast stay small.

    order_by must tell all rows apart for the numbers to be reproducible. Sampling computes df
    once more; for a costly one (joins of large tables) it is written before.
    """
    columns = df.columns
    if costly:
        df = written(df, "unnumbered")
    laid_out = written(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        laid_out.groupBy("_slice")
        .agg(F.count("*").alias("_rows"))
        .select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    )
    return laid_out.join(F.broadcast(firsts), "_slice").select(
        *columns, (F.lit(start) + F.col("_first") + F.col("_place")).alias(name)
    )


def number_lookup(
    df: DataFrame, order_by: list[str | Column], name: str, start: int = 1, window_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """number_rows for a table expected to be small: counted first, and numbered by one window
    only when it has at most window_rows rows."""
    if df.count() > window_rows:
        return number_rows(df, order_by, name, start)
    place = F.row_number().over(Window.orderBy(*order_by)).cast("long")
    return df.withColumn(name, place + F.lit(start - 1))


def next_key(df: DataFrame, key: str) -> int:
    """One more than the highest key in the table, or 1 when it is empty."""
    return df.agg(F.coalesce(F.max(key), F.lit(0)) + 1).first()[0]


def first_n(df: DataFrame, order_by: list[str | Column], n: int) -> DataFrame:
    """Exactly the first n rows in the given order; n may be a large share of the table.

    Only the ordering columns are numbered and written; the n-th of them then filters the table. Where
    expressions order the rows, or the n-th values occur twice, the rows themselves are numbered.
    """
    if n <= 0:
        return df.limit(0)
    if all(isinstance(c, str) for c in order_by):
        last = number_rows(df.select(*order_by), order_by, "_position").filter(F.col("_position") == n).first()
        if last is None:
            return df
        row = F.struct(*order_by)
        bound = F.struct(*[F.lit(last[c]).cast(df.schema[c].dataType).alias(c) for c in order_by])
        if df.filter(row == bound).limit(2).count() == 1:
            return df.filter(row <= bound)
    return number_rows(df, order_by, "_position").filter(F.col("_position") <= n).drop("_position")
