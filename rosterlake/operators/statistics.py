"""Row counts and highest keys that are observed while a table is written, and read instead of the table.

The figures of a table are one row in a folder beside it. They are observed in the very stage that writes
the files, where Spark counts each task once, however often executors are lost. They hold for the table as it
was written: whoever adds files to it by other means has to write it anew, and differs() tells whether
somebody has not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIGURES = T.StructType(
    [
        T.StructField("row_count", T.LongType()),
        T.StructField("highest", T.MapType(T.StringType(), T.LongType())),
    ]
)


def whole_number_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns whose highest value can be a next key."""
    return [c for c in columns if isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType))]


def write_measured(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Write df and its figures; return the written table. Keys are whole-number columns."""
    spark = df.sparkSession
    seen = Observation()
    highest = [F.max(k).cast("long").alias(f"highest_{k}") for k in keys]
    df.observe(seen, F.count(F.lit(1)).alias("row_count"), *highest).write.parquet(path)
    found = seen.get
    row = (found.get("row_count") or 0, {k: found.get(f"highest_{k}") for k in keys})
    spark.createDataFrame([row], FIGURES).coalesce(1).write.parquet(_beside(path))
    return spark.read.schema(df.schema).parquet(path)


def figures(spark: SparkSession, path: str) -> DataFrame:
    """The one row of figures of a table that write_measured() wrote."""
    return spark.read.schema(FIGURES).parquet(_beside(path))


def next_key(figures: DataFrame, key: str) -> int:
    """One more than the highest key when the table was written, or 1 when it was empty."""
    row = figures.first()
    if key not in row.highest:
        raise ValueError(f"no highest {key} was kept")
    return (row.highest[key] or 0) + 1


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table with a status, from the figures of each."""
    out = None
    for name, one in tables.items():
        status = F.when(F.col("row_count") > 0, "loaded").otherwise("empty")
        line = one.select(F.lit(name).alias("table_name"), "row_count", status.alias("status"))
        out = line if out is None else out.unionByName(line)
    return out


def differs(df: DataFrame, figures: DataFrame) -> DataFrame:
    """What the kept figures say and what the table holds, where the two differ: (figure, kept, found).

    Counts the table, so it is for an audit and not for every report. A key column is named by itself.
    """
    keys = list(figures.first().highest)
    names = F.array(F.lit("row_count"), *[F.lit(k) for k in keys])
    now = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.max(k).cast("long").alias(f"highest_{k}") for k in keys])
    found = F.map_from_arrays(names, F.array("row_count", *[F.col(f"highest_{k}") for k in keys]))
    kept = F.map_from_arrays(names, F.array("row_count", *[F.col("highest")[k] for k in keys]))
    both = figures.select(F.explode(kept).alias("figure", "kept")).join(now.select(F.explode(found).alias("figure", "found")), "figure")
    return both.filter(~F.col("kept").eqNullSafe(F.col("found")))


def _beside(path: str) -> str:
    return f"{path}-figures"
