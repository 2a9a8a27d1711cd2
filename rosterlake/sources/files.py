"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; column types are inferred."""
    return spark.read.csv(path, header=True, inferSchema=True)


def load_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header into declared columns; a malformed row fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("quote", '"').csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    # Blanks around values belong to the data; the writer would strip them by default.
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, **keep).csv(path)


def read_query(spark: SparkSession, url: str, query: str, *, column: str, low: str, high: str, parts: int, **options: str) -> DataFrame:
    """The result of a query that a database runs (JDBC), read by `parts` connections.

    The query is cut into ranges of a column between two bounds, which are asked for, because without
    them the whole result would come through one connection into one task. Rows beyond the bounds are
    in the first and the last part.
    """
    ranges = {"partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **ranges, **options).load()


def run_query(spark: SparkSession, sql: str, params: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Run SQL over DataFrames named in braces, with :name parameters bound as values."""
    return spark.sql(sql, args=params or {}, **tables)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def refresh(df: DataFrame, folder: str) -> str:
    """Write a full new copy of a table below its folder, and return the copy's path.

    Copies are numbered. Readers of current() see the old one until the new one is complete, so a
    failed job loses nothing and df may read the table it replaces.
    """
    copies = _copies(df.sparkSession, folder)
    path = f"{folder}/copy={(copies[-1] if copies else 0) + 1}"
    df.write.mode("overwrite").parquet(path)
    return path


def current(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The newest complete copy of a table that refresh() writes."""
    return spark.read.schema(schema).parquet(f"{folder}/copy={_copies(spark, folder)[-1]}")


def _copies(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete copies: Spark marks a finished job in the folder it has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/copy=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found or [])


def preview(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def add_columns(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Add the declared columns that are missing, filled with NULL."""
    missing = [f for f in fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def describe_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table and column: position, type, rows and non-NULL values."""
    out = None
    for name, df in tables.items():
        fields = df.schema.fields
        facts = F.array(
            *[
                F.struct(
                    F.lit(name).alias("table_name"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(i).cast("long").alias("ordinal"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    F.col("_n_rows").alias("n_rows"),
                    F.col(f"_v_{i}").alias("n_values"),
                )
                for i, f in enumerate(fields, 1)
            ]
        )
        counts = df.agg(
            F.count("*").alias("_n_rows"), *[F.count(F.col(f.name)).alias(f"_v_{i}") for i, f in enumerate(fields, 1)]
        )
        rows = counts.select(F.explode(facts).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out
