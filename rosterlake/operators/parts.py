"""Tables in parts by a hash of their keys, of which a change rewrites only the parts that it touches.

The parts are ordinary partition folders, and Spark's dynamic partition overwrite replaces them: new files are staged
and moved in when the job commits, so a job that fails before that leaves the table as it was. Moving several parts is not
one step; after a failure in it the same change is applied again, which changes nothing in the parts already moved
as long as the change is a keyed update. One job writes to a table at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.operators.versions import update_rows
from rosterlake.session import written

# A part should be what one task can rewrite; larger tables take more parts.
PARTS = 200


class PartedTable:
    """Rows of a schema below a path, in parts by the hash of some of its columns, which may be null."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], parts: int = PARTS):
        self.spark, self.path, self.schema, self.keys, self.parts = spark, path, schema, keys, parts

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def create(self, df: DataFrame) -> None:
        """Write all rows; the path must be new."""
        self._laid_out(df).write.partitionBy("part").parquet(self.path)

    def rows(self) -> DataFrame:
        return self._read().drop("part")

    def touched(self, changes: DataFrame) -> DataFrame:
        """The rows of the parts that the keys of changes fall into. Only those parts are read."""
        # At most as many numbers as there are parts, for a filter that prunes folders when the scan is planned.
        numbers = changes.agg(F.collect_set(self.part())).first()[0]
        return self._read().filter(F.col("part").isin(numbers)).drop("part")

    def rewrite(self, changes: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows of the touched parts by what change makes of them.

        change may alter and add rows, but keeps the keys that decide a row's part, and at least one row in each part.
        """
        self.replace(change(self.touched(changes)))

    def replace(self, whole_parts: DataFrame) -> None:
        """Put these rows in place of the stored ones of the same parts, of which they are all; other parts stay."""
        overwrite = self._laid_out(whole_parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        overwrite.partitionBy("part").parquet(self.path)

    def update(self, changes: DataFrame) -> None:
        """Keyed update, as update_rows: changes has the keys, each once, and columns to replace, NULLs included."""
        kept = written(changes, "part-changes")
        self.rewrite(kept, lambda rows: update_rows(rows, kept, self.keys))

    def _read(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])).parquet(self.path)

    def _laid_out(self, df: DataFrame) -> DataFrame:
        return df.select(*self.schema.names).withColumn("part", self.part()).repartition("part")
