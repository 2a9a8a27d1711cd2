"""Rating trends that are kept up to date: sums that each batch of facts adds to, and that reports read.

A batch becomes at most one row per (year, quarter, department), in a partition of its own. A batch that is run
again replaces its partition by Spark's dynamic partition overwrite, so it counts once; it must hold the same rows,
as the batches of a stream do. Facts taken back are given as withdrawn and subtract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.operators.skew import lookup_join
from rosterlake.plans import analytics

PERIOD = ["year", "quarter", "department_sk"]
SUMS = ["reviews", "rated", "rating_sum"]
_STORED = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("quarter", T.IntegerType()),
        T.StructField("department_sk", T.LongType()),
        *[T.StructField(c, T.LongType()) for c in SUMS],
        T.StructField("batch_id", T.LongType()),
    ]
)


class KeptRatings:
    """The sums below one folder. One job writes to it at a time."""

    def __init__(self, spark: SparkSession, path: str, dim_date: DataFrame):
        self.spark, self.path = spark, path
        self._dates = dim_date.select("date_sk", "year", "quarter")

    def add(self, facts: DataFrame, batch_id: int, withdrawn: DataFrame | None = None) -> None:
        """Add a batch of facts. Facts are summed by day before they meet the calendar."""
        sums = self._summed(facts)
        if withdrawn is not None:
            sums = sums.unionByName(self._summed(withdrawn).select(*PERIOD, *[(-F.col(c)).alias(c) for c in SUMS]))
        batch = sums.groupBy(*PERIOD).agg(*[F.sum(c).alias(c) for c in SUMS]).withColumn("batch_id", F.lit(batch_id).cast("long"))
        # One file a batch: its rows are as few as the periods and departments.
        batch.select(*[F.col(f.name).cast(f.dataType) for f in _STORED]).coalesce(1).write.partitionBy("batch_id").mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def _summed(self, facts: DataFrame) -> DataFrame:
        totals = analytics.rating_totals(facts, ["date_sk", "department_sk"])
        dated = lookup_join(totals, self._dates, ["date_sk"], measure=totals)
        return dated.groupBy(*PERIOD).agg(*[F.sum(c).alias(c) for c in SUMS])

    def totals(self) -> DataFrame:
        """One row per period and department with facts; those of which all were withdrawn are left out."""
        stored = self.spark.read.schema(_STORED).parquet(self.path)
        return stored.groupBy(*PERIOD).agg(*[F.sum(c).alias(c) for c in SUMS]).filter("reviews <> 0")

    def yearly_trend(self, dim_department: DataFrame) -> DataFrame:
        return analytics.yearly_trend_of(self.totals(), dim_department)

    def yearly_change(self) -> DataFrame:
        return analytics.yearly_change_of(self.totals())

    def quarterly_trend(self) -> DataFrame:
        return analytics.quarterly_trend_of(self.totals())
