"""The rows in which two large, mostly equal tables differ.

Each table is summed to one row per bucket of keys: its number of rows and two sums of 64-bit row hashes. Only rows
of buckets whose sums differ are shuffled and compared, so two equal tables cost a scan of each and a few thousand rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.operators.skew import lookup_join
from rosterlake.session import written

BUCKETS = 4096


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_sums(df: DataFrame, keys: list[str], values: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(_bucket, _rows, _sum, _sum_2). Hashes pass over nulls, so which columns are null is hashed as well."""
    row = [*keys, *values, F.concat(*[F.isnull(c).cast("string") for c in [*keys, *values]])]
    exact = "decimal(38,0)"  # a sum of longs that cannot overflow
    return df.groupBy(_bucket(keys, buckets).alias("_bucket")).agg(
        F.count("*").alias("_rows"),
        F.sum(F.xxhash64(*row).cast(exact)).alias("_sum"),
        F.sum(F.xxhash64(F.lit(1), *row).cast(exact)).alias("_sum_2"),
    )


def unequal_buckets(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(_bucket) of buckets whose sums differ; at most as many rows as there are buckets."""
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("_rows", "_sum", "_sum_2")]
    sums = [bucket_sums(df, keys, values, buckets) for df in (left, right)]
    both = sums[0].alias("l").join(sums[1].alias("r"), F.col("l._bucket") == F.col("r._bucket"), "full")
    return both.filter(~(same[0] & same[1] & same[2])).select(F.coalesce("l._bucket", "r._bucket").alias("_bucket"))


def differing(left: DataFrame, right: DataFrame, keys: list[str], *, buckets: int = BUCKETS) -> DataFrame:
    """The keys, structs left and right of the other columns, and in_left, in_right, where the two differ.

    Both tables have the same columns, in any order. Keys are unique in each; rows of a repeated key are paired
    with one another. A key may be null. Each table is read twice, and only unequal buckets are shuffled. Two different
    buckets are taken for equal with a probability of about 2^-128.
    """
    values = [c for c in left.columns if c not in keys]
    if set(right.columns) != set(left.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    unequal = written(unequal_buckets(left, right, keys, values, buckets), "unequal-buckets")

    def side(df: DataFrame, name: str) -> DataFrame:
        kept = lookup_join(df.withColumn("_bucket", _bucket(keys, buckets)), unequal, ["_bucket"], "left_semi")
        return kept.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.struct(*values).alias(name), F.lit(True).alias(f"in_{name}"))

    match = None
    for k in keys:
        same = F.col(f"_left_{k}").eqNullSafe(F.col(f"_right_{k}"))
        match = same if match is None else match & same
    both = side(left, "left").join(side(right, "right"), match, "full")
    return both.filter(~F.col("left").eqNullSafe(F.col("right"))).select(
        *[F.coalesce(f"_left_{k}", f"_right_{k}").alias(k) for k in keys],
        "left",
        "right",
        *[F.coalesce(f"in_{name}", F.lit(False)).alias(f"in_{name}") for name in ("left", "right")],
    )
