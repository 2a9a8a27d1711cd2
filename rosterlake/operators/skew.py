"""Joins and group attributes that stay balanced when one key holds much of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.session import written


@dataclass(frozen=True)
class SkewPolicy:
    """A key is hot above `rows` rows, whatever the size of its table; it is split into parts of that size."""

    rows: int = 1_000_000


DEFAULT = SkewPolicy()

# A lookup of at most this many rows, and of about so many bytes, is sent to every executor whole.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> int:
    """What a row takes in memory, roughly: 8 bytes a column, and 64 for text and nested values."""
    fixed = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp"}
    return sum(8 if kind in fixed or kind.startswith("decimal") else 64 for _, kind in df.dtypes)


def fits_broadcast(df: DataFrame, rows: int, most_rows: int = BROADCAST_ROWS) -> bool:
    return rows <= most_rows and rows * row_bytes(df) <= BROADCAST_BYTES


def hot_keys(df: DataFrame, keys: list[str], policy: SkewPolicy = DEFAULT) -> DataFrame | None:
    """The hot keys with the number of parts to split each into, or None when there are none.

    Counting combines on the map side, so a hot key costs one row per task here. The list is a
    written table: it grows with the table's size over policy.rows.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > policy.rows)
    hot = written(counts.select(*keys, F.ceil(F.col("_rows") / F.lit(policy.rows)).cast("int").alias("_parts")), "hot-keys")
    return None if hot.isEmpty() else hot


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    *,
    condition: Column | None = None,
    null_safe: bool = False,
    spread_by: list[str] | None = None,
    measure: DataFrame | None = None,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """Equi-join on keys (inner, left, left_semi or left_anti), split where the left side is hot.

    A hot key's left rows are dealt into parts by a hash of spread_by (their identifying columns),
    and the right rows of that key alone are repeated once per part. Other keys are joined as they
    are. Hot keys are looked for in `measure`, a cheaper table with the same keys (say, the written
    table that left is derived from), or else in left. `condition` may use any column of either
    side. With null_safe, NULL keys equal each other.
    """
    hot = hot_keys(left if measure is None else measure, keys, policy)
    on = list(keys)
    if hot is not None:
        deal = F.xxhash64(*[F.col(c) for c in (spread_by or left.columns)])
        left = (
            _with_parts(left, hot, keys)
            .withColumn("_part", F.coalesce(F.pmod(deal, F.col("_parts").cast("long")), F.lit(0)).cast("int"))
            .drop("_parts")
        )
        right = (
            _with_parts(right, hot, keys)
            .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0)))))
            .drop("_parts")
        )
        on.append("_part")
    if condition is None and not null_safe:
        return left.join(right, on, how).drop("_part")
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns])
    match = condition
    for c in on:
        here, there = F.col(c), F.col(f"_r_{c}")
        same = here.eqNullSafe(there) if null_safe else here == there
        match = same if match is None else match & same
    return left.join(renamed, match, how).drop(*[f"_r_{c}" for c in on], "_part")


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "inner",
    *,
    spread_by: list[str] | None = None,
    measure: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """Join to a table expected to be small: counted first, broadcast only when it really is.

    A lookup with more rows than broadcast_rows goes through skew_join instead.
    """
    if fits_broadcast(lookup, lookup.count(), broadcast_rows):
        return left.join(F.broadcast(lookup), keys, how)
    return skew_join(left, lookup, keys, how, spread_by=spread_by, measure=measure, policy=policy)


def _with_parts(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    names = {c: f"_hot_{c}" for c in keys}
    listed = hot.select(*[F.col(c).alias(n) for c, n in names.items()], "_parts")
    same = None
    for c, n in names.items():
        test = F.col(c).eqNullSafe(F.col(n))
        same = test if same is None else same & test
    small = fits_broadcast(listed, listed.count())
    return df.join(F.broadcast(listed) if small else listed, same, "left").drop(*names.values())


def with_group_values(
    df: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    *,
    broadcast_rows: int = BROADCAST_ROWS,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """Add aggregates of each row's group to the row (count, average, … over a partition).

    Few groups are broadcast to the rows; many are joined back, split where a group is hot. The groups
    are counted first. Both ways take any aggregate, count(distinct …) as well.
    """
    groups = df.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])
    if not fits_broadcast(groups, groups.count(), broadcast_rows):
        return skew_join(df, groups, keys, null_safe=True, policy=policy)
    named = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *values)
    same = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        same = test if same is None else same & test
    return df.join(F.broadcast(named), same).drop(*[f"_g_{k}" for k in keys])
