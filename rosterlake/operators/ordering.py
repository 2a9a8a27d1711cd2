"""Row numbers, neighbours and ranks inside groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.operators.numbering import number_rows
from rosterlake.operators.skew import DEFAULT, SkewPolicy, fits_broadcast, skew_join
from rosterlake.session import written

# A group up to this size is ordered by one task in a window.
WINDOW_ROWS = 1_000_000


def largest_group(df: DataFrame, group: list[str]) -> int:
    return df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0


def in_order(
    df: DataFrame,
    group: list[str],
    order: list[str | Column],
    *,
    number: str | None = None,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add a running number and values of the previous or following row of the same group.

    previous and following map a new column to the column it is taken from. The order must tell
    the rows of a group apart. While the largest group fits one task this is a plain window.
    Beyond that, all rows are numbered in one global order over many tasks, and a row's neighbour
    is found by joining on that number, which is unique and so cannot be skewed.
    """
    previous, following = previous or {}, following or {}
    if largest_group(df, group) <= window_rows:
        w = Window.partitionBy(*group).orderBy(*order)
        added = {}
        if number:
            added[number] = F.row_number().over(w).cast("long")
        added.update({n: F.lag(c).over(w) for n, c in previous.items()})
        added.update({n: F.lead(c).over(w) for n, c in following.items()})
        return df.withColumns(added)

    placed = number_rows(df, [*group, *order], "_at")
    out = placed
    for sources, step, mark in ((previous, 1, "_p_"), (following, -1, "_f_")):
        if sources:
            beside = placed.select(
                (F.col("_at") + step).alias(f"{mark}at"),
                *[F.col(g).alias(f"{mark}{g}") for g in group],
                *[F.col(c).alias(n) for n, c in sources.items()],
            )
            same = F.col("_at") == F.col(f"{mark}at")
            for g in group:
                same = same & F.col(g).eqNullSafe(F.col(f"{mark}{g}"))
            out = out.join(beside, same, "left").drop(f"{mark}at", *[f"{mark}{g}" for g in group])
    if number:
        firsts = placed.groupBy(*group).agg(F.min("_at").alias("_group_first"))
        policy = SkewPolicy(rows=window_rows)
        out = skew_join(
            out, firsts, group, null_safe=True, spread_by=["_at"], measure=placed, policy=policy
        )
        out = out.withColumn(number, F.col("_at") - F.col("_group_first") + 1).drop("_group_first")
    return out.select(*df.columns, *([number] if number else []), *previous, *following)


def ranked(
    df: DataFrame,
    group: list[str],
    by: list[tuple[str, str]],
    *,
    rank: str | None = None,
    dense_rank: str | None = None,
    window_rows: int = WINDOW_ROWS,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """Add RANK or DENSE_RANK inside each group; `by` lists (column, "asc" or "desc").

    While the largest group fits one task this is a plain window. Beyond that: ranks only depend on
    how often each ordering value occurs, so the rows are counted per (group, value) with map-side
    combining. The counts are ordered, and joined back to the rows.
    """
    columns = [c for c, _ in by]
    order = [F.col(c).asc() if way == "asc" else F.col(c).desc() for c, way in by]
    if largest_group(df, group) <= window_rows:
        whole = Window.partitionBy(*group).orderBy(*order)
        added = {rank: F.rank(), dense_rank: F.dense_rank()}
        return df.withColumns({n: f.over(whole).cast("long") for n, f in added.items() if n})
    values = df.groupBy(*group, *columns).agg(F.count("*").alias("_rows"))
    if largest_group(values, group) <= window_rows:
        w = Window.partitionBy(*group).orderBy(*order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        values = values.select(
            *group,
            *columns,
            F.row_number().over(w).cast("long").alias("_dense"),
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) + 1).alias("_rank"),
        )
    else:
        values = _ranked_over_slices(values, group, columns, order, window_rows)
    wanted = {k: v for k, v in ((rank, "_rank"), (dense_rank, "_dense")) if k}
    values = values.select(*group, *columns, *[F.col(v).alias(k) for k, v in wanted.items()])
    return skew_join(df, values, [*group, *columns], null_safe=True, policy=policy)


def _ranked_over_slices(
    values: DataFrame, group: list[str], columns: list[str], order: list[Column], window_rows: int
) -> DataFrame:
    """Ranks when one group has too many distinct values for a task.

    The values are numbered globally and cut into runs of window_rows neighbours. Inside a run
    a window counts; what precedes the run comes from one total per run and group.
    """
    placed = number_rows(values, [*group, *order], "_at")
    runs = placed.withColumn("_run", F.floor((F.col("_at") - 1) / F.lit(window_rows)))
    inside = Window.partitionBy("_run", *group).orderBy("_at")
    local = runs.withColumns(
        {
            "_local_dense": F.row_number().over(inside),
            "_local_rows": F.sum("_rows").over(inside.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    totals = runs.groupBy("_run", *group).agg(
        F.count("*").alias("_run_values"), F.sum("_rows").alias("_run_rows")
    )
    earlier = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_run",
        *group,
        F.coalesce(F.sum("_run_values").over(earlier), F.lit(0)).alias("_values_before"),
        F.coalesce(F.sum("_run_rows").over(earlier), F.lit(0)).alias("_rows_before"),
    )
    return skew_join(local, starts, ["_run", *group], null_safe=True).select(
        *group,
        *columns,
        (F.col("_values_before") + F.col("_local_dense")).cast("long").alias("_dense"),
        (F.col("_rows_before") + F.coalesce("_local_rows", F.lit(0)) + 1).cast("long").alias("_rank"),
    )


def top_by_dense_rank(
    df: DataFrame, group: list[str], by: list[tuple[str, str]], n: int, name: str
) -> DataFrame:
    """The rows whose DENSE_RANK in their group is at most n, ties kept.

    Only the n best distinct values of a group matter. They are found on distinct values, where
    the row_number filter already cuts each group to n rows before the shuffle, written, and sent to
    the rows if they fit a broadcast. Otherwise they are joined back, split where a tied value is hot.
    """
    columns = [c for c, _ in by]
    order = [F.col(c).asc() if way == "asc" else F.col(c).desc() for c, way in by]
    w = Window.partitionBy(*group).orderBy(*order)
    best = (
        df.select(*group, *columns)
        .distinct()
        .withColumn(name, F.row_number().over(w))
        .filter(F.col(name) <= n)
        .withColumn(name, F.col(name).cast("long"))
    )
    best = written(best, "best")
    if not fits_broadcast(best, best.count()):
        return skew_join(df, best, [*group, *columns], null_safe=True)
    right = F.broadcast(best.select(*[F.col(c).alias(f"_b_{c}") for c in [*group, *columns]], name))
    same = None
    for c in [*group, *columns]:
        test = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        same = test if same is None else same & test
    return df.join(right, same).drop(*[f"_b_{c}" for c in [*group, *columns]])


def latest(df: DataFrame, group: list[str], order: list[str], smallest: bool = False) -> DataFrame:
    """One whole row per group: the one with the highest (or smallest) ordering values.

    max_by keeps one candidate per task and group, so no group is ever sorted or collected.
    """
    kept = [c for c in df.columns if c not in group]
    choose = F.min_by if smallest else F.max_by
    row = choose(F.struct(*kept), F.struct(*order)).alias("_row")
    return df.groupBy(*group).agg(row).select(*[F.col(f"_row.{c}") if c in kept else F.col(c) for c in df.columns])
