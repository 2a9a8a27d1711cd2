"""Joins of dated rows to rows that are valid over a closed interval of days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.operators.skew import BROADCAST_ROWS, DEFAULT, SkewPolicy, lookup_join, skew_join
from rosterlake.session import written

# Keys with at most this many events, intervals, and pairs of the two are matched in one piece.
FEW_EVENTS = 1_000_000
FEW_INTERVALS = 1_000
FEW_PAIRS = 10_000_000

# Run on part of the events and intervals: (events, intervals, measure, few).
Matching = Callable[[DataFrame, list[DataFrame], DataFrame, bool], DataFrame]


def _key_sizes(df: DataFrame, key: str) -> tuple[int, int]:
    """Rows of the most frequent key, and rows without a key."""
    rows, unset = F.col("count"), F.col(key).isNull()
    largest, nulls = df.groupBy(key).count().agg(F.max(F.when(~unset, rows)), F.max(F.when(unset, rows))).first()
    return largest or 0, nulls or 0


def _keys_with_many_pairs(key: str, events: DataFrame, intervals: DataFrame, most_events: int, most_intervals: int) -> DataFrame:
    """Keys whose events times intervals are above FEW_PAIRS; only keys that can be are joined."""
    sides = []
    for df, name, most in ((events, "_events", most_intervals), (intervals, "_intervals", most_events)):
        counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
        sides.append(counts.filter(F.col(name) * most > FEW_PAIRS))
    return sides[0].join(sides[1], key).filter(F.col("_events") * F.col("_intervals") > FEW_PAIRS).select(key)


def by_key_size(
    key: str,
    events: DataFrame,
    intervals: list[DataFrame],
    measure: DataFrame,
    run: Matching,
    keep_unmatched: bool,
) -> DataFrame:
    """Run a matching with few=True on keys of ordinary size, and with few=False on big ones.

    A big key has more events or intervals than fit one piece, or more pairs of them than one task
    should test. While the big keys are few enough to be broadcast, which is checked, only their
    rows take the other way; should there be more, all rows do. Many events without a key, which
    match nothing, are kept out of the joins.
    """
    largest, nulls = _key_sizes(measure, key)
    if nulls > FEW_EVENTS:
        with_key = [df.filter(F.col(key).isNotNull()) for df in (events, measure)]
        found = by_key_size(key, with_key[0], intervals, with_key[1], run, keep_unmatched)
        if not keep_unmatched:
            return found
        added = {f.name: F.lit(None).cast(f.dataType) for f in found.schema if f.name not in events.columns}
        return found.unionByName(events.filter(F.col(key).isNull()).withColumns(added))
    sizes = [(measure, largest, FEW_EVENTS), *((i, _key_sizes(i, key)[0], FEW_INTERVALS) for i in intervals)]
    big = None
    for df, size, most in sizes:
        if size > most:
            found = df.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > most).select(key)
            big = found if big is None else big.union(found)
    most_each = max((n for _, n, _ in sizes[1:]), default=0)
    if largest * most_each > FEW_PAIRS:
        for df in intervals:
            found = _keys_with_many_pairs(key, measure, df, largest, most_each)
            big = found if big is None else big.union(found)
    if big is None:
        return run(events, intervals, measure, True)
    big = written(big.distinct(), "big-keys")
    if big.count() > BROADCAST_ROWS:
        return run(events, intervals, measure, False)

    def part(how: str, few: bool) -> DataFrame:
        cut = [df.join(F.broadcast(big), key, how) for df in (events, measure, *intervals)]
        return run(cut[0], cut[2:], cut[1], few)

    return part("left_anti", True).unionByName(part("left_semi", False))


def day_bounds(df: DataFrame, day: str) -> tuple[dt.date, dt.date] | None:
    """First and last day, or None for no dates at all."""
    low, high = df.agg(F.min(day), F.max(day)).first()
    return None if low is None else (low, high)


def _levels(bounds: tuple[dt.date, dt.date]) -> int:
    """The number of a tree's levels above its leaves, which are the days within bounds."""
    return (bounds[1] - bounds[0]).days.bit_length()


def interval_nodes(intervals: DataFrame, start: str, end: str, bounds: tuple[dt.date, dt.date]) -> DataFrame:
    """One row for each node of a binary tree over the days that the interval covers as a whole.

    The days within bounds are the leaves; node n of level h covers the days n * 2^h to (n + 1) * 2^h - 1
    after the first. Any interval is made up of at most two nodes of each level, and no two of its
    nodes share a day. Adds _level and _node. An open end (NULL or a far sentinel) is clipped to the
    bounds; an interval outside of them has no rows.

    Spark takes the nodes for as few as the intervals, so a join to them has to ask for a merge, or it
    may broadcast them all.
    """
    low, high = (F.lit(b) for b in bounds)
    first = F.datediff(F.greatest(F.col(start), low), low)
    last = F.datediff(F.least(F.coalesce(F.col(end), high), high), low)
    # At level h the interval's nodes run from the first that begins inside it to the last that ends inside it.
    # The outer ones that no node of the next level takes in are the ones to keep.
    pieces = F.expr(
        f"""array_compact(flatten(transform(transform(sequence(0, {_levels(bounds)}),
          h -> struct(h as level, shiftright(_first + shiftleft(1, h) - 1, h) as a, shiftright(_last + 1, h) as b)),
          n -> array(if(n.a < n.b and n.a % 2 = 1, struct(n.level as level, n.a as node), null),
            if(n.a < n.b and n.b % 2 = 1, struct(n.level as level, n.b - 1 as node), null)))))"""
    )
    found = intervals.withColumns({"_first": first, "_last": last}).filter(F.col("_first") <= F.col("_last"))
    found = found.withColumn("_piece", F.explode(pieces)).drop("_first", "_last")
    return found.withColumns({"_level": F.col("_piece.level"), "_node": F.col("_piece.node")}).drop("_piece")


def day_nodes(days: DataFrame, day: str, bounds: tuple[dt.date, dt.date]) -> DataFrame:
    """One row for each node that a day lies below: one of each level. Adds _level and _node."""
    inside = days.withColumn("_at", F.datediff(F.col(day), F.lit(bounds[0])))
    found = inside.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(_levels(bounds)))))
    return found.withColumn("_node", F.expr("shiftright(_at, _level)")).drop("_at")


def _asked(df: DataFrame, key: str, day: str) -> DataFrame:
    """Each key and day once, as _k and _d."""
    known = df.filter(F.col(key).isNotNull() & F.col(day).isNotNull())
    return known.select(F.col(key).alias("_k"), F.col(day).alias("_d")).distinct()


def _by_day(
    events: DataFrame, found: DataFrame, on: list[str], how: str, spread_by: list[str] | None, measure: DataFrame, policy: SkewPolicy
) -> DataFrame:
    """Answers per key and day, written once, at each event: few days of few keys need no shuffle of the events."""
    days = written(found, "days")
    # Days counted as too many are merged, for the size of their compressed files does not show it; a broadcast overrides the hint.
    return lookup_join(
        events, days.hint("merge"), on, how, spread_by=spread_by, measure=measure, broadcast_rows=BROADCAST_ROWS, policy=policy
    )


def match_valid(
    events: DataFrame,
    intervals: DataFrame,
    key: str,
    day: str,
    start: str = "effective_start_date",
    end: str = "effective_end_date",
    how: str = "inner",
    *,
    spread_by: list[str] | None = None,
    measure: DataFrame | None = None,
    few: bool | None = None,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """Every pair of an event and an interval with the same key whose days contain the event's.

    Keys of ordinary size (few, see by_key_size) are matched by one equi-join on the key with the
    days as a residual test. For big ones no pair is tested: an interval becomes the few tree nodes
    that make it up (interval_nodes), a day the nodes above it, one a level, and the two share a
    node just where the interval contains the day. That join is on (key, node) and asks for each
    day of a key once, however many events have it; what it finds is joined back to the events by
    (key, day), broadcast if that is small and else split where hot. Its rows are answers, whether intervals overlap or not.
    `measure` is a cheaper table with the same key and day columns as events.
    """
    base = events if measure is None else measure
    # An interval without a start is valid on no day, whatever the size of its key.
    intervals = intervals.filter(F.col(key).isNotNull() & F.col(start).isNotNull())
    if few is None:

        def run(e: DataFrame, i: list[DataFrame], m: DataFrame, small: bool) -> DataFrame:
            return match_valid(
                e, i[0], key, day, start, end, how, spread_by=spread_by, measure=m, few=small, policy=policy
            )

        return by_key_size(key, events, [intervals], base, run, keep_unmatched=how == "left")
    if few:
        right = intervals.withColumnRenamed(key, "_key")
        valid = (F.col(day) >= F.col(start)) & (F.col(end).isNull() | (F.col(day) <= F.col(end)))
        return events.join(right, (F.col(key) == F.col("_key")) & valid, how).drop("_key")
    bounds = day_bounds(base, day)
    named = {c: f"_i_{c}" for c in intervals.columns if c != key}
    right = intervals.select(F.col(key).alias("_k"), *[F.col(c).alias(n) for c, n in named.items()])
    if bounds is None:
        found = right.filter(F.lit(False)).withColumn("_d", F.col(named[start]))
    else:
        days = day_nodes(_asked(base, key, day), "_d", bounds)
        nodes = interval_nodes(right, named[start], named[end], bounds)
        found = days.join(nodes.hint("merge"), ["_k", "_level", "_node"])
    found = found.select(F.col("_k").alias(key), F.col("_d").alias(day), *named.values())
    joined = _by_day(events, found, [key, day], how, spread_by, base, policy)
    return joined.select(*events.columns, *[F.col(n).alias(c) for c, n in named.items()])


def latest_valid(
    events: DataFrame,
    intervals: DataFrame,
    key: str,
    day: str,
    start: str,
    end: str,
    order: list[str],
    take: list[str],
    *,
    spread_by: list[str] | None = None,
    measure: DataFrame | None = None,
    few: bool | None = None,
    policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """For each event the valid interval that is last by `order`, with its `take` columns or NULLs.

    For keys of ordinary size (few, see by_key_size) a key's intervals become one list, and each
    event picks from the list of its key: one join, and events keep their partitioning.

    For big ones the answer, which only depends on (key, day), is worked out once per distinct
    pair, by the nodes of match_valid. Of the intervals of a key that cover a node only the last one
    counts, so a maximum, combined before the shuffle, leaves one row for each node: a key's rows are
    bounded by its days, however many intervals it has and however they overlap. A day's answer is the
    last of the one row a level that it meets, and is joined back to the events, split where hot.
    `measure` is a cheaper table with the same key and day columns as events.
    """
    base = events if measure is None else measure
    # An interval without a start is valid on no day, whatever the size of its key.
    intervals = intervals.filter(F.col(key).isNotNull() & F.col(start).isNotNull())
    kept = [*order, *[c for c in take if c not in order]]
    if few is None:

        def run(e: DataFrame, i: list[DataFrame], m: DataFrame, small: bool) -> DataFrame:
            return latest_valid(
                e, i[0], key, day, start, end, order, take, spread_by=spread_by, measure=m, few=small, policy=policy
            )

        return by_key_size(key, events, [intervals], base, run, keep_unmatched=True)
    if few:
        span = F.struct(*kept, F.col(start).alias("_start"), F.col(end).alias("_end"))
        lists = intervals.groupBy(key).agg(F.collect_list(span).alias("_spans"))
        valid = F.filter(
            "_spans", lambda s: (F.col(day) >= s["_start"]) & (s["_end"].isNull() | (F.col(day) <= s["_end"]))
        )
        best = F.array_max(F.transform(valid, lambda s: F.struct(*[s[c].alias(c) for c in kept])))
        found = events.join(lists, key, "left").withColumn("_best", best)
        return found.select(*events.columns, *[F.col(f"_best.{c}").alias(c) for c in take])

    bounds = day_bounds(base, day)
    if bounds is None:
        return events.withColumns({c: F.lit(None).cast(intervals.schema[c].dataType) for c in take})
    best = (
        interval_nodes(intervals.withColumnRenamed(key, "_k"), start, end, bounds)
        .groupBy("_k", "_level", "_node")
        .agg(F.max(F.struct(*kept)).alias("_best"))
    )
    found = (
        day_nodes(_asked(base, key, day), "_d", bounds)
        .join(best.hint("merge"), ["_k", "_level", "_node"])
        .groupBy("_k", "_d")
        .agg(F.max("_best").alias("_best"))
        .select(F.col("_k").alias(key), F.col("_d").alias(day), *[F.col(f"_best.{c}").alias(c) for c in take])
    )
    joined = _by_day(events, found, [key, day], "left", spread_by, base, policy)
    return joined.select(*events.columns, *take)


def count_valid(
    events: DataFrame, intervals: DataFrame, key: str, day: str, start: str, end: str, name: str,
    *, spread_by: list[str] | None = None, policy: SkewPolicy = DEFAULT,
) -> DataFrame:
    """events with the number of their key's intervals that contain the day.

    No pairs are made: per key and day, intervals that begin count up and those that ended the day
    before count down, and a running sum over a key's days, of which there are no more than there are
    calendar days, gives the number on each. Events of one key and day share a row of the result.
    """
    given = intervals.filter(F.col(key).isNotNull() & F.col(start).isNotNull())
    given = given.filter(F.col(end).isNull() | (F.col(end) >= F.col(start)))
    steps = given.select(F.col(key).alias("_k"), F.col(start).alias("_d"), F.lit(1).alias("_step")).union(
        given.filter(F.col(end).isNotNull()).select(key, F.date_add(end, 1), F.lit(-1))
    )
    asked = events.filter(F.col(key).isNotNull() & F.col(day).isNotNull()).select(key, day, F.lit(0))
    days = steps.union(asked).groupBy("_k", "_d").agg(F.sum("_step").alias("_step"))
    running = Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    found = days.select(F.col("_k").alias(key), F.col("_d").alias(day), F.sum("_step").over(running).alias(name))
    joined = skew_join(events, found, [key, day], "left", spread_by=spread_by, policy=policy)
    return joined.select(*events.columns, F.coalesce(name, F.lit(0)).cast("long").alias(name))
