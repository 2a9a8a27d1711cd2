"""Streams whose rows wait for others, and streams that hold a request more than once.

What has to be remembered is Spark's own state: partitioned by key, checkpointed with the stream, and dropped
when the watermark says that it can matter no more. No micro-batch reads what earlier ones have written.
Event times are the caller's columns; a row later than `delay` behind the newest may be dropped as late.
run_available with a number of parts keeps the state in RocksDB's files, so it need not fit the executors' heaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_requests(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each request once: a repeat that comes within `delay` of the first in event time is dropped.

    State holds the keys of that span only. A NULL key is a key like any other.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def arrivals(parents: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """(key, time) of each parent's first appearance; a parent once known stays known.

    State: one entry for each parent. Parents without a key are nobody's, and Spark filters them out
    below the watermark, so they do not move it.
    """
    return parents.select(key, time).withWatermark(time, delay).dropDuplicates([key])


def await_parent(children: DataFrame, known: DataFrame, key: str, child_time: str, parent_time: str, wait: str, mark: str) -> DataFrame:
    """Each child as soon as its parent is known (mark true), or when it has waited long enough (false).

    Both are streams with watermarks. A child waits for `wait` in event time after its own time. A
    child with a NULL key waits in vain. State: the children that still wait, and one entry for each
    parent.
    """
    parent = known.select(F.col(key).alias("_parent"), F.col(parent_time).alias("_came"))
    until = F.col(child_time) + F.expr(f"interval {wait}")
    joined = children.join(parent, (F.col(key) == F.col("_parent")) & (F.col("_came") <= until), "left_outer")
    # The parent's time goes: a stream has one column of event time.
    return joined.select(*children.columns, F.col("_parent").isNotNull().alias(mark))
