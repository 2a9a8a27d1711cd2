"""Figures kept at the write, reports kept up to date, and differences of large tables."""

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import differences, statistics
from rosterlake.plans import analytics
from rosterlake.plans.kept_reports import KeptRatings
from rosterlake.session import new_path


def rows(df):
    return sorted(map(repr, df.collect()))


def test_figures_are_those_of_the_table(spark):
    df = spark.range(5, 1000).select(F.col("id"), (F.col("id") % 7).cast("int").alias("n"), F.col("id").cast("string").alias("s"))
    path = new_path(spark, "measured")
    assert statistics.whole_number_columns(df, ["id", "n", "s"]) == ["id", "n"]
    out = statistics.write_measured(df, path, ["id", "n"])
    kept = statistics.figures(spark, path)
    assert kept.first().asDict() == {"row_count": 995, "highest": {"id": 999, "n": 6}}
    assert statistics.next_key(kept, "id") == 1000 and rows(out) == rows(df)
    assert statistics.differs(out, kept).count() == 0
    with pytest.raises(ValueError):
        statistics.next_key(kept, "s")


@pytest.mark.parametrize("nothing", ["filtered", "made empty"])
def test_figures_of_an_empty_table(spark, nothing):
    df = spark.range(3).filter(F.rand(1) > 2) if nothing == "filtered" else spark.createDataFrame([], "id long")
    path = new_path(spark, "measured")
    statistics.write_measured(df, path, ["id"])
    kept = statistics.figures(spark, path)
    assert statistics.next_key(kept, "id") == 1
    assert [tuple(r) for r in statistics.row_counts({"t": kept}).collect()] == [("t", 0, "empty")]


def test_an_audit_finds_figures_that_no_longer_hold(spark):
    path = new_path(spark, "measured")
    statistics.write_measured(spark.range(10), path, ["id"])
    spark.range(50, 53).write.mode("append").parquet(path)
    found = statistics.differs(spark.read.parquet(path), statistics.figures(spark, path))
    assert rows(found.select("figure", "kept", "found")) == rows(
        spark.createDataFrame([("row_count", 10, 13), ("id", 9, 52)], "figure string, kept long, found long")
    )


def test_counts_and_keys_read_no_table(spark, warehouse):
    from rosterlake.registry import REGISTRY

    for name in ("d01_table_row_counts", "l15_row_count_report"):
        files = REGISTRY[name].build(warehouse).inputFiles()
        assert files and all("-figures/" in f for f in files)


FACTS = "date_sk long, department_sk long, performance_rating int"
DATES = [(20200101 + i * 10000, 2020 + i, 1 + i % 4) for i in range(4)]


def _facts(spark, n, shift=0):
    return spark.createDataFrame(
        [(DATES[i % 4][0], i % 3, None if i % 5 == 0 else (i * 7 + shift) % 5) for i in range(n)], FACTS
    )


def _plain(spark, facts, dates, departments):
    return [
        rows(analytics.yearly_trend(facts, dates, departments)),
        rows(analytics.yearly_change(facts, dates)),
        rows(analytics.quarterly_trend(facts, dates)),
    ]


@pytest.fixture
def calendar(spark):
    dates = spark.createDataFrame(DATES, "date_sk long, year int, quarter int")
    departments = spark.createDataFrame([(i, f"d{i}") for i in range(3)], "department_sk long, department_name string")
    return dates, departments


def test_kept_reports_equal_those_of_all_facts(spark, calendar):
    dates, departments = calendar
    kept = KeptRatings(spark, new_path(spark, "kept"), dates)
    parts = [_facts(spark, 10 + 13 * i, i) for i in range(5)]
    for i, part in enumerate(parts):
        kept.add(part, i)
    kept.add(parts[2], 2)  # run again after a failure
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    reports = [kept.yearly_trend(departments), kept.yearly_change(), kept.quarterly_trend()]
    assert [rows(r) for r in reports] == _plain(spark, everything, dates, departments)
    assert all("/kept-" in f for f in reports[1].inputFiles())


def test_withdrawn_facts_are_subtracted(spark, calendar):
    dates, departments = calendar
    kept = KeptRatings(spark, new_path(spark, "kept"), dates)
    facts = _facts(spark, 40)
    gone = facts.filter("date_sk = 20200101")
    kept.add(facts, 0)
    kept.add(facts.limit(0), 1, withdrawn=gone)
    left = facts.filter("date_sk <> 20200101")
    assert [rows(r) for r in (kept.yearly_trend(departments), kept.yearly_change(), kept.quarterly_trend())] == _plain(
        spark, left, dates, departments
    )


def _versions(spark, data):
    return spark.createDataFrame(data, "k long, a int, b string")


def test_differing_rows_by_brute_force(spark):
    left = [(i, i % 5, f"x{i}") for i in range(300)] + [(None, 1, "n")]
    right = [(i, i % 5 + (i in (7, 70)), f"x{i}") for i in range(3, 305)] + [(None, None, "n")]
    found = differences.differing(_versions(spark, left), _versions(spark, right).select("b", "k", "a"), ["k"], buckets=16)
    got = {(r.k, tuple(r.left) if r.in_left else None, tuple(r.right) if r.in_right else None) for r in found.collect()}
    a, b = {r[0]: r[1:] for r in left}, {r[0]: r[1:] for r in right}
    assert got == {(k, a.get(k), b.get(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k)}


def test_values_that_swap_columns_or_rows_are_seen(spark):
    left = spark.createDataFrame([(1, 5, None), (2, None, 6)], "k long, a int, b int")
    moved = spark.createDataFrame([(1, None, 5), (2, 6, None)], "k long, a int, b int")
    swapped = spark.createDataFrame([(1, None, 6), (2, 5, None)], "k long, a int, b int")
    for other in (moved, swapped):
        assert differences.differing(left, other, ["k"], buckets=1).count() == 2


def test_equal_tables_have_no_unequal_bucket(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.hash("id").alias("a"))
    other = df.repartition(7)
    assert differences.unequal_buckets(df, other, ["k"], ["a"]).count() == 0
    changed = other.withColumn("a", F.when(F.col("k") == 17, 0).otherwise(F.col("a")))
    assert differences.unequal_buckets(df, changed, ["k"], ["a"]).count() == 1
    assert differences.differing(df.limit(0), df.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        differences.differing(df, df.drop("a"), ["k"])
