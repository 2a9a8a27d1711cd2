"""Tables in hash parts: what a change rewrites and what it leaves."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.operators.parts import PartedTable
from rosterlake.operators.versions import update_rows
from rosterlake.session import new_path

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.IntegerType()), T.StructField("s", T.StringType())])


def rows(df):
    return sorted(map(repr, df.collect()))


def files(table):
    return set(table.rows().inputFiles())


@pytest.fixture
def table(spark):
    out = PartedTable(spark, new_path(spark, "parted"), SCHEMA, ["k"])
    out.create(spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 9).cast("int").alias("v"), F.lit("x").alias("s")))
    return out


def test_ten_keys_rewrite_at_most_ten_parts(spark, table):
    before, old = files(table), table.rows()
    changes = spark.createDataFrame([(i * 400, None if i == 3 else -i) for i in range(10)], "k long, v int")
    expected = rows(update_rows(old, changes, ["k"]))
    assert len(before) == 200
    touched = table.touched(changes)
    assert re.search(r"PartitionFilters: \[[^]]*part#\d+ (IN|INSET)", touched._jdf.queryExecution().executedPlan().toString())
    read = {r.f.rsplit("/", 2)[1] for r in touched.select(F.input_file_name().alias("f")).distinct().collect()}
    table.update(changes)
    after = files(table)
    assert rows(table.rows()) == expected
    assert 1 <= len(before - after) <= 10 and len(after) == 200
    assert {f.rsplit("/", 2)[1] for f in before - after} == read
    table.update(changes)  # the same batch again
    assert rows(table.rows()) == expected


def test_no_change_and_unknown_keys_leave_all_rows(spark, table):
    before, old = files(table), rows(table.rows())
    table.update(spark.createDataFrame([], "k long, v int"))
    assert files(table) == before
    table.update(spark.createDataFrame([(10**9, 1)], "k long, v int"))
    assert rows(table.rows()) == old


def test_a_change_that_fails_leaves_the_table(spark, table):
    before, old = files(table), rows(table.rows())
    broken = lambda df: df.withColumn("v", F.when(F.col("k") == 400, F.raise_error(F.lit("stop"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        table.rewrite(spark.createDataFrame([(400,), (800,)], "k long"), broken)
    assert files(table) == before and rows(table.rows()) == old


def test_rows_can_be_added_and_keys_can_be_null(spark):
    out = PartedTable(spark, new_path(spark, "parted"), SCHEMA, ["k"], parts=4)
    out.create(spark.createDataFrame([(None, 1, "a"), (1, 2, "b"), (2, 3, "c")], SCHEMA))
    new = spark.createDataFrame([(None, 9, "n"), (1, 8, "m")], SCHEMA)
    out.rewrite(new, lambda df: df.unionByName(new))
    assert rows(out.rows()) == rows(spark.createDataFrame([(None, 1, "a"), (1, 2, "b"), (2, 3, "c"), (None, 9, "n"), (1, 8, "m")], SCHEMA))
