"""Column helpers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.functions import chance, dates, pay, text

D = dt.date


def one(spark, column, **values):
    names = list(values)
    kinds = {int: "long", float: "double", str: "string", D: "date", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column).first()[0]


@pytest.mark.parametrize("raw, want", [(" a ", "a"), ("b\r", "b"), ("\tc\n", "c"), (None, None), ("  ", "")])
def test_tidy(spark, raw, want):
    assert one(spark, text.tidy(F.col("v")), v=raw) == want


@pytest.mark.parametrize(
    "name, first, last", [("Ann Bea Cole", "Ann", "Bea Cole"), ("Ann", "Ann", None), ("Ann ", "Ann", ""), (None, None, None)]
)
def test_split_name(spark, name, first, last):
    assert one(spark, text.first_word(F.col("n")), n=name) == first
    assert one(spark, text.after_first_word(F.col("n")), n=name) == last


def test_full_name_is_null_with_a_missing_part(spark):
    assert one(spark, text.full_name(F.col("a"), F.col("b")), a="x", b=None) is None
    assert one(spark, text.full_name(F.col("a"), F.col("b")), a="x", b="y") == "x y"


def test_fragment_wildcards_and_case(spark):
    assert one(spark, text.contains_fragment(F.col("v"), "NN_B"), v="Ann Bea")
    assert not one(spark, text.contains_fragment(F.col("v"), "n_b", literal=True), v="Ann Bea")
    assert one(spark, text.contains_fragment(F.col("v"), "5%", literal=True), v="about 5% more")
    assert not one(spark, text.contains_fragment(F.col("v"), "5%", literal=True), v="about 55 more")


@pytest.mark.parametrize(
    "income, daily, hourly, monthly",
    # 55/22 = 2.5 and 77/22 = 3.5 are ties: half goes to even. Rates never fall below 1.
    [(55, 2, 1, 55), (77, 4, 1, 77), (1, 1, 1, 1), (22000, 1000, 125, 22000), (4840, 220, 28, 4840)],
)
def test_pay_rates(spark, income, daily, hourly, monthly):
    assert one(spark, pay.daily_rate(F.col("m")), m=income) == daily
    assert one(spark, pay.hourly_rate(F.col("m")), m=income) == hourly
    assert one(spark, pay.monthly_rate(F.col("m")), m=income) == monthly


def test_rounding_modes(spark):
    assert one(spark, F.round(F.col("v"), 0), v=2.5) == 3
    assert one(spark, pay.half_even(F.col("v")), v=2.5) == 2


@pytest.mark.parametrize("raw, want", [("12", 12), ("12.9", 12), ("n/a", 35), (None, 35), ("", 35)])
def test_whole_or(spark, raw, want):
    assert one(spark, pay.whole_or(F.col("v"), 35), v=raw) == want


def test_open_end_is_normalised(spark):
    for end, want in ((D(2099, 12, 31), D(9999, 12, 31)), (D(9999, 12, 31), D(9999, 12, 31)), (D(2020, 1, 1), D(2020, 1, 1))):
        assert one(spark, S.normalise_open_end(F.col("e")), e=end) == want


def test_date_helpers(spark):
    saturday = D(2024, 2, 3)
    assert one(spark, dates.date_key(F.col("d")), d=saturday) == 20240203
    assert one(spark, dates.is_weekend(F.col("d")), d=saturday) == 1
    assert one(spark, dates.is_weekend(F.col("d")), d=D(2024, 2, 5)) == 0
    assert one(spark, dates.month_name(F.col("d")), d=saturday) == "February"
    assert one(spark, dates.valid_on(F.col("d"), F.lit(saturday), F.lit(None).cast("date")), d=saturday)


def test_chance_does_not_depend_on_partitioning(spark):
    draws = spark.range(2000).select("id", chance.uniform(F.col("id"), "s").alias("u"))
    again = spark.range(2000).repartition(13).select("id", chance.uniform(F.col("id"), "s").alias("u"))
    assert draws.exceptAll(again).count() == 0
    low, high, mean = draws.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.03


def test_weighted_choice(spark):
    weights = {"a": 0.4, "b": 0.25, "c": 0.2, "d": 0.15}
    got = dict(
        spark.range(20000).groupBy(chance.weighted(F.col("id"), "w", weights).alias("k")).count().collect()
    )
    for name, share in weights.items():
        assert abs(got[name] / 20000 - share) < 0.02


def test_whole_between_reaches_both_ends(spark):
    got = {r[0] for r in spark.range(500).select(chance.whole_between(F.col("id"), "x", 5, 8)).distinct().collect()}
    assert got == {5, 6, 7, 8}


def test_odd_numbers_take_the_default(spark):
    df = spark.createDataFrame([("NaN",), ("7.9",), ("x",), (None,), ("1e300",), ("-Infinity",)], "t string")
    assert [r[0] for r in df.select(pay.whole_or(F.col("t"), 5)).collect()] == [5, 7, 5, 5, 5, 5]


def test_repeated_addresses_of_any_domain(spark):
    df = spark.createDataFrame([("a@b.org", 1), ("x", 2), ('"p@q"@r.net', 3), ("a@b.org", 0), (None, 1)], "e string, n int")
    found = [r[0] for r in df.select(text.email_variant(F.col("e"), F.col("n"))).collect()]
    assert found == ["a.1@b.org", "x.2", '"p@q".3@r.net', "a@b.org", None]


def test_tabs_are_blank(spark):
    df = spark.createDataFrame([("\t",), (" a",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.not_blank(F.col("t"))).collect()] == [False, True, False, False]


def test_positions_reach_beyond_32_bits(spark):
    size = 1 << 40
    found = spark.range(2000).select(chance.position(F.col("id"), "s", size).alias("p")).agg(F.min("p"), F.max("p"), F.countDistinct("p")).first()
    assert 0 <= found[0] < size // 100 and size - size // 100 < found[1] < size and found[2] == 2000
