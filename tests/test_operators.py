"""Operators on small hand-made tables, and their large-group paths against plain windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rosterlake.operators import checks, intervals, numbering, ordering, skew
from rosterlake.operators.skew import SkewPolicy
from rosterlake.session import written

D = dt.date
EAGER = SkewPolicy(rows=5)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def skewed(spark, n=400, seed=1):
    """One key holds more than a third of the rows; some keys are NULL."""
    pick = random.Random(seed)
    data = []
    for i in range(n):
        key = 7 if pick.random() < 0.4 else None if pick.random() < 0.1 else pick.randrange(40)
        data.append((i, key, D(2020, 1, 1) + dt.timedelta(days=pick.randrange(900)), pick.randrange(5)))
    return spark.createDataFrame(data, "id long, k int, day date, rating int")


# Numbering


def test_number_rows_is_dense_and_ordered(spark):
    df = skewed(spark).repartition(7)
    got = rows(numbering.number_rows(df, ["k", "id"], "n", start=11), "n", "id")
    want = rows(df.withColumn("n", F.row_number().over(Window.orderBy("k", "id")) + 10), "n", "id")
    assert got == want


def test_number_rows_descending_and_empty(spark):
    df = spark.range(50)
    assert rows(numbering.number_rows(df, [F.desc("id")], "n"))[0] == (0, 50)
    assert numbering.number_rows(df.filter("id < 0"), ["id"], "n").count() == 0
    assert numbering.next_key(df.filter("id < 0"), "id") == 1


def test_number_lookup_agrees_with_number_rows(spark):
    df = spark.range(30)
    small = rows(numbering.number_lookup(df, ["id"], "n", 5))
    assert small == rows(numbering.number_lookup(df, ["id"], "n", 5, window_rows=3))
    assert small[0] == (0, 5)


def test_first_n_is_exact(spark):
    assert numbering.first_n(spark.range(100).repartition(6), ["id"], 33).count() == 33


# Skew


def test_hot_keys_lists_only_hot_ones(spark):
    df = skewed(spark)
    assert skew.hot_keys(df, ["k"]) is None
    hot = skew.hot_keys(df, ["k"], SkewPolicy(rows=60)).collect()
    assert [r["k"] for r in hot] == [7]
    assert hot[0]["_parts"] >= 2


def test_hot_key_bound_does_not_grow_with_the_table(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("k"))
    hot = skew.hot_keys(df, ["k"], SkewPolicy(rows=9))
    assert hot.count() == 100 and hot.first()["_parts"] == 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_skew_join_equals_join(spark, how, null_safe):
    left = skewed(spark)
    right = spark.createDataFrame([(7, "a"), (3, "b"), (None, "c"), (99, "d")], "k int, name string")
    split = skew.skew_join(left, right, ["k"], how, null_safe=null_safe, spread_by=["id"], policy=EAGER)
    r = right.withColumnRenamed("k", "rk")
    same = left.k.eqNullSafe(r.rk) if null_safe else left.k == r.rk
    plain = left.join(r, same, how).drop("rk")
    assert sorted(map(str, rows(split, *plain.columns))) == sorted(map(str, rows(plain)))
    assert not [c for c in split.columns if c.startswith("_")]


def test_skew_join_spreads_the_hot_key(spark):
    left = skewed(spark)
    right = spark.createDataFrame([(7, "a"), (3, "b")], "k int, name string")
    joined = skew.skew_join(left, right, ["k"], spread_by=["id"], policy=SkewPolicy(rows=20))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan
    assert joined.filter("k = 7").count() == left.filter("k = 7").count()


def test_lookup_join_broadcasts_only_small_tables(spark):
    left, right = skewed(spark), spark.range(40).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("one"))
    few = skew.lookup_join(left, right, ["k"])
    many = skew.lookup_join(left, right, ["k"], broadcast_rows=5)
    plan_of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan_of(few)
    assert "strategy=broadcast" not in plan_of(many)
    assert rows(few, "id", "one") == rows(many, "id", "one")


@pytest.mark.parametrize("broadcast_rows", [100, 0])
@pytest.mark.parametrize("policy", [skew.DEFAULT, EAGER])
def test_group_values_keep_null_groups(spark, broadcast_rows, policy):
    df = skewed(spark)
    got = skew.with_group_values(df, ["k"], {"n": F.count("*")}, broadcast_rows=broadcast_rows, policy=policy)
    want = df.withColumn("n", F.count("*").over(Window.partitionBy("k")))
    assert rows(got, "id", "n") == rows(want, "id", "n")


# Order inside groups


@pytest.mark.parametrize("window_rows", [10_000, 3])
def test_in_order_equals_window(spark, window_rows):
    df = skewed(spark)
    got = ordering.in_order(
        df, ["k"], ["day", "id"], number="n", previous={"p": "rating", "pd": "day"}, following={"f": "day"},
        window_rows=window_rows,
    )
    w = Window.partitionBy("k").orderBy("day", "id")
    want = df.select(
        "id", F.row_number().over(w).alias("n"), F.lag("rating").over(w).alias("p"), F.lag("day").over(w).alias("pd"),
        F.lead("day").over(w).alias("f"),
    )
    columns = ["id", "n", "p", "pd", "f"]
    assert sorted(map(str, rows(got, *columns))) == sorted(map(str, rows(want, *columns)))


@pytest.mark.parametrize("window_rows", [10_000, 50])
def test_ranks_of_few_values_in_large_groups(spark, window_rows):
    df = skewed(spark)
    got = ordering.ranked(df, ["k"], [("rating", "desc")], rank="r", dense_rank="d", window_rows=window_rows, policy=EAGER)
    w = Window.partitionBy("k").orderBy(F.desc("rating"))
    want = df.select("id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))
    assert rows(got, "id", "r", "d") == rows(want, "id", "r", "d")


@pytest.mark.parametrize("window_rows", [10_000, 3])
def test_ranked_equals_window(spark, window_rows):
    df = skewed(spark)
    got = ordering.ranked(
        df, ["k"], [("rating", "desc"), ("day", "asc")], rank="r", dense_rank="d", window_rows=window_rows, policy=EAGER
    )
    w = Window.partitionBy("k").orderBy(F.desc("rating"), "day")
    want = df.select("id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))
    assert rows(got, "id", "r", "d") == rows(want, "id", "r", "d")


def test_top_by_dense_rank_keeps_ties(spark):
    df = spark.createDataFrame(
        [("a", 5.0, 1), ("a", 5.0, 2), ("a", 4.0, 3), ("a", 3.0, 4), ("b", 1.0, 5)], "g string, v double, id int"
    )
    got = ordering.top_by_dense_rank(df, ["g"], [("v", "desc")], 2, "place")
    assert rows(got, "id", "place") == [(1, 1), (2, 1), (3, 2), (5, 1)]


def test_latest_takes_the_whole_row(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 7, None), (2, 1, "y")], "k int, o int, v string")
    assert sorted(map(str, rows(ordering.latest(df, ["k"], ["o"])))) == ["(1, 7, None)", "(2, 1, 'y')"]
    assert rows(ordering.latest(df, ["k"], ["o"], smallest=True)) == [(1, 5, "x"), (2, 1, "y")]


# Intervals


def dated(spark, seed=3):
    pick = random.Random(seed)
    day = lambda: D(2018, 1, 1) + dt.timedelta(days=pick.randrange(1500))
    key = lambda: 7 if pick.random() < 0.4 else pick.randrange(6)
    events = [(i, key(), day()) for i in range(150)] + [(900, None, day()), (901, 77, day())]
    spans = []
    for i in range(80):
        a = day()
        kind = pick.random()
        end = None if kind < 0.2 else D(9999, 12, 31) if kind < 0.3 else a + dt.timedelta(days=pick.randrange(-3, 500))
        spans.append((i, key(), a, end))
    e = spark.createDataFrame(events, "id long, k int, day date")
    s = spark.createDataFrame(spans, "span long, k int, start date, end date")
    return events, spans, e, s


def brute(events, spans):
    for e in events:
        yield e, [s for s in spans if e[1] is not None and s[1] == e[1] and s[2] <= e[2] and (s[3] is None or e[2] <= s[3])]


# Small keys at once, nodes without a hot day, nodes with hot days split.
PATHS = [(True, skew.DEFAULT), (False, skew.DEFAULT), (False, EAGER)]


@pytest.mark.parametrize("few, policy", PATHS)
@pytest.mark.parametrize("how", ["inner", "left"])
def test_match_valid_equals_brute_force(spark, few, policy, how):
    events, spans, e, s = dated(spark)
    got = intervals.match_valid(e, s, "k", "day", "start", "end", how, spread_by=["id"], few=few, policy=policy)
    want = []
    for event, found in brute(events, spans):
        want += [(event[0], f[0]) for f in found]
        if how == "left" and not found:
            want.append((event[0], None))
    assert sorted(map(str, rows(got, "id", "span"))) == sorted(map(str, want))


@pytest.mark.parametrize("few, policy", PATHS)
def test_latest_valid_equals_brute_force(spark, few, policy):
    events, spans, e, s = dated(spark, seed=5)
    got = intervals.latest_valid(
        e, s, "k", "day", "start", "end", order=["start", "span"], take=["span"], spread_by=["id"], few=few,
        policy=policy,
    )
    want = [(ev[0], max(found, key=lambda f: (f[2], f[0]))[0] if found else None) for ev, found in brute(events, spans)]
    assert sorted(map(str, rows(got, "id", "span"))) == sorted(map(str, want))


@pytest.mark.parametrize("few", [True, False])
def test_interval_edges_are_closed(spark, few):
    e = spark.createDataFrame([(1, 1, D(2020, 1, 1)), (2, 1, D(2020, 12, 31)), (3, 1, D(2021, 1, 1))], "id long, k int, day date")
    s = spark.createDataFrame([(5, 1, D(2020, 1, 1), D(2020, 12, 31)), (6, 1, D(2021, 1, 1), D(9999, 12, 31))], "span long, k int, start date, end date")
    got = intervals.match_valid(e, s, "k", "day", "start", "end", few=few)
    assert rows(got, "id", "span") == [(1, 5), (2, 5), (3, 6)]


def test_open_intervals_are_clipped_to_the_data(spark):
    s = spark.createDataFrame([(1, D(1990, 1, 1), D(9999, 12, 31)), (2, D(2030, 1, 1), None), (3, D(2019, 6, 2), None)], "k int, start date, end date")
    # Nine days: 1 has the eight of a node of level 3 and the last one, 3 all but the first.
    got = intervals.interval_nodes(s, "start", "end", (D(2019, 6, 1), D(2019, 6, 9)))
    assert rows(got, "k", "_level", "_node") == [(1, 0, 8), (1, 3, 0), (3, 0, 1), (3, 0, 8), (3, 1, 1), (3, 2, 1)]


def test_nodes_cover_each_day_of_an_interval_once(spark):
    low = D(2020, 1, 1)
    for days in (1, 2, 3, 7, 8, 9, 21):
        high = low + dt.timedelta(days=days - 1)
        spans = [(i * 100 + j, low + dt.timedelta(days=i), low + dt.timedelta(days=j)) for i in range(-2, days + 2) for j in range(i - 1, days + 2)]
        s = intervals.interval_nodes(spark.createDataFrame(spans, "span int, start date, end date"), "start", "end", (low, high))
        d = intervals.day_nodes(spark.range(days).select(F.date_add(F.lit(low), F.col("id").cast("int")).alias("day")), "day", (low, high))
        got = d.join(s, ["_level", "_node"]).select("span", "day").collect()
        want = {(n, low + dt.timedelta(days=x)) for n, a, b in spans for x in range(days) if a <= low + dt.timedelta(days=x) <= b}
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_keys_with_many_pairs_take_the_other_way(spark, monkeypatch):
    events, spans, e, s = dated(spark, seed=12)
    size = {k: sum(x[1] == k for x in events) * sum(x[1] == k for x in spans) for k in range(8)}
    for most in (max(size.values()), sorted(size.values())[-2], 0):
        monkeypatch.setattr(intervals, "FEW_PAIRS", most)
        big = intervals._keys_with_many_pairs("k", e, s, 150, 80)
        assert rows(big, "k") == [(k,) for k, n in size.items() if n > most]
        got = intervals.match_valid(e, s, "k", "day", "start", "end", spread_by=["id"])
        assert sorted(rows(got, "id", "span")) == sorted((ev[0], f[0]) for ev, found in brute(events, spans) for f in found)
        best = intervals.latest_valid(e, s, "k", "day", "start", "end", ["start", "span"], ["span"], spread_by=["id"])
        want = [(ev[0], max(found, key=lambda f: (f[2], f[0]))[0] if found else None) for ev, found in brute(events, spans)]
        assert sorted(map(str, rows(best, "id", "span"))) == sorted(map(str, want))


def test_one_key_with_all_rows_makes_no_more_rows_than_its_answers(spark):
    """60,000 events and 600 intervals of one key: what is joined are days and nodes, not pairs."""
    low = D(2000, 1, 1)
    e = spark.range(60_000).select("id", F.lit(1).alias("k"), F.date_add(F.lit(low), F.pmod("id", F.lit(3_000)).cast("int")).alias("day"))
    s = spark.range(600).select(F.col("id").alias("span"), F.lit(1).alias("k"), F.date_add(F.lit(low), (F.col("id") * 5).cast("int")).alias("start"))
    s = s.withColumn("end", F.date_add("start", 4))
    bounds = intervals.day_bounds(e, "day")
    assert intervals.interval_nodes(s, "start", "end", bounds).count() <= 600 * 3
    assert intervals.day_nodes(intervals._asked(e, "k", "day"), "_d", bounds).count() == 3_000 * 13
    got = intervals.match_valid(e, s, "k", "day", "start", "end", few=False, spread_by=["id"])
    assert got.count() == 60_000 and got.filter("span <> pmod(id, 3000) div 5").count() == 0
    best = intervals.latest_valid(e, s, "k", "day", "start", "end", ["start"], ["span"], few=False, spread_by=["id"])
    assert best.filter("span = pmod(id, 3000) div 5").count() == 60_000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_found_days_are_joined_back_without_a_broadcast(spark, monkeypatch, how):
    events, spans, e, s = dated(spark, seed=13)
    monkeypatch.setattr(intervals, "BROADCAST_ROWS", 0)
    got = intervals.match_valid(e, s, "k", "day", "start", "end", how, spread_by=["id"], few=False, policy=EAGER)
    want = [(ev[0], f[0]) for ev, found in brute(events, spans) for f in found or [(None,)] * (how == "left")]
    assert sorted(map(str, rows(got, "id", "span"))) == sorted(map(str, want))


def test_nodes_and_many_found_days_are_not_broadcast(spark, monkeypatch):
    """Small files say nothing about the rows that intervals and days become."""
    _, _, e, s = dated(spark)
    e, s = written(e, "events"), written(s, "spans")
    plans = []

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(intervals, "written", seen)
    monkeypatch.setattr(intervals, "BROADCAST_ROWS", 0)
    got = [
        intervals.match_valid(e, s, "k", "day", "start", "end", few=False),
        intervals.latest_valid(e, s, "k", "day", "start", "end", ["start", "span"], ["span"], few=False),
    ]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in got]
    assert len(plans) == 4 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


@pytest.mark.parametrize("most", [10_000, 20, 0])
@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_only_big_keys_take_the_other_way(spark, monkeypatch, most, broadcast_rows):
    """No big key, one big key of several, only big keys; with and without room to split."""
    events, spans, e, s = dated(spark, seed=8)
    monkeypatch.setattr(intervals, "FEW_INTERVALS", most)
    monkeypatch.setattr(intervals, "BROADCAST_ROWS", broadcast_rows)
    got = intervals.match_valid(e, s, "k", "day", "start", "end", "left", spread_by=["id"])
    want = [(ev[0], f[0]) for ev, found in brute(events, spans) for f in found or [(None,)]]
    assert sorted(map(str, rows(got, "id", "span"))) == sorted(map(str, want))
    best = intervals.latest_valid(e, s, "k", "day", "start", "end", ["start", "span"], ["span"], spread_by=["id"])
    want = [(ev[0], max(found, key=lambda f: (f[2], f[0]))[0] if found else None) for ev, found in brute(events, spans)]
    assert sorted(map(str, rows(best, "id", "span"))) == sorted(map(str, want))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_many_events_without_a_key(spark, monkeypatch, how):
    events, spans, e, s = dated(spark, seed=9)
    lost = [(1000 + i, None, D(2019, 1, 1)) for i in range(30)]
    e = e.union(spark.createDataFrame(lost, e.schema))
    monkeypatch.setattr(intervals, "FEW_EVENTS", 20)
    got = intervals.match_valid(e, s, "k", "day", "start", "end", how, spread_by=["id"])
    want = [(ev[0], f[0]) for ev, found in brute(events + lost, spans) for f in found or [(None,)] * (how == "left")]
    assert sorted(map(str, rows(got, "id", "span"))) == sorted(map(str, want))
    best = intervals.latest_valid(e, s, "k", "day", "start", "end", ["start", "span"], ["span"], spread_by=["id"])
    assert best.count() == e.count()


@pytest.mark.parametrize("few", [True, False])
def test_no_events_at_all(spark, few):
    _, _, e, s = dated(spark)
    none = e.filter("id < 0")
    assert intervals.match_valid(none, s, "k", "day", "start", "end", few=few).count() == 0
    got = intervals.latest_valid(none, s, "k", "day", "start", "end", ["start", "span"], ["span"], few=few)
    assert got.columns == ["id", "k", "day", "span"] and got.count() == 0


# Checks


def versions(spark, data):
    return spark.createDataFrame(
        data, "employee_id long, employee_sk long, effective_start_date date, effective_end_date date, is_current int, change_reason string"
    )


def test_each_validity_rule_is_found_once(spark):
    far = D(9999, 12, 31)
    df = versions(
        spark,
        [
            (1, 1, D(2020, 1, 1), D(2019, 1, 1), 0, "x"),
            (2, 2, D(2020, 1, 1), D(2099, 12, 31), 1, None),
            (3, 3, D(2020, 1, 1), D(2020, 2, 1), 0, " "),
            (4, 4, D(2020, 1, 1), D(2020, 2, 1), 0, None),
            (5, 5, D(2020, 1, 1), far, 1, None),
        ],
    )
    assert rows(checks.bad_validity(df), "employee_id", "issue") == [
        (1, "start after end"),
        (2, "current version ends"),
        (3, "history without reason"),
        (4, "history without reason"),
    ]


def test_overlap_by_one_day_counts_and_touching_does_not(spark):
    from rosterlake.operators.versions import overlapping

    df = versions(
        spark,
        [
            (1, 1, D(2020, 1, 1), D(2020, 6, 30), 0, "x"),
            (1, 2, D(2020, 7, 1), D(9999, 12, 31), 1, "x"),
            (2, 3, D(2020, 1, 1), D(2020, 7, 1), 0, "x"),
            (2, 4, D(2020, 7, 1), D(9999, 12, 31), 1, "x"),
        ],
    )
    assert rows(overlapping(df), "employee_id", "next_start_date") == [(2, D(2020, 7, 1))]


def test_required_columns_and_order(spark):
    from rosterlake import schemas as S

    df = spark.range(1).select(F.lit(1).alias("Age"))
    with pytest.raises(ValueError, match="Attrition"):
        checks.require_columns(df, S.SOURCE)
    with pytest.raises(ValueError):
        checks.require_order(df, S.SOURCE)
    assert len(S.STAGING.fields) == 43


def test_orphans_ignore_nulls(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "p int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert rows(checks.orphans(child, "p", parent, "id")) == [(2, 2)]


# Both ways of each size switch


def test_group_values_count_distinct_both_ways(spark):
    df = skewed(spark)
    values = {"kinds": F.countDistinct("id"), "n": F.count("*")}
    few, many = (skew.with_group_values(df, ["k"], values, broadcast_rows=b) for b in (100, 0))
    assert rows(few, "id", "k", "kinds", "n") == rows(many, "id", "k", "kinds", "n")
    assert few.columns == many.columns


def _dated(spark):
    events = spark.createDataFrame(
        [(1, 1, "2020-05-01"), (2, 1, "2021-05-01"), (3, 2, "2020-05-01"), (4, None, "2020-05-01"), (5, 1, None), (6, 3, "2020-05-01")],
        "event int, k int, day string",
    ).withColumn("day", F.col("day").cast("date"))
    spans = spark.createDataFrame(
        [(10, 1, None, None), (11, 1, "2020-01-01", "2020-12-31"), (12, 1, "2020-02-01", None), (13, 2, None, "2022-01-01"),
         (14, None, "2020-01-01", None), (15, 3, "2020-06-01", "2020-01-01"), (16, 1, "2020-02-01", None)],
        "span int, k int, a string, b string",
    )
    return events, spans.select("span", "k", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_match_valid_both_ways_with_nulls(spark, how):
    events, spans = _dated(spark)
    few, many = (intervals.match_valid(events, spans, "k", "day", "a", "b", how, few=f) for f in (True, False))
    assert rows(few, "event", "span") == rows(many, "event", "span")
    found = {(r.event, r.span) for r in few.collect() if r.span is not None}
    assert found == {(1, 11), (1, 12), (1, 16), (2, 12), (2, 16)}


def test_latest_valid_both_ways_with_nulls(spark):
    events, spans = _dated(spark)
    few, many = (intervals.latest_valid(events, spans, "k", "day", "a", "b", ["a", "span"], ["span"], few=f) for f in (True, False))
    assert few.columns == many.columns
    assert rows(few) == rows(many)
    assert {r.event: r.span for r in few.collect()} == {1: 16, 2: 16, 3: None, 4: None, 5: None, 6: None}


def test_count_valid(spark):
    events, spans = _dated(spark)
    found = intervals.count_valid(events, spans, "k", "day", "a", "b", "n").collect()
    assert {r.event: r.n for r in found} == {1: 3, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0}


@pytest.mark.parametrize("most", [100, 0])
def test_top_by_dense_rank_both_ways(spark, most, monkeypatch):
    monkeypatch.setattr(ordering, "fits_broadcast", lambda df, n: n <= most)
    df = spark.createDataFrame([("a", 3, 1), ("a", 3, 2), ("a", 2, 3), ("a", None, 4), (None, 1, 5), (None, 1, 6)], "g string, v int, i int")
    found = ordering.top_by_dense_rank(df, ["g"], [("v", "desc")], 2, "place")
    assert {(r.i, r.place) for r in found.collect()} == {(1, 1), (2, 1), (3, 2), (5, 1), (6, 1)}


def test_first_n_of_wide_rows_and_ties(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (None, "n"), (2, "b2")], "k int, t string")
    assert sorted(str(r.k) for r in numbering.first_n(df, ["k"], 2).collect()) == ["1", "None"]
    assert numbering.first_n(df, ["k"], 3).count() == 3  # two rows tie for the third place
    assert numbering.first_n(df, ["k"], 9).count() == 5
    assert numbering.first_n(df, ["k"], 0).count() == 0
