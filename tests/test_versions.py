"""Applying changes to versions: hand-made cases and properties of random batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.operators import checks
from rosterlake.operators.versions import (
    apply_to_dimension,
    apply_to_employees,
    apply_to_history,
    judge_changes,
    overlapping,
)

D = dt.date
FAR = S.OPEN_END
CHANGE = (
    "employee_id long, change_date date, change_seq long, department_id long, job_role_name string, job_level int, "
    "monthly_income int, change_reason string"
)


def history_of(spark, data):
    """data: (sk, employee, department, role, level, income, start, end, current)."""
    df = spark.createDataFrame(
        data,
        "employee_sk long, employee_id long, department_id long, job_role_id long, job_level int, monthly_income int, "
        "effective_start_date date, effective_end_date date, is_current int",
    )
    fixed = {"business_travel": "Travel_Rarely", "over_time": "Yes", "change_reason": "Current Record"}
    rest = [f for f in S.JOB_HISTORY.fields if f.name not in df.columns and f.name not in fixed]
    return S.shaped(
        df.withColumns({f.name: F.lit(9) for f in rest})
        .withColumns({n: F.lit(v) for n, v in fixed.items()})
        .withColumn("job_history_id", F.col("employee_sk") + 100),
        S.JOB_HISTORY,
    )


@pytest.fixture(scope="module")
def lookups(spark):
    departments = spark.createDataFrame([(i, f"Dept {i}") for i in range(1, 4)], S.DEPARTMENTS)
    roles = spark.createDataFrame([(10 * r + lv, f"Role {r}", lv) for r in range(3) for lv in range(1, 6)], S.JOB_ROLES)
    return departments, roles


@pytest.fixture(scope="module")
def history(spark):
    return history_of(
        spark,
        [
            (1, 1, 1, 1, 1, 1000, D(2020, 1, 1), D(2020, 12, 31), 0),
            (2, 1, 1, 2, 2, 1500, D(2021, 1, 1), FAR, 1),
            (3, 2, 2, 1, 1, 2000, D(2021, 1, 1), FAR, 1),
            (4, 3, 2, 1, 1, 2000, D(2020, 1, 1), D(2020, 12, 31), 0),
        ],
    )


def change(employee, day, seq=1, dept=3, role="Role 1", level=3, income=2200, reason="Promotion"):
    return (employee, day, seq, dept, role, level, income, reason)


def apply(spark, lookups, history, data):
    judged = judge_changes(spark.createDataFrame(data, CHANGE), history, *lookups)
    return judged, apply_to_history(history, judged.accepted)


def table(df):
    return {
        r["employee_sk"]: (r["employee_id"], r["monthly_income"], r["effective_start_date"], r["effective_end_date"], r["is_current"])
        for r in df.collect()
    }


def test_one_change_expires_and_adds(spark, lookups, history):
    _, applied = apply(spark, lookups, history, [change(1, D(2022, 5, 1))])
    got = table(applied.history)
    assert got[2] == (1, 1500, D(2021, 1, 1), D(2022, 4, 30), 0)
    assert got[5] == (1, 2200, D(2022, 5, 1), FAR, 1)
    assert got[3] == (2, 2000, D(2021, 1, 1), FAR, 1)
    assert {r["employee_sk"] for r in applied.touched.collect()} == {2, 5}


def test_new_version_resets_and_derives_rates(spark, lookups, history):
    _, applied = apply(spark, lookups, history, [change(1, D(2022, 5, 1), income=2200)])
    new = applied.history.filter("employee_sk = 5").first()
    assert (new["daily_rate"], new["hourly_rate"], new["monthly_rate"]) == (100, 12, 2200)
    assert (new["business_travel"], new["over_time"], new["years_in_current_role"]) == ("Non-Travel", "No", 0)
    assert (new["department_id"], new["job_role_id"], new["job_level"]) == (3, 13, 3)
    assert new["job_history_id"] == 105


def test_several_changes_chain(spark, lookups, history):
    data = [change(1, D(2022, 5, 1)), change(1, D(2022, 8, 1), income=2500), change(2, D(2022, 1, 1))]
    _, applied = apply(spark, lookups, history, data)
    got = table(applied.history)
    assert got[5] == (1, 2200, D(2022, 5, 1), D(2022, 7, 31), 0)
    assert got[6] == (1, 2500, D(2022, 8, 1), FAR, 1)
    assert got[7] == (2, 2200, D(2022, 1, 1), FAR, 1)


def test_last_change_of_a_day_wins(spark, lookups, history):
    _, applied = apply(spark, lookups, history, [change(1, D(2022, 5, 1), 1, income=1), change(1, D(2022, 5, 1), 2, income=2)])
    assert [v[1] for k, v in table(applied.history).items() if k > 4] == [2]


def test_change_on_the_start_day_replaces(spark, lookups, history):
    _, applied = apply(spark, lookups, history, [change(1, D(2021, 1, 1), income=4400)])
    got = table(applied.history)
    assert len(got) == 4
    assert got[2] == (1, 4400, D(2021, 1, 1), FAR, 1)
    row = applied.history.filter("employee_sk = 2").first()
    assert (row["daily_rate"], row["change_reason"], row["over_time"]) == (200, "Promotion", "No")


def test_replacement_and_later_change_together(spark, lookups, history):
    data = [change(1, D(2021, 1, 1), income=4400), change(1, D(2022, 1, 1), income=5000)]
    _, applied = apply(spark, lookups, history, data)
    got = table(applied.history)
    assert got[2] == (1, 4400, D(2021, 1, 1), D(2021, 12, 31), 0)
    assert got[5] == (1, 5000, D(2022, 1, 1), FAR, 1)


def test_rejects_name_their_reason(spark, lookups, history):
    data = [
        change(1, D(2022, 1, 1), role="Role 9"),
        change(2, D(2022, 1, 1), dept=8),
        change(3, D(2022, 1, 1)),
        change(1, D(2020, 6, 1)),
        change(1, D(2020, 1, 1)),
    ]
    judged, applied = apply(spark, lookups, history, data)
    got = sorted((r["employee_id"], r["reject_reason"]) for r in judged.rejected.collect())
    # The last change is late as well: a version starts on its day, but with another content.
    assert got == [(1, "late change"), (1, "late change"), (1, "unknown job role"), (2, "unknown department"), (3, "no current version")]
    assert table(applied.history) == table(history)


def test_a_late_change_is_passed_over_only_if_its_version_is_stored(spark, lookups, history):
    known = change(1, D(2020, 1, 1), dept=1, role="Role 0", level=1, income=1000)
    judged, applied = apply(spark, lookups, history, [known])
    assert judged.rejected.count() == 0 and judged.accepted.count() == 0
    other = change(1, D(2020, 1, 1), dept=1, role="Role 0", level=1, income=1001)
    judged, applied = apply(spark, lookups, history, [other])
    assert [r["reject_reason"] for r in judged.rejected.collect()] == ["late change"]
    assert table(applied.history) == table(history)


def test_dimension_copies_what_the_change_does_not_name(spark, lookups, history):
    fixed = {"first_name": "Ann", "business_travel": "Travel_Rarely", "age": 40, "department_name": "Dept 1", "job_role": "Role 0"}
    dim = history.withColumns({n: F.lit(v) for n, v in fixed.items()})
    dim = S.shaped(
        dim.withColumns({f.name: F.lit(3) for f in S.DIM_EMPLOYEE.fields if f.name not in dim.columns}), S.DIM_EMPLOYEE
    )
    judged, applied = apply(spark, lookups, history, [change(1, D(2022, 5, 1)), change(2, D(2021, 1, 1), income=4400)])
    out = {r["employee_sk"]: r for r in apply_to_dimension(dim, judged.accepted, applied.added).collect()}
    assert len(out) == 5
    assert (out[5]["first_name"], out[5]["business_travel"], out[5]["age"]) == ("Ann", "Travel_Rarely", 40)
    assert (out[5]["department_name"], out[5]["job_role"], out[5]["daily_rate"], out[5]["is_current"]) == ("Dept 3", "Role 1", 100, 1)
    assert (out[2]["effective_end_date"], out[2]["is_current"]) == (D(2022, 4, 30), 0)
    assert (out[3]["monthly_income"], out[3]["department_name"], out[3]["business_travel"]) == (4400, "Dept 3", "Travel_Rarely")


def test_employees_move_but_keep_their_pay(spark, lookups, history):
    employees = spark.createDataFrame([(1, 1, 1, 1500), (2, 2, 1, 2000)], "employee_id long, department_id long, job_role_id long, monthly_income int")
    judged, _ = apply(spark, lookups, history, [change(1, D(2022, 5, 1)), change(1, D(2022, 6, 1), dept=2)])
    got = [tuple(r) for r in apply_to_employees(employees, judged.accepted).orderBy("employee_id").collect()]
    assert got == [(1, 2, 13, 1500), (2, 2, 1, 2000)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_batches_keep_the_invariants(spark, lookups, seed):
    pick = random.Random(seed)
    data, sk = [], 0
    for employee in range(25):
        sk += 1
        data.append((sk, employee, 1, 1, 1, 1000, D(2021, 1, 1), FAR, 1))
    history = history_of(spark, data)

    def batch(first):
        # One employee gets a third of all changes.
        return [
            change(
                0 if pick.random() < 0.33 else pick.randrange(30),
                D(2021, 1, 1) + dt.timedelta(days=pick.randrange(first, first + 300)),
                n, pick.randrange(1, 5), f"Role {pick.randrange(4)}", pick.randrange(1, 6), pick.randrange(500, 9000),
            )
            for n in range(60)
        ]

    one, two = batch(-50), batch(200)
    _, first = apply(spark, lookups, history, one)
    _, second = apply(spark, lookups, first.history, two)
    assert checks.not_one_current(second.history).count() == 0
    assert overlapping(second.history).count() == 0
    assert checks.bad_validity(second.history).count() == 0
    assert checks.repeated(second.history, ["employee_sk"]).count() == 0
    # No day between the first start and the open end is uncovered.
    gaps = second.history.groupBy("employee_id").agg(
        F.sum(F.when(F.col("is_current") == 0, F.datediff("effective_end_date", "effective_start_date") + 1).otherwise(0)).alias("days"),
        F.datediff(F.max("effective_start_date"), F.min("effective_start_date")).alias("span"),
    )
    assert gaps.filter("days <> span").count() == 0
    # The same batch again changes nothing.
    _, again = apply(spark, lookups, second.history, two)
    assert again.history.exceptAll(second.history).count() == 0
    assert second.history.exceptAll(again.history).count() == 0
