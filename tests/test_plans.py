"""Star loads, reports and synthesis where their details matter."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.operators import checks
from rosterlake.operators.versions import overlapping
from rosterlake.plans import analytics, oltp, star
from rosterlake.plans import synthesis as syn

D = dt.date
FAR = S.OPEN_END


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def filled(spark, schema, data, columns):
    """Rows given for some columns; the others are NULL, or 0 and '' where NULL is not allowed."""
    kinds = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in columns)
    df = spark.createDataFrame(data, kinds)
    return S.shaped(df.withColumns({f.name: F.lit(None) for f in schema.fields if f.name not in columns}), schema)


def dimension(spark, data):
    return filled(
        spark, S.DIM_EMPLOYEE, data,
        ["employee_sk", "employee_id", "department_name", "first_name", "last_name", "monthly_income",
         "effective_start_date", "effective_end_date", "is_current"],
    )


@pytest.fixture(scope="module")
def people(spark):
    return dimension(
        spark,
        [
            (1, 1, "A", "Ann", "X", 1000, D(2020, 1, 1), D(2020, 12, 31), 0),
            (2, 1, "B", "Ann", "X", 1200, D(2021, 1, 1), FAR, 1),
            (3, 2, "B", "Bob", None, 3000, D(2020, 1, 1), FAR, 1),
            (4, 3, "B", "Cyd", "Z", 1200, D(2020, 1, 1), FAR, 1),
        ],
    )


def facts(spark, data):
    """data: (review, version, department key, day key, rating)."""
    return filled(spark, S.FACT_REVIEWS, [(i, *d) for i, d in enumerate(data)],
                  ["review_sk", "review_id", "employee_sk", "department_sk", "date_sk", "performance_rating"])


def test_summary_weighs_income_by_reviews(spark, people):
    f = facts(spark, [(1, 2, 2, 20210101, 4), (2, 2, 2, 20210102, 5), (3, 2, 2, 20210103, 3), (4, 3, 2, 20210103, 1)])
    # Ann three times, Bob once, Cyd once without any review.
    assert rows(analytics.department_summary(people, f)) == [("B", 3, round((3 * 1200 + 3000 + 1200) / 5), 3.25)]


def test_top_performers_ignore_expired_versions_and_keep_ties(spark, people):
    dept = spark.createDataFrame([(1, 1, "A"), (2, 2, "B")], S.DIM_DEPARTMENT)
    f = facts(spark, [(1, 1, 1, 20200101, 5), (2, 2, 2, 20210101, 4), (3, 4, 2, 20210101, 4), (4, 3, 2, 20210101, 3)])
    got = rows(analytics.top_performers(f, people, dept, 1), "employee_name", "department_name", "avg_rating", "dept_rank")
    assert got == [("Ann X", "B", 4.0, 1), ("Cyd Z", "B", 4.0, 1)]


def test_top_performers_rank_on_the_unrounded_mean(spark, people):
    dept = spark.createDataFrame([(2, 2, "B")], S.DIM_DEPARTMENT)
    low = [(i, 3, 2, 20210101, 4) for i in range(400)] + [(400, 3, 2, 20210101, 5)]
    high = [(i, 4, 2, 20210101, 4) for i in range(500, 899)] + [(899, 4, 2, 20210101, 5)]
    got = rows(analytics.top_performers(facts(spark, low + high), people, dept, 2), "dept_rank", "monthly_income", "avg_rating")
    assert got == [(1, 1200, 4.0), (2, 3000, 4.0)]


def test_yearly_change_is_taken_between_rounded_means(spark):
    days = spark.createDataFrame([(20200101, 2020), (20210101, 2021), (20230101, 2023)], "date_sk int, year int")
    f = facts(
        spark,
        [(1, 1, 1, 20200101, 1), (2, 1, 1, 20200101, 1), (3, 1, 1, 20200101, 2), (4, 1, 1, 20210101, 2),
         (5, 1, 1, 20210101, 2), (6, 1, 1, 20210101, 1), (7, 1, 1, 20230101, 5)],
    )
    got = rows(analytics.yearly_change(f, days))
    assert got == sorted([(2020, 3, 1.333, None, None), (2021, 3, 1.667, 1.333, 0.334), (2023, 1, 5.0, 1.667, 3.333)], key=str)


def test_reviews_take_the_version_and_project_of_their_day(spark, people):
    reviews = filled(
        spark, S.REVIEWS,
        [(1, 1, D(2020, 12, 31), 3), (2, 1, D(2021, 1, 1), 4), (3, 1, D(2019, 5, 5), 5), (4, 2, D(2021, 6, 1), None), (5, 99, D(2021, 6, 1), 1)],
        ["review_id", "employee_id", "review_date", "performance_rating"],
    )
    assignments = filled(
        spark, S.ASSIGNMENTS,
        [(1, 1, 10, D(2020, 1, 1), None), (2, 1, 11, D(2020, 6, 1), D(2020, 12, 31)), (3, 1, 12, D(2020, 6, 1), D(2020, 12, 31)),
         (4, 2, 77, D(2021, 1, 1), None)],
        ["assignment_id", "employee_id", "project_id", "assigned_date", "end_date"],
    )
    projects = filled(spark, S.PROJECTS, [(10, "p"), (11, "q"), (12, "r")], ["project_id", "project_name"])
    departments = spark.createDataFrame([(5, "A"), (6, "B")], S.DEPARTMENTS)
    dims = star.load_dim_department(departments), star.load_dim_date(reviews), star.load_dim_project(projects)
    fact = star.load_fact_reviews(reviews, people, dims[0], dims[1], assignments, dims[2])
    got = rows(fact, "review_id", "employee_sk", "department_sk", "project_sk", "date_sk")
    # Of two assignments that start on one day the higher id counts; an unknown project stays NULL;
    # reviews before the first version or of nobody drop out.
    assert sorted(map(str, got)) == ["(1, 1, 1, 3, 20201231)", "(2, 2, 2, 1, 20210101)", "(4, 3, 2, None, 20210601)"]
    dropped = checks.dropped_reviews(reviews, people, dims[0], dims[1].filter("date_sk <> 20210601"))
    assert rows(dropped, "review_id", "cause") == [(3, "no version"), (4, "no date"), (5, "no version")]


def test_incremental_and_merging_dimension_loads(warehouse):
    inputs = warehouse.many("employee_job_history", "employees", "departments", "job_roles")
    whole = warehouse["dim_employee"]
    moved = inputs[0].withColumn(
        "effective_end_date", F.when(F.col("employee_id") == 3, F.lit(D(2005, 1, 1))).otherwise(F.col("effective_end_date"))
    )
    # The incremental load sees a moved end date as a new row; the merge replaces the row.
    added = star.load_dim_employee(whole, moved, *inputs[1:])
    assert {r["employee_id"] for r in added.collect()} == {3}
    merged = star.merge_dim_employee(whole, moved, *inputs[1:])
    assert merged.count() == whole.count()
    assert checks.repeated(merged, ["employee_sk"]).count() == 0
    assert star.load_dim_employee(whole, *inputs).count() == 0


def test_calendar_has_no_gaps_and_the_fixed_one_is_complete(spark, warehouse):
    fixed = star.load_fixed_dim_date(spark)
    assert fixed.count() == 7670
    days = warehouse["dim_date"]
    low, high, n = days.agg(F.min("full_date"), F.max("full_date"), F.count("*")).first()
    assert n == (high - low).days + 1


def test_onboarding_reports_the_first_broken_rule(spark, warehouse):
    good = (1, "Ann", "Bell", "a@b.c", 1, "Role 0", 1, 1100.0, 30, "Medical", 5, 3, 2)
    names = (
        "employee_number long, first_name string, last_name string, email string, department_id long, job_role string, "
        "job_level int, monthly_income double, age int, education_field string, total_working_years int, years_at_company int, "
        "years_in_current_role int"
    )
    columns = [n.split()[0] for n in names.split(", ")]
    faults = {
        "first name is empty": {"first_name": " "},
        "last name is empty": {"last_name": None},
        "e-mail is empty": {"email": ""},
        "education field is empty": {"education_field": " "},
        "unknown department": {"department_id": 99},
        "unknown job role": {"job_role": "Nobody"},
        "invalid e-mail address": {"email": "a@b"},
        "first name contains a digit": {"first_name": "An1"},
        "last name contains a digit": {"last_name": "B2"},
        "years at company exceed working years": {"years_at_company": 6},
        "years in role exceed years at company": {"years_in_current_role": 4},
        "too many working years for the age": {"age": 20},
        "younger than 18": {"age": 17, "total_working_years": 1, "years_at_company": 1, "years_in_current_role": 0},
        "income is not positive": {"monthly_income": 0.0},
    }
    data = [good]
    for i, fault in enumerate(faults.values(), 2):
        row = dict(zip(columns, good)) | {"employee_number": i} | fault
        data.append(tuple(row[c] for c in columns))
    rest = {"gender": "", "marital_status": "", "education": 3, "distance_from_home": 1, "num_companies_worked": 0}
    roles = spark.createDataFrame([(1, "Role 0", 1)], S.JOB_ROLES)
    departments = spark.createDataFrame([(1, "A")], S.DEPARTMENTS)
    hires = spark.createDataFrame(data, names).withColumns({n: F.lit(v) for n, v in rest.items()})
    done = oltp.onboard(hires, warehouse["employee_job_history"], departments, roles, D(2024, 1, 1))
    assert [r["first_broken"] for r in done.rejected.orderBy("employee_number").collect()] == list(faults)
    new = done.dim_employee.first()
    assert done.dim_employee.count() == 1
    assert (new["daily_rate"], new["hourly_rate"], new["change_reason"], new["effective_end_date"]) == (50, 6, "New Hire", FAR)
    assert new["employee_sk"] == done.history.first()["employee_sk"]
    # A broken rule before another one is the one reported.
    both = hires.filter("employee_number = 2").withColumn("age", F.lit(3))
    assert oltp.onboard(both, warehouse["employee_job_history"], departments, roles, D(2024, 1, 1)).rejected.first()["first_broken"] == "first name is empty"


def test_sentinel_project_only_when_there_are_none(warehouse):
    projects = warehouse["projects"]
    assert star.load_dim_project(projects, sentinel=True).filter("project_id = -1").count() == 0
    assert rows(star.load_dim_project(projects.filter("project_id < 0"), sentinel=True), "project_sk", "project_id") == [(1, -1)]


# Synthesis


@pytest.mark.parametrize("apply_to", ["history", "current"])
def test_synthesised_versions_hold_the_invariants(warehouse, apply_to):
    people = syn.add_identity(syn.source_columns(warehouse["raw_people"]).withColumn("Age", F.lit(30)))
    made = syn.number_versions(syn.make_versions(people, 45, apply_to))
    counts = checks.version_counts(made).first().asDict()
    assert counts == {"total": 195, "current": 150, "historical": 45, "employees": 150, "keys": 195}
    assert checks.not_one_current(made).count() == 0
    assert checks.bad_validity(made).count() == 0
    assert overlapping(made).count() == 0
    assert made.filter("is_current = 0").agg(F.max("employee_sk")).first()[0] == 45


def test_whole_synthesis_is_reproducible_and_typed(warehouse):
    raw = warehouse["raw_people"]
    one = syn.synthesise(raw, 400, 0.30)
    two = syn.synthesise(raw.repartition(7), 400, 0.30)
    assert one.columns == S.STAGING.names
    assert one.exceptAll(two).count() == 0 and one.count() == 520
    assert checks.count_mismatches(one, {"total": 520, "current": 400, "historical": 120, "employees": 400, "keys": 520}).count() == 0
    assert checks.repeated(one.filter("is_current = 1"), ["Email"]).count() == 0
    assert checks.schema_violations(one, S.STAGING).count() == 0


def test_scaling_down_keeps_the_first_rows(warehouse):
    got = syn.scale_to_target(warehouse["people"], 20)
    assert rows(got, "EmployeeNumber") == [(i,) for i in range(20)]


def test_transfer_never_stays(warehouse):
    people = warehouse["people"].withColumns({"Department": F.trim("Department"), "JobRole": F.trim("JobRole")})
    moved = syn.apply_change(syn.with_other_places(people, people), F.lit("Department Transfer"))
    both = moved.select("employee_id", F.col("Department").alias("after")).join(people, "employee_id")
    assert both.filter("after = Department").count() == 0
    assert both.select("after").distinct().count() == 5


def test_a_single_department_has_nowhere_to_move(warehouse):
    people = warehouse["people"].withColumn("Department", F.lit("Only"))
    moved = syn.apply_change(syn.with_other_places(people, people), F.lit("Department Transfer"))
    assert moved.filter("Department <> 'Only'").count() == 0 and moved.count() == people.count()


def test_variation_stays_inside_its_limits(warehouse):
    got = syn.add_variation(warehouse["raw_people"])
    for name, spec in syn.VARIATION.items():
        if spec.low is not None:
            assert got.filter(~F.col(name).between(spec.low, spec.high)).count() == 0
        assert got.filter(F.col(name).isNull()).count() == 0


def test_allocation_as_share_and_percent(warehouse):
    needs = warehouse.many("employees", "projects", "job_roles", "staging_employees")
    shares = {float(r[0]) for r in syn.spread_over_projects(*needs).select("allocation_ratio").distinct().collect()}
    percents = {float(r[0]) for r in syn.spread_over_projects(*needs, as_percent=True).select("allocation_ratio").distinct().collect()}
    assert shares == {0.5, 0.75, 1.0} and percents == {50.0, 75.0, 100.0}
