"""Loads of the star schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.functions import dates
from rosterlake.operators import checks
from rosterlake.operators.intervals import by_key_size, latest_valid, match_valid
from rosterlake.operators.numbering import number_lookup, number_rows
from rosterlake.operators.ordering import latest, ranked
from rosterlake.operators.skew import lookup_join, skew_join, with_group_values
from rosterlake.operators.versions import compare_with_previous
from rosterlake.session import written
from rosterlake.sources.calendar import days_between, days_of


def load_dim_department(departments: DataFrame, deduplicate: bool = False) -> DataFrame:
    """Departments with a key; deduplicate keeps the lowest id of each trimmed name."""
    named = departments.filter(F.col("department_name").isNotNull()).select(
        "department_id", F.trim("department_name").alias("department_name")
    )
    if deduplicate:
        named = latest(named, ["department_name"], ["department_id"], smallest=True)
    return S.shaped(number_lookup(named, ["department_id"], "department_sk"), S.DIM_DEPARTMENT)


def load_dim_project(projects: DataFrame, sentinel: bool = False) -> DataFrame:
    """Projects with a key; sentinel puts in project -1 when there are none."""
    rows = projects.select("project_id", "project_name", "start_date", "end_date", "status")
    if sentinel and rows.isEmpty():
        none = projects.sparkSession.createDataFrame([(-1, "No Project Assigned", None, None, None)], rows.schema)
        rows = rows.unionByName(none)
    return S.shaped(number_lookup(rows, ["project_id"], "project_sk"), S.DIM_PROJECT)


def calendar_rows(days: DataFrame) -> DataFrame:
    """Date attributes of a column full_date."""
    day = F.col("full_date")
    columns = {
        "date_sk": dates.date_key(day),
        "full_date": day,
        "day": F.dayofmonth(day),
        "month": F.month(day),
        "month_name": dates.month_name(day),
        "quarter": F.quarter(day),
        "year": F.year(day),
        "is_weekend": dates.is_weekend(day),
    }
    return S.shaped(days.select(*[c.alias(n) for n, c in columns.items()]), S.DIM_DATE)


def load_dim_date(reviews: DataFrame) -> DataFrame:
    """Every day from the first to the last review."""
    return calendar_rows(days_of(reviews, "review_date"))


def load_fixed_dim_date(spark, low: dt.date = dt.date(2010, 1, 1), high: dt.date = dt.date(2030, 12, 31)) -> DataFrame:
    return calendar_rows(days_between(spark, low, high))


def dimension_rows(
    history: DataFrame, employees: DataFrame, departments: DataFrame, job_roles: DataFrame
) -> DataFrame:
    """Every version with its employee, department and role, in the shape of dim_employee."""
    person = employees.select(
        *(
            "employee_id first_name last_name email age gender marital_status education_field "
            "distance_from_home years_at_company attrition manager_id"
        ).split()
    )
    named = departments.select("department_id", F.trim("department_name").alias("department_name"))
    roles = job_roles.select("job_role_id", F.col("job_role_name").alias("job_role"))
    rows = skew_join(history, person, ["employee_id"], spread_by=["employee_sk"])
    rows = lookup_join(rows, named, ["department_id"], measure=history, spread_by=["employee_sk"])
    rows = lookup_join(rows, roles, ["job_role_id"], measure=history, spread_by=["employee_sk"])
    return S.shaped(rows, S.DIM_EMPLOYEE)


def load_dim_employee(
    dim_employee: DataFrame | None,
    history: DataFrame,
    employees: DataFrame,
    departments: DataFrame,
    job_roles: DataFrame,
) -> DataFrame:
    """The versions to append: those whose (employee, start, end) the dimension lacks.

    Keys are carried over from the history table. A version whose end date has moved counts as a
    new row here; `merge_dim_employee` replaces it instead.
    """
    if dim_employee is not None:
        same = ["employee_id", "effective_start_date", "effective_end_date"]
        history = history.join(dim_employee.select(*same).distinct(), same, "left_anti")
    return dimension_rows(history, employees, departments, job_roles)


def merge_dim_employee(
    dim_employee: DataFrame,
    history: DataFrame,
    employees: DataFrame,
    departments: DataFrame,
    job_roles: DataFrame,
) -> DataFrame:
    """The whole dimension after taking every version of history by key, new or changed."""
    fresh = dimension_rows(history, employees, departments, job_roles)
    kept = dim_employee.join(history.select("employee_sk"), "employee_sk", "left_anti")
    return kept.unionByName(fresh)


def load_dim_employee_outrigger(
    history: DataFrame,
    employees: DataFrame,
    job_roles: DataFrame,
    managers: DataFrame,
    dim_department: DataFrame,
) -> DataFrame:
    """The older form of the dimension: department_sk instead of a name, managers per version.

    It keeps what was compared to get there: version_num, total_versions and the previous
    department, role and income. `managers` has employee_sk and manager_id.
    """
    person = employees.select("employee_id", "first_name", "last_name", "gender", "education_field")
    roles = job_roles.select("job_role_id", F.col("job_role_name").alias("job_role"))
    rows = history.filter(F.col("effective_start_date").isNotNull())
    rows = skew_join(rows, person, ["employee_id"], spread_by=["employee_sk"])
    rows = lookup_join(rows, roles, ["job_role_id"], measure=history, spread_by=["employee_sk"])
    rows = rows.join(managers, "employee_sk")
    rows = rows.withColumn("change_reason", F.coalesce(F.trim("change_reason"), F.lit("Initial Onboarding")))
    compared = compare_with_previous(
        written(rows, "versions"),
        {"prev_department_id": "department_id", "prev_job_role": "job_role", "prev_income": "monthly_income"},
    )
    placed = lookup_join(
        compared, dim_department.select("department_id", "department_sk"), ["department_id"], measure=history
    )
    return placed.select(
        *(
            "employee_sk employee_id department_sk first_name last_name gender education_field job_role job_level "
            "monthly_income daily_rate hourly_rate manager_id change_reason effective_start_date effective_end_date "
            "is_current version_num total_versions prev_department_id prev_job_role prev_income"
        ).split()
    )


def load_dim_assignment(assignments: DataFrame, dim_employee: DataFrame, dim_project: DataFrame) -> DataFrame:
    """Assignments with the employee version of the day they were given, and the project's key."""
    versions = dim_employee.select("employee_sk", "employee_id", "effective_start_date", "effective_end_date")
    matched = match_valid(assignments, versions, "employee_id", "assigned_date", spread_by=["assignment_id"])
    keyed = lookup_join(
        matched,
        dim_project.select("project_id", "project_sk"),
        ["project_id"],
        measure=assignments,
        spread_by=["assignment_id"],
    )
    numbered = number_rows(keyed, ["assignment_id", "employee_sk"], "assignment_sk", costly=True)
    return S.shaped(numbered, S.DIM_ASSIGNMENT)


def latest_assignment(
    reviews: DataFrame,
    assignments: DataFrame,
    take: list[str],
    measure: DataFrame | None = None,
    few: bool | None = None,
) -> DataFrame:
    """Each review with the assignment valid on its day that started last."""
    return latest_valid(
        reviews,
        assignments,
        "employee_id",
        "review_date",
        "assigned_date",
        "end_date",
        order=["assigned_date", "assignment_id"],
        take=take,
        spread_by=["review_id"],
        measure=measure,
        few=few,
    )


def fact_rows(
    reviews: DataFrame,
    dim_employee: DataFrame,
    dim_department: DataFrame,
    dim_date: DataFrame,
    assignments: DataFrame,
    dim_project: DataFrame,
) -> DataFrame:
    """Reviews with the keys of the version, department, day and project valid at their date.

    Departments are resolved on the versions and projects on the assignments. Versions and projects
    are then both joined by employee, so the reviews of all but the biggest employees are shuffled
    once. Reviews without a version, department or day drop
    out; a missing project stays NULL.
    """
    versions = lookup_join(
        dim_employee.select(
            "employee_sk", "employee_id", "department_name", "effective_start_date", "effective_end_date"
        ),
        dim_department.select("department_name", "department_sk"),
        ["department_name"],
        spread_by=["employee_sk"],
    ).drop("department_name")
    worked = lookup_join(
        assignments.select("assignment_id", "employee_id", "project_id", "assigned_date", "end_date"),
        dim_project.select("project_id", "project_sk"),
        ["project_id"],
        "left",
        spread_by=["assignment_id"],
    )
    rows = reviews.select("review_id", "employee_id", "review_date", "performance_rating")
    days = dim_date.select(F.col("full_date").alias("review_date"), "date_sk")

    def run(part: DataFrame, tables: list[DataFrame], measure: DataFrame, few: bool) -> DataFrame:
        found = match_valid(
            part, tables[0], "employee_id", "review_date", spread_by=["review_id"], measure=measure, few=few
        )
        found = lookup_join(found, days, ["review_date"], spread_by=["review_id"], measure=measure)
        return latest_assignment(found, tables[1], ["project_sk"], measure=measure, few=few)

    return by_key_size("employee_id", rows, [versions, worked], reviews, run, keep_unmatched=False)


def load_fact_reviews(
    reviews: DataFrame,
    dim_employee: DataFrame,
    dim_department: DataFrame,
    dim_date: DataFrame,
    assignments: DataFrame,
    dim_project: DataFrame,
) -> DataFrame:
    rows = fact_rows(reviews, dim_employee, dim_department, dim_date, assignments, dim_project)
    return S.shaped(number_rows(rows, ["review_id", "employee_sk"], "review_sk", costly=True), S.FACT_REVIEWS)


def load_fact_reviews_ranked(reviews: DataFrame, dim_employee: DataFrame, dim_date: DataFrame) -> DataFrame:
    """The older fact load: no project, but each review's number and its place in its department.

    dim_employee is the outrigger form with department_sk.
    """
    valid = reviews.filter(F.col("review_date").isNotNull() & F.col("performance_rating").isNotNull()).select(
        "review_id", "employee_id", "review_date", "performance_rating"
    )
    days = dim_date.select(F.col("full_date").alias("review_date"))
    valid = lookup_join(valid, days, ["review_date"], "left_semi", spread_by=["review_id"])
    numbered = ranked(valid, ["employee_id"], [("review_date", "asc")], dense_rank="review_sequence")
    versions = dim_employee.select(
        "employee_sk", "employee_id", "department_sk", "effective_start_date", "effective_end_date"
    )
    matched = match_valid(
        numbered, versions, "employee_id", "review_date", spread_by=["review_id"], measure=reviews
    )
    rows = written(
        matched.select(
            "review_id",
            "employee_sk",
            "department_sk",
            F.lit(None).cast("long").alias("project_sk"),
            dates.date_key(F.col("review_date")).alias("date_sk"),
            "performance_rating",
            "review_sequence",
        ),
        "reviews",
    )
    rows = with_group_values(rows, ["department_sk"], {"dept_avg_rating": F.avg("performance_rating")})
    return ranked(rows, ["department_sk"], [("performance_rating", "desc")], rank="dept_rating_rank")


def load_star(oltp: dict[str, DataFrame], dim_employee: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole star in dependency order. Each table is written before the next one uses it."""
    departments, projects = oltp["departments"], oltp["projects"]
    reviews, assignments = oltp["reviews"], oltp["assignments"]
    star = {
        "dim_department": written(load_dim_department(departments), "dim_department"),
        "dim_project": written(load_dim_project(projects), "dim_project"),
        "dim_date": written(load_dim_date(reviews), "dim_date"),
    }
    new = load_dim_employee(
        dim_employee, oltp["employee_job_history"], oltp["employees"], departments, oltp["job_roles"]
    )
    star["dim_employee"] = written(new if dim_employee is None else dim_employee.unionByName(new), "dim_employee")
    star["dim_assignment"] = written(
        load_dim_assignment(assignments, star["dim_employee"], star["dim_project"]), "dim_assignment"
    )
    star["fact_performance_reviews"] = written(
        load_fact_reviews(
            reviews,
            star["dim_employee"],
            star["dim_department"],
            star["dim_date"],
            assignments,
            star["dim_project"],
        ),
        "fact_performance_reviews",
    )
    return star


def star_counts(star: dict[str, DataFrame]) -> DataFrame:
    return checks.row_counts(star)
