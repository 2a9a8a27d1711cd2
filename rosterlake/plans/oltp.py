"""Loads of the normalised current-state tables, and batch writes to them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.functions import pay, text
from rosterlake.operators import rules
from rosterlake.operators.numbering import next_key, number_lookup, number_rows
from rosterlake.operators.ordering import in_order
from rosterlake.operators.skew import lookup_join
from rosterlake.session import written

# Staging column → column of employees, where they are more than a matter of case.
_EMPLOYEE_FIELDS = {
    "employee_number": "EmployeeNumber",
    "employee_name": "EmployeeName",
    "email": "Email",
    "age": "Age",
    "gender": "Gender",
    "marital_status": "MaritalStatus",
    "education": "Education",
    "education_field": "EducationField",
    "distance_from_home": "DistanceFromHome",
    "num_companies_worked": "NumCompaniesWorked",
    "total_working_years": "TotalWorkingYears",
    "years_at_company": "YearsAtCompany",
    "years_in_current_role": "YearsInCurrentRole",
    "attrition": "Attrition",
    "business_travel": "BusinessTravel",
    "over_time": "OverTime",
    "stock_option_level": "StockOptionLevel",
    "percent_salary_hike": "PercentSalaryHike",
    "environment_satisfaction": "EnvironmentSatisfaction",
    "job_involvement": "JobInvolvement",
    "job_satisfaction": "JobSatisfaction",
    "relationship_satisfaction": "RelationshipSatisfaction",
    "work_life_balance": "WorkLifeBalance",
    "training_times_last_year": "TrainingTimesLastYear",
    "monthly_income": "MonthlyIncome",
    "daily_rate": "DailyRate",
    "hourly_rate": "HourlyRate",
    "monthly_rate": "MonthlyRate",
    "employee_count": "EmployeeCount",
    "standard_hours": "StandardHours",
    "over_18": "Over18",
    "job_level": "JobLevel",
    "years_since_last_promotion": "YearsSinceLastPromotion",
    "years_with_curr_manager": "YearsWithCurrManager",
    "performance_rating": "PerformanceRating",
}


def _field(name: str) -> Column:
    return F.col(_EMPLOYEE_FIELDS.get(name, name)).alias(name)


def load_departments(staging: DataFrame) -> DataFrame:
    names = staging.filter(text.not_blank(F.col("Department"))).select(F.trim("Department").alias("department_name"))
    return S.shaped(number_lookup(names.distinct(), ["department_name"], "department_id"), S.DEPARTMENTS)


def load_job_roles(staging: DataFrame) -> DataFrame:
    roles = staging.filter(text.not_blank(F.col("JobRole")) & F.col("JobLevel").isNotNull()).select(
        F.trim("JobRole").alias("job_role_name"), F.col("JobLevel").alias("job_level")
    )
    return S.shaped(number_lookup(roles.distinct(), ["job_role_name", "job_level"], "job_role_id"), S.JOB_ROLES)


def with_lookups(staging: DataFrame, departments: DataFrame, job_roles: DataFrame) -> DataFrame:
    """Staging rows whose department and (role, level) are known, with both ids."""
    named = staging.withColumns(
        {
            "department_name": F.trim("Department"),
            "job_role_name": F.trim("JobRole"),
            "job_level": F.col("JobLevel"),
        }
    )
    placed = lookup_join(named, departments, ["department_name"], spread_by=["employee_sk"])
    return lookup_join(placed, job_roles, ["job_role_name", "job_level"], spread_by=["employee_sk"])


def load_employees(staging: DataFrame, departments: DataFrame, job_roles: DataFrame) -> DataFrame:
    """The current version of every employee, with the name split at its first space."""
    current = with_lookups(staging.filter("is_current = 1"), departments, job_roles)
    own = {
        "first_name": text.first_word(F.col("EmployeeName")),
        "last_name": text.after_first_word(F.col("EmployeeName")),
        "manager_id": F.lit(None).cast("long"),
    }
    return S.shaped(
        current.select(*[own[n].alias(n) if n in own else _field(n) for n in S.EMPLOYEES.names]), S.EMPLOYEES
    )


def load_job_history(staging: DataFrame, departments: DataFrame, job_roles: DataFrame) -> DataFrame:
    """All versions of all employees."""
    versions = with_lookups(staging, departments, job_roles)
    kept = versions.select(*[_field(n) for n in S.JOB_HISTORY.names if n != "job_history_id"])
    kept = kept.withColumn("effective_end_date", S.normalise_open_end(F.col("effective_end_date")))
    keyed = number_rows(kept, ["employee_id", "effective_start_date", "employee_sk"], "job_history_id")
    return S.shaped(keyed, S.JOB_HISTORY)


def load_reviews(staging: DataFrame, current_only: bool = True) -> DataFrame:
    """One review per version, dated at its start.

    current_only takes the current versions; otherwise every version that has a rating counts.
    """
    wanted = F.col("is_current") == 1 if current_only else F.col("PerformanceRating").isNotNull()
    own = {
        "reviewer_id": F.lit(None).cast("long").alias("reviewer_id"),
        "review_date": F.col("effective_start_date").alias("review_date"),
    }
    rows = staging.filter(wanted).select(
        *[own.get(n, _field(n)) for n in S.REVIEWS.names if n != "review_id"], "employee_sk"
    )
    return S.shaped(number_rows(rows, ["employee_id", "review_date", "employee_sk"], "review_id"), S.REVIEWS)


@dataclass
class Onboarded:
    employees: DataFrame
    history: DataFrame
    dim_employee: DataFrame
    rejected: DataFrame


# Values of a new employee that the request leaves out.
_HIRE_DEFAULTS = {
    "attrition": "No",
    "business_travel": "Non-Travel",
    "over_time": "No",
    "stock_option_level": 0,
    "percent_salary_hike": 0,
    "environment_satisfaction": 3,
    "job_involvement": 3,
    "job_satisfaction": 3,
    "relationship_satisfaction": 3,
    "work_life_balance": 3,
    "training_times_last_year": 0,
    "employee_count": 1,
    "standard_hours": 80,
    "over_18": "Y",
    "years_since_last_promotion": 0,
    "years_with_curr_manager": 0,
    "manager_id": None,
}


def check_hires(hires: DataFrame, departments: DataFrame, job_roles: DataFrame) -> DataFrame:
    """Hire requests with department_name, job_role_id, broken_rules and first_broken."""
    roles = job_roles.withColumnRenamed("job_role_name", "job_role")
    known = lookup_join(hires, departments, ["department_id"], "left", spread_by=["employee_number"])
    known = lookup_join(known, roles, ["job_role", "job_level"], "left", spread_by=["employee_number"])
    return rules.check_rows(known, rules.onboarding_rules())


def _taken(checked: DataFrame, columns: list[str], employees: DataFrame | None) -> DataFrame:
    """Marks acceptable requests whose number or e-mail an employee or an earlier request of the batch has.

    Which of several requests with one number comes first is decided by a hash of the whole request.
    """
    fine = F.col("first_broken").isNull()
    rest = checked.filter(~fine)
    for column, name in (("employee_number", "employee number"), ("email", "e-mail")):
        good = checked.filter(fine)
        whole = F.xxhash64(*columns)
        good = in_order(good.withColumn("_whole", whole), [column], ["_whole"], number="_copy").drop("_whole")
        again = F.when((F.col("_copy") > 1) & F.col(column).isNotNull(), f"{name} is repeated")
        if employees is not None:
            known = employees.select(column).distinct().withColumn("_known", F.lit(True))
            good = lookup_join(good, known, [column], "left", spread_by=["employee_number"])
            again = F.when(F.col("_known"), f"{name} is taken").otherwise(again)
        good = written(good.withColumn("first_broken", again).select(*checked.columns), "checked")
        rest = rest.unionByName(good.filter(~fine))
        checked = good
    return written(checked.filter(fine).unionByName(rest), "checked")


def onboard(
    hires: DataFrame,
    history: DataFrame,
    departments: DataFrame,
    job_roles: DataFrame,
    as_of: dt.date,
    employees: DataFrame | None = None,
) -> Onboarded:
    """New rows for employees, job history (a Day-1 version) and the dimension, and the rejects.

    Numbers and e-mails may not repeat, inside the batch and among the given employees.
    """
    checked = written(check_hires(hires, departments, job_roles), "checked")
    checked = _taken(checked, hires.columns, employees)
    rejected = checked.filter(F.col("first_broken").isNotNull()).select(*hires.columns, "first_broken")
    good = checked.filter(F.col("first_broken").isNull())
    missing = {n: F.lit(v) for n, v in _HIRE_DEFAULTS.items() if n not in hires.columns}
    income = F.col("monthly_income")
    filled = good.withColumns(missing).withColumns(
        {
            "employee_id": F.col("employee_number"),
            "first_name": F.trim("first_name"),
            "last_name": F.trim("last_name"),
            "email": F.trim("email"),
            "daily_rate": pay.daily_rate(income),
            "hourly_rate": pay.hourly_rate(income),
            "monthly_rate": pay.monthly_rate(income),
            "effective_start_date": F.lit(as_of),
            "effective_end_date": F.lit(S.OPEN_END),
            "is_current": F.lit(1),
            "change_reason": F.lit("New Hire"),
        }
    )
    # Whole currency units are stored; cast after the rates are worked out.
    filled = filled.withColumns(
        {
            "employee_name": text.full_name(F.col("first_name"), F.col("last_name")),
            "monthly_income": F.round(income).cast("int"),
        }
    )
    numbered = number_rows(filled, ["employee_id"], "_n").withColumns(
        {
            "employee_sk": F.col("_n") + F.lit(next_key(history, "employee_sk") - 1),
            "job_history_id": F.col("_n") + F.lit(next_key(history, "job_history_id") - 1),
        }
    )
    return Onboarded(
        employees=S.shaped(numbered, S.EMPLOYEES),
        history=S.shaped(numbered, S.JOB_HISTORY),
        dim_employee=S.shaped(numbered, S.DIM_EMPLOYEE),
        rejected=rejected,
    )


def _appended(good: DataFrame, existing: DataFrame | int, key: str, schema, *more: str) -> DataFrame:
    start = existing if isinstance(existing, int) else next_key(existing, key)
    keyed = number_rows(good, ["request_seq"], key, start=start)
    return S.shaped(keyed, schema) if not more else keyed.select(*schema.names, *more)


def _known(requests: DataFrame, column: str, parent: DataFrame, parent_column: str, mark: str) -> DataFrame:
    """Adds mark: whether the parent has the request's value; a NULL refers to nothing and is none."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct().withColumn(mark, F.lit(True))
    return lookup_join(requests, keys, [column], "left", spread_by=["request_seq"])


def _judged(requests: DataFrame, given: dict[str, Column], parents: list[tuple[str, DataFrame, str, str]]):
    """(good requests, rejected ones with first_broken): row rules first, then unknown references."""
    rows, marks = requests, []
    found = dict(given)
    for i, (column, parent, parent_column, reason) in enumerate(parents):
        rows = _known(rows, column, parent, parent_column, f"_known{i}")
        marks.append(f"_known{i}")
        found[reason] = F.col(column).isNotNull() & F.col(f"_known{i}").isNull()
    good, bad = rules.split_rows(rows, found)
    return good.drop(*marks).select(*requests.columns), bad.select(*requests.columns, "first_broken")


def create_projects(
    requests: DataFrame, projects: DataFrame, departments: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(new project rows, rejected requests); a department that is named must exist."""
    parents = [] if departments is None else [("department_id", departments, "department_id", "unknown department")]
    good, bad = _judged(requests, rules.project_rules(), parents)
    ended = good.withColumn("end_date", pay.closed_end(F.col("status"), F.col("end_date")))
    return _appended(ended, projects, "project_id", S.PROJECTS), bad


def create_assignments(
    requests: DataFrame, assignments: DataFrame, employees: DataFrame | None = None, projects: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(new assignment rows, rejected requests); employee and project must exist."""
    parents = []
    if employees is not None:
        parents.append(("employee_id", employees, "employee_id", "unknown employee"))
    if projects is not None:
        parents.append(("project_id", projects, "project_id", "unknown project"))
    good, bad = _judged(requests, rules.assignment_rules(), parents)
    return _appended(good, assignments, "assignment_id", S.ASSIGNMENTS), bad


def submit_reviews(
    requests: DataFrame, reviews: DataFrame | int, employees: DataFrame | None = None, *, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(new review rows, rejected requests). `reviews` is the table, or the next key where that is known.

    Reviewer 0 means none, and the form's five scores are not stored. The reviewed employee must
    exist and the rating lie between 1 and 5. `keep` names request columns to carry along.
    """
    parents = [] if employees is None else [("employee_id", employees, "employee_id", "unknown employee")]
    good, bad = _judged(requests, rules.review_rules(), parents)
    stored = good.withColumn("reviewer_id", F.nullif(F.col("reviewer_id"), F.lit(0)))
    scores = {f.name: F.lit(None).cast(f.dataType) for f in S.REVIEWS if f.name not in [*stored.columns, "review_id"]}
    return _appended(stored.withColumns(scores), reviews, "review_id", S.REVIEWS, *keep), bad
