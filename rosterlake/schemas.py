"""Declared tables: columns, types, text lengths, keys and foreign keys."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The one open end used here, and an older one found in source data.
OPEN_END = dt.date(9999, 12, 31)
OTHER_OPEN_END = dt.date(2099, 12, 31)


def normalise_open_end(end: Column) -> Column:
    """Map every open-end sentinel to OPEN_END."""
    return F.when(end == F.lit(OTHER_OPEN_END), F.lit(OPEN_END)).otherwise(end)


def _whole(*names: str, required: bool = False) -> list[T.StructField]:
    return [T.StructField(n, T.IntegerType(), not required) for n in names]


def _ids(*names: str, required: bool = False) -> list[T.StructField]:
    return [T.StructField(n, T.LongType(), not required) for n in names]


def _text(length: int, *names: str, required: bool = False) -> list[T.StructField]:
    return [T.StructField(n, T.StringType(), not required, {"length": length}) for n in names]


def _dates(*names: str, required: bool = False) -> list[T.StructField]:
    return [T.StructField(n, T.DateType(), not required) for n in names]


def _ratio(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DecimalType(5, 2), True) for n in names]


def _schema(*groups: list[T.StructField]) -> T.StructType:
    return T.StructType([field for group in groups for field in group])


_VALIDITY = [
    *_dates("effective_start_date", "effective_end_date", required=True),
    *_whole("is_current", required=True),
]

# The 35 source columns, in their fixed order.
SOURCE = _schema(
    _whole("Age"), _text(10, "Attrition"), _text(50, "BusinessTravel"), _whole("DailyRate"),
    _text(100, "Department"), _whole("DistanceFromHome", "Education"), _text(100, "EducationField"),
    _whole("EmployeeCount"), _ids("EmployeeNumber"), _whole("EnvironmentSatisfaction"),
    _text(20, "Gender"), _whole("HourlyRate", "JobInvolvement", "JobLevel"), _text(100, "JobRole"),
    _whole("JobSatisfaction"), _text(30, "MaritalStatus"),
    _whole("MonthlyIncome", "MonthlyRate", "NumCompaniesWorked"), _text(5, "Over18", "OverTime"),
    _whole("PercentSalaryHike", "PerformanceRating", "RelationshipSatisfaction", "StandardHours",
           "StockOptionLevel", "TotalWorkingYears", "TrainingTimesLastYear", "WorkLifeBalance",
           "YearsAtCompany", "YearsInCurrentRole", "YearsSinceLastPromotion", "YearsWithCurrManager"),
)

# One row per employee version: 35 source columns and 8 added ones.
STAGING = _schema(
    SOURCE.fields, _text(100, "EmployeeName"), _text(150, "Email"),
    _ids("employee_id", "employee_sk", required=True), _VALIDITY, _text(100, "change_reason"),
)

DEPARTMENTS = _schema(_ids("department_id", required=True), _text(100, "department_name", required=True))

JOB_ROLES = _schema(
    _ids("job_role_id", required=True), _text(100, "job_role_name", required=True),
    _whole("job_level", required=True),
)

EMPLOYEES = _schema(
    _ids("employee_id", "employee_number", required=True), _text(100, "employee_name"),
    _text(50, "first_name", "last_name"), _text(150, "email"), _whole("age"), _text(20, "gender"),
    _text(30, "marital_status"), _whole("education"), _text(100, "education_field"),
    _whole("distance_from_home", "num_companies_worked", "total_working_years", "years_at_company",
           "years_in_current_role"),
    _text(10, "attrition"), _text(50, "business_travel"), _text(5, "over_time"),
    _whole("stock_option_level", "percent_salary_hike", "environment_satisfaction", "job_involvement",
           "job_satisfaction", "relationship_satisfaction", "work_life_balance",
           "training_times_last_year", "monthly_income", "daily_rate", "hourly_rate", "monthly_rate",
           "employee_count", "standard_hours"),
    _text(5, "over_18"), _ids("department_id", "job_role_id", "manager_id"),
)

JOB_HISTORY = _schema(
    _ids("job_history_id", "employee_sk", "employee_id", "department_id", "job_role_id", required=True),
    _whole("job_level", required=True), _whole("monthly_income", "daily_rate", "hourly_rate", "monthly_rate"),
    _text(50, "business_travel"), _text(5, "over_time"),
    _whole("stock_option_level", "percent_salary_hike", "years_in_current_role",
           "years_since_last_promotion", "years_with_curr_manager"),
    _VALIDITY, _text(100, "change_reason"),
)

REVIEWS = _schema(
    _ids("review_id", "employee_id", required=True), _ids("reviewer_id"),
    _dates("review_date", required=True),
    _whole("performance_rating", "environment_satisfaction", "job_involvement", "job_satisfaction",
           "relationship_satisfaction", "work_life_balance", "percent_salary_hike",
           "training_times_last_year"),
)

PROJECTS = _schema(
    _ids("project_id", required=True), _text(150, "project_name", required=True), _ids("department_id"),
    _dates("start_date", "end_date"), _text(50, "status"),
)

ASSIGNMENTS = _schema(
    _ids("assignment_id", "employee_id", "project_id", required=True), _text(100, "role_on_project"),
    _ratio("allocation_ratio"), _dates("assigned_date", required=True), _dates("end_date"),
)

DIM_DATE = _schema(
    _whole("date_sk", required=True), _dates("full_date", required=True), _whole("day", "month"),
    _text(20, "month_name"), _whole("quarter", "year", "is_weekend"),
)

DIM_DEPARTMENT = _schema(
    _ids("department_sk", "department_id", required=True), _text(100, "department_name", required=True)
)

DIM_PROJECT = _schema(
    _ids("project_sk", "project_id", required=True), _text(150, "project_name"),
    _dates("start_date", "end_date"), _text(50, "status"),
)

DIM_EMPLOYEE = _schema(
    _ids("employee_sk", "employee_id", required=True), _text(100, "department_name", required=True),
    _text(50, "first_name", "last_name"), _text(150, "email"), _whole("age"), _text(20, "gender"),
    _text(30, "marital_status"), _text(100, "education_field", "job_role"),
    _whole("job_level", "monthly_income", "daily_rate", "hourly_rate"), _text(50, "business_travel"),
    _whole("distance_from_home", "years_with_curr_manager", "years_since_last_promotion",
           "years_at_company"),
    _text(10, "attrition"), _ids("manager_id"), _text(100, "change_reason"), _VALIDITY,
)

DIM_ASSIGNMENT = _schema(
    _ids("assignment_sk", "assignment_id", "employee_sk", "project_sk", required=True),
    _text(100, "role_on_project"), _ratio("allocation_ratio"), _dates("assigned_date", "end_date"),
)

FACT_REVIEWS = _schema(
    _ids("review_sk", "employee_sk", "department_sk", required=True), _ids("project_sk"),
    _whole("date_sk", required=True), _ids("review_id"), _whole("performance_rating"),
)

TABLES: dict[str, T.StructType] = {
    "staging_employees": STAGING,
    "departments": DEPARTMENTS,
    "job_roles": JOB_ROLES,
    "employees": EMPLOYEES,
    "employee_job_history": JOB_HISTORY,
    "reviews": REVIEWS,
    "projects": PROJECTS,
    "assignments": ASSIGNMENTS,
    "dim_date": DIM_DATE,
    "dim_department": DIM_DEPARTMENT,
    "dim_project": DIM_PROJECT,
    "dim_employee": DIM_EMPLOYEE,
    "dim_assignment": DIM_ASSIGNMENT,
    "fact_performance_reviews": FACT_REVIEWS,
}

# Every set of columns whose values may not repeat.
UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "staging_employees": [["employee_sk"]],
    "departments": [["department_id"], ["department_name"]],
    "job_roles": [["job_role_id"], ["job_role_name", "job_level"]],
    "employees": [["employee_id"], ["employee_number"], ["email"]],
    "employee_job_history": [["job_history_id"], ["employee_sk"]],
    "reviews": [["review_id"]],
    "projects": [["project_id"]],
    "assignments": [["assignment_id"]],
    "dim_date": [["date_sk"], ["full_date"]],
    "dim_department": [["department_sk"], ["department_id"], ["department_name"]],
    "dim_project": [["project_sk"], ["project_id"]],
    "dim_employee": [["employee_sk"]],
    "dim_assignment": [["assignment_sk"], ["assignment_id"]],
    "fact_performance_reviews": [["review_sk"], ["review_id", "employee_sk"]],
}


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    target: str
    target_column: str


FOREIGN_KEYS = [
    ForeignKey("employees", "department_id", "departments", "department_id"),
    ForeignKey("employees", "job_role_id", "job_roles", "job_role_id"),
    ForeignKey("employee_job_history", "employee_id", "employees", "employee_id"),
    ForeignKey("employee_job_history", "department_id", "departments", "department_id"),
    ForeignKey("employee_job_history", "job_role_id", "job_roles", "job_role_id"),
    ForeignKey("reviews", "employee_id", "employees", "employee_id"),
    ForeignKey("reviews", "reviewer_id", "employees", "employee_id"),
    ForeignKey("projects", "department_id", "departments", "department_id"),
    ForeignKey("assignments", "employee_id", "employees", "employee_id"),
    ForeignKey("assignments", "project_id", "projects", "project_id"),
    ForeignKey("dim_assignment", "employee_sk", "dim_employee", "employee_sk"),
    ForeignKey("dim_assignment", "project_sk", "dim_project", "project_sk"),
    ForeignKey("fact_performance_reviews", "employee_sk", "dim_employee", "employee_sk"),
    ForeignKey("fact_performance_reviews", "department_sk", "dim_department", "department_sk"),
    ForeignKey("fact_performance_reviews", "project_sk", "dim_project", "project_sk"),
    ForeignKey("fact_performance_reviews", "date_sk", "dim_date", "date_sk"),
]


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns in order, each cast to its declared type (bad values raise)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
