"""Readers, writers and table definitions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake import schemas as S
from rosterlake.operators.ordering import latest
from rosterlake.operators.parts import PartedTable
from rosterlake.operators.versions import update_rows
from rosterlake.plans.warehouse import Warehouse
from rosterlake.registry.core import REGISTRY, add
from rosterlake.session import new_path
from rosterlake.sources import calendar, files


def _through_csv(w: Warehouse, name: str, schema: T.StructType | None) -> DataFrame:
    path = new_path(w.spark, f"{name}-csv")
    files.write_csv(w[name], path)
    return files.read_csv(w.spark, path) if schema is None else files.load_csv(w.spark, path, schema)


add(
    "a01_csv_scan",
    lambda w: _through_csv(w, "raw_people", None),
    "select * replace (cast(EmployeeNumber as int) as EmployeeNumber, cast(DailyRate as int) as DailyRate) from raw_people",
)
add("a02_csv_staging", lambda w: _through_csv(w, "staging_employees", S.STAGING), "select * from staging_employees")
add("a03_csv_sink", lambda w: _through_csv(w, "employees", S.EMPLOYEES), "select * from employees")
add(
    "a04_parameter_query",
    lambda w: files.run_query(
        w.spark,
        "select employee_id, email, monthly_income from {employees} where attrition = :left and monthly_income >= :least",
        {"left": "Yes", "least": 5000},
        employees=w["employees"],
    ),
    "select employee_id, email, monthly_income from employees where attrition = 'Yes' and monthly_income >= 5000",
)


def _appended(w: Warehouse) -> DataFrame:
    history, path = w["employee_job_history"], new_path(w.spark, "appended")
    files.append(history.filter("is_current = 0"), path)
    files.append(history.filter("is_current = 1"), path)
    return w.spark.read.schema(history.schema).parquet(path)


add("a05_append", _appended, "select * from employee_job_history")


def _refreshed(w: Warehouse) -> DataFrame:
    """An older state, replaced by the whole table as it is now."""
    folder = new_path(w.spark, "dim_project")
    files.refresh(w["dim_project"].withColumn("status", F.lit("Planned")), folder)
    files.refresh(w["dim_project"], folder)
    return files.current(w.spark, folder, S.DIM_PROJECT)


add("a06_refresh", _refreshed, "select * from dim_project")
def _last_incomes(w):
    asked = w["changes"].select("employee_id", "change_seq", "monthly_income")
    return latest(asked, ["employee_id"], ["change_seq"]).drop("change_seq")


def _updated_parts(w):
    """The same update of a table in parts, of which only touched ones are written anew."""
    employees = w["employees"]
    table = PartedTable(w.spark, new_path(w.spark, "employees-in-parts"), employees.schema, ["employee_id"])
    table.create(employees)
    table.update(_last_incomes(w))
    return table.rows().select("employee_id", "email", "monthly_income")


add(
    "a07_keyed_update",
    lambda w: update_rows(
        w["employees"],
        _last_incomes(w),
        ["employee_id"],
    ).select("employee_id", "email", "monthly_income"),
    """select e.employee_id, e.email, case when c.employee_id is null then e.monthly_income else c.monthly_income end as monthly_income
    from employees e left join (select * from (select employee_id, monthly_income,
      row_number() over (partition by employee_id order by change_seq desc) as n from changes) x where n = 1) c
    on c.employee_id = e.employee_id""",
)
add("a07_keyed_update_of_parts", _updated_parts, REGISTRY["a07_keyed_update"].sql)
add(
    "a08_days_of_data",
    lambda w: calendar.days_of(w["reviews"], "review_date"),
    """select cast(unnest(generate_series(min(review_date), max(review_date), interval 1 day)) as date) as full_date
    from reviews""",
)
add(
    "a09_days_between",
    lambda w: calendar.days_between(w.spark, dt.date(1994, 1, 1), dt.date(2010, 12, 31)).join(
        w["reviews"].groupBy(F.col("review_date").alias("full_date")).agg(F.count("*").alias("n")), "full_date", "left"
    ).select("full_date", F.coalesce("n", F.lit(0)).alias("reviews")),
    """select d.full_date, coalesce(r.n, 0) as reviews from (select cast(unnest(generate_series(date '1994-01-01',
     date '2010-12-31', interval 1 day)) as date) as full_date) d
    left join (select review_date, count(*) as n from reviews group by review_date) r on r.review_date = d.full_date""",
)
add(
    "a10_literal_row",
    lambda w: w["dim_project"].unionByName(
        files.literal_rows(w.spark, [(0, -1, "No Project Assigned", None, None, None)], S.DIM_PROJECT)
    ),
    """select * from dim_project union all
    select 0, -1, 'No Project Assigned', cast(null as date), cast(null as date), cast(null as varchar)""",
)
add(
    "a11_preview",
    lambda w: files.preview(w["reviews"].orderBy("review_id"), 50).select(
        "review_id", "employee_id", "review_date", "performance_rating"
    ),
    "select review_id, employee_id, review_date, performance_rating from reviews order by review_id limit 50",
)

_DESCRIBED = ["dim_date", "dim_department", "dim_project", "dim_employee", "dim_assignment", "fact_performance_reviews"]

add(
    "a12_describe_tables",
    lambda w: files.describe_tables({t: w[t] for t in _DESCRIBED}).drop("data_type"),
    " union all ".join(
        f"select '{t}' as table_name, '{f.name}' as column_name, cast({i} as bigint) as ordinal, "
        f"count(*) as n_rows, count({f.name}) as n_values from {t}"
        for t in _DESCRIBED
        for i, f in enumerate(S.TABLES[t].fields, 1)
    ),
)
add(
    "a13_typed_table",
    lambda w: S.shaped(
        w["staging_employees"].select(*[F.col(c).cast("string").alias(c) for c in S.STAGING.names]), S.STAGING
    ),
    "select * from staging_employees",
)

_TIMELINE = [f for f in S.JOB_HISTORY.fields if f.name in {"effective_start_date", "effective_end_date", "is_current", "change_reason"}]

add(
    "a14_add_columns",
    lambda w: files.add_columns(
        w["employee_job_history"].select("employee_sk", "employee_id", "department_id", "monthly_income"), _TIMELINE
    ),
    """select employee_sk, employee_id, department_id, monthly_income, cast(null as date) as effective_start_date,
     cast(null as date) as effective_end_date, cast(null as int) as is_current, cast(null as varchar) as change_reason
    from employee_job_history""",
)
