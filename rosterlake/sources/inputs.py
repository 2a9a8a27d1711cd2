"""Workforce inputs derived from the general test tables.

Each text runs unchanged in Spark and as part of the checking SQL. Table names stand in braces.
Customers become employees, orders become reviews, parts become projects, line items become
assignments, events become change requests and reviews, suppliers become new hires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One row per employee with the 35 source columns, partly untrimmed.
PEOPLE = """
select
 cast(18 + c_custkey % 48 as int) as Age,
 case when c_acctbal < 0 then 'Yes' else 'No' end as Attrition,
 case c_custkey % 3 when 0 then 'Travel_Rarely' when 1 then 'Travel_Frequently' else 'Non-Travel' end as BusinessTravel,
 cast(1 + (c_custkey * 13) % 1500 as int) as DailyRate,
 case when c_custkey % 7 = 0 then concat(' ', c_mktsegment, ' ') else c_mktsegment end as Department,
 cast(1 + c_custkey % 29 as int) as DistanceFromHome,
 cast(1 + c_custkey % 5 as int) as Education,
 case c_custkey % 6 when 0 then 'Life Sciences' when 1 then 'Medical' when 2 then 'Marketing'
  when 3 then 'Technical Degree' when 4 then 'Human Resources' else 'Other' end as EducationField,
 cast(1 as int) as EmployeeCount,
 c_custkey as EmployeeNumber,
 cast(1 + (c_custkey + 1) % 4 as int) as EnvironmentSatisfaction,
 case when c_custkey % 2 = 0 then 'Female' else 'Male' end as Gender,
 cast(30 + c_custkey % 71 as int) as HourlyRate,
 cast(1 + (c_custkey + 2) % 4 as int) as JobInvolvement,
 cast(1 + c_custkey % 5 as int) as JobLevel,
 case when c_custkey % 11 = 0 then concat('Role ', cast(c_nationkey % 9 as string), '  ')
  else concat('Role ', cast(c_nationkey % 9 as string)) end as JobRole,
 cast(1 + c_custkey % 4 as int) as JobSatisfaction,
 case c_custkey % 3 when 0 then 'Single' when 1 then 'Married' else 'Divorced' end as MaritalStatus,
 cast(1000 + (c_custkey * 37) % 19000 as int) as MonthlyIncome,
 cast(2000 + (c_custkey * 53) % 25000 as int) as MonthlyRate,
 cast(c_custkey % 10 as int) as NumCompaniesWorked,
 'Y' as Over18,
 case when c_custkey % 4 = 0 then 'Yes' else 'No' end as OverTime,
 cast(11 + c_custkey % 15 as int) as PercentSalaryHike,
 case when c_custkey % 17 = 0 then null else cast(1 + c_custkey % 5 as int) end as PerformanceRating,
 cast(1 + (c_custkey + 3) % 4 as int) as RelationshipSatisfaction,
 cast(80 as int) as StandardHours,
 cast(c_custkey % 4 as int) as StockOptionLevel,
 cast(c_custkey % 40 as int) as TotalWorkingYears,
 cast(c_custkey % 7 as int) as TrainingTimesLastYear,
 cast(1 + c_custkey % 4 as int) as WorkLifeBalance,
 cast(floor((c_custkey % 40) / 2) as int) as YearsAtCompany,
 cast(floor((c_custkey % 40) / 4) as int) as YearsInCurrentRole,
 cast(c_custkey % 15 as int) as YearsSinceLastPromotion,
 cast(c_custkey % 17 as int) as YearsWithCurrManager,
 case when c_custkey % 10 = 0 then c_name else concat(c_mktsegment, ' ', c_name) end as EmployeeName,
 concat('u', cast(c_custkey as string), '@example.com') as Email,
 c_custkey as employee_id
from {customer}
"""

_SOURCE_NAMES = (
    "Age Attrition BusinessTravel DailyRate Department DistanceFromHome Education EducationField EmployeeCount "
    "EmployeeNumber EnvironmentSatisfaction Gender HourlyRate JobInvolvement JobLevel JobRole JobSatisfaction "
    "MaritalStatus MonthlyIncome MonthlyRate NumCompaniesWorked Over18 OverTime PercentSalaryHike PerformanceRating "
    "RelationshipSatisfaction StandardHours StockOptionLevel TotalWorkingYears TrainingTimesLastYear WorkLifeBalance "
    "YearsAtCompany YearsInCurrentRole YearsSinceLastPromotion YearsWithCurrManager"
).split()

# What an earlier version of an employee looked like.
_EARLIER = {
    "Department": (
        "case when employee_id % 4 <> 2 then Department else case trim(Department) when 'AUTOMOBILE' then 'BUILDING' "
        "when 'BUILDING' then 'FURNITURE' when 'FURNITURE' then 'HOUSEHOLD' when 'HOUSEHOLD' then 'MACHINERY' "
        "else 'AUTOMOBILE' end end"
    ),
    "JobLevel": "cast(case when JobLevel > 1 then JobLevel - 1 else 1 end as int)",
    "MonthlyIncome": "cast(MonthlyIncome - 500 as int)",
}

_EARLIER_COLUMNS = ", ".join(f"{_EARLIER.get(n, n)} as {n}" for n in _SOURCE_NAMES)

# All employee versions: the current one of everybody, plus an earlier one for three in ten.
STAGING = f"""
select {", ".join(_SOURCE_NAMES)}, EmployeeName, Email, employee_id, 2 * employee_id + 1 as employee_sk,
 date '1998-01-01' as effective_start_date, date '9999-12-31' as effective_end_date,
 cast(1 as int) as is_current, 'Current Record' as change_reason
from {{people}}
union all
select {_EARLIER_COLUMNS}, EmployeeName, Email, employee_id, 2 * employee_id as employee_sk,
 cast(date '1998-01-01' - interval '1' month * cast(12 + employee_id % 25 as int) as date) as effective_start_date,
 date '1997-12-31' as effective_end_date, cast(0 as int) as is_current,
 case employee_id % 4 when 0 then 'Promotion' when 1 then 'Salary Revision' when 2 then 'Department Transfer'
  else 'Role Change' end as change_reason
from {{people}} where employee_id % 10 < 3
"""

# A source file as it may arrive: a misspelt column, outer blanks, numbers as text with junk.
RAW_PEOPLE = f"""
select {", ".join(
    "case when EmployeeNumber % 13 = 0 then 'n/a' else cast(Age as string) end as Age" if n == "Age"
    else "case when EmployeeNumber % 19 = 0 then null else cast(DailyRate as string) end as DailyRate" if n == "DailyRate"
    else "YearsWithCurrManager as YearsWithCurrManaer" if n == "YearsWithCurrManager"
    else n for n in _SOURCE_NAMES)}
from {{people}}
"""

REVIEWS = """
select o_orderkey as review_id, o_custkey as employee_id, cast(null as bigint) as reviewer_id,
 cast(o_orderdate as date) as review_date, cast(substring(o_orderpriority, 1, 1) as int) as performance_rating,
 cast(null as int) as environment_satisfaction, cast(null as int) as job_involvement,
 cast(null as int) as job_satisfaction, cast(null as int) as relationship_satisfaction,
 cast(null as int) as work_life_balance, cast(null as int) as percent_salary_hike,
 cast(null as int) as training_times_last_year
from {orders}
"""

PROJECTS = """
select p_partkey as project_id, concat(p_name, ' ', cast(p_partkey as string)) as project_name,
 cast(1 + p_partkey % 6 as bigint) as department_id, date '1995-01-01' as start_date, cast(null as date) as end_date,
 case p_partkey % 4 when 0 then 'Active' when 1 then 'In Progress' when 2 then 'Completed' else 'On Hold' end as status
from {part}
"""

ASSIGNMENTS = """
select l_orderkey as assignment_id, o_custkey as employee_id, min(l_partkey) as project_id,
 'Contributor' as role_on_project, cast(5 * (1 + l_orderkey % 20) as decimal(5,2)) as allocation_ratio,
 cast(min(l_shipdate) as date) as assigned_date,
 case when l_orderkey % 3 = 0 then cast(null as date) else cast(max(l_shipdate) as date) end as end_date
from {lineitem} join {orders} on o_orderkey = l_orderkey group by l_orderkey, o_custkey
"""

# Change requests: several per employee and day, some for roles that do not exist.
CHANGES = """
select user_id as employee_id, cast(ts as date) as change_date, event_id as change_seq,
 cast(1 + event_id % 5 as bigint) as department_id, concat('Role ', cast(event_id % 10 as string)) as job_role_name,
 cast(1 + event_id % 5 as int) as job_level, cast(1000 + floor(value * 10) as int) as monthly_income,
 case event_type when 'click' then 'Department Transfer' when 'view' then 'Role Change'
  when 'purchase' then 'Promotion' when 'signup' then 'Restructuring' else 'Internal Move' end as change_reason
from {events}
"""

# Review submissions; reviewer 0 stands for none.
REVIEW_REQUESTS = """
select user_id as employee_id, event_id % 3 as reviewer_id, cast(ts as date) as review_date,
 cast(1 + event_id % 5 as int) as performance_rating, event_id as request_seq from {events}
"""

# New hires, several of them breaking one or more onboarding rules.
HIRES = """
select 10000000 + s_suppkey as employee_number,
 case when s_suppkey % 13 = 0 then '  ' when s_suppkey % 17 = 0 then 'Ann2' else 'Ann' end as first_name,
 case when s_suppkey % 19 = 0 then cast(null as string) else concat('Hire', chr(cast(65 + s_suppkey % 26 as int))) end as last_name,
 case when s_suppkey % 11 = 0 then 'nowhere' else concat('hire', cast(s_suppkey as string), '@example.com') end as email,
 cast(1 + s_suppkey % 6 as bigint) as department_id, concat('Role ', cast(s_nationkey % 10 as string)) as job_role,
 cast(1 + s_suppkey % 5 as int) as job_level,
 case when s_acctbal < 0 then 0.0 else s_acctbal end as monthly_income,
 cast(16 + s_suppkey % 50 as int) as age, case when s_suppkey % 2 = 0 then 'Female' else 'Male' end as gender,
 'Single' as marital_status, cast(3 as int) as education,
 case when s_suppkey % 23 = 0 then ' ' else 'Medical' end as education_field,
 cast(s_suppkey % 30 as int) as distance_from_home, cast(s_suppkey % 5 as int) as num_companies_worked,
 cast(s_suppkey % 12 as int) as total_working_years, cast(s_suppkey % 7 as int) as years_at_company,
 cast(s_suppkey % 6 as int) as years_in_current_role
from {supplier}
"""

PROJECT_REQUESTS = """
select p_partkey as request_seq, case when p_partkey % 9 = 0 then ' ' else concat('New ', p_name, ' ', cast(p_partkey as string)) end as project_name,
 cast(1 + p_partkey % 5 as bigint) as department_id, date '2024-03-01' as start_date,
 case p_partkey % 4 when 0 then cast(null as date) when 1 then date '2024-02-01' else date '2024-12-31' end as end_date,
 case p_partkey % 3 when 0 then 'Active' when 1 then 'Completed' else 'On Hold' end as status
from {part}
"""

ASSIGNMENT_REQUESTS = """
select o_orderkey as request_seq, o_custkey as employee_id, o_orderkey % 500 as project_id,
 case when o_orderkey % 21 = 0 then '' else 'Lead' end as role_on_project,
 cast(o_orderkey % 110 as decimal(5,2)) as allocation_ratio, cast(o_orderdate as date) as assigned_date,
 case o_orderkey % 4 when 0 then cast(null as date) when 1 then cast('1994-01-01' as date)
  else cast('2005-01-01' as date) end as end_date
from {orders}
"""

# Versions with faults for the checks to find: repeated keys, overlaps, other open ends, starts
# after ends, missing current versions and blank reasons.
DIRTY_VERSIONS = """
select employee_id, Email,
 case when employee_id % 30 = 1 then employee_sk - employee_sk % 2 else employee_sk end as employee_sk,
 case when employee_id % 43 = 2 and is_current = 0 then date '1999-01-01' else effective_start_date end as effective_start_date,
 case when employee_id % 40 = 2 and is_current = 0 then date '1998-01-01'
  when employee_id % 41 = 3 and is_current = 1 then date '2099-12-31' else effective_end_date end as effective_end_date,
 cast(case when employee_id % 47 = 5 then 0 else is_current end as int) as is_current,
 case when employee_id % 20 = 11 then ' ' when employee_id % 20 = 12 then null else change_reason end as change_reason
from {staging_employees}
"""

INPUTS: dict[str, str] = {
    "people": PEOPLE,
    "raw_people": RAW_PEOPLE,
    "staging_employees": STAGING,
    "reviews": REVIEWS,
    "projects": PROJECTS,
    "assignments": ASSIGNMENTS,
    "dirty_versions": DIRTY_VERSIONS,
    "changes": CHANGES,
    "review_requests": REVIEW_REQUESTS,
    "hires": HIRES,
    "project_requests": PROJECT_REQUESTS,
    "assignment_requests": ASSIGNMENT_REQUESTS,
}

_BASE = ["customer", "orders", "part", "lineitem", "events", "supplier"]


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input as a DataFrame over the parquet files in sf_dir."""
    text = INPUTS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _BASE if f"{{{t}}}" in text}
    if "customer" in tables:
        # A customer takes few bytes, so a task or two read very many, but an employee has 37 columns.
        tables["customer"] = tables["customer"].repartition("c_custkey")
    tables |= {t: derive(spark, sf_dir, t) for t in ("people", "staging_employees") if f"{{{t}}}" in text}
    return spark.sql(text, **tables)
