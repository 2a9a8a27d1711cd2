"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.functions import text
from rosterlake.operators import checks
from rosterlake.operators.intervals import count_valid, latest_valid, match_valid
from rosterlake.operators.ordering import in_order, latest
from rosterlake.operators.skew import lookup_join, skew_join
from rosterlake.operators.versions import compare_with_previous
from rosterlake.plans import analytics, oltp, star
from rosterlake.registry.core import REGISTRY, add, define

c = F.col

add(
    "c01_join_trimmed_name",
    lambda w: lookup_join(
        w["staging_employees"].withColumn("department_name", F.trim("Department")), w["departments"], ["department_name"]
    ).select("employee_sk", "department_id"),
    """select s.employee_sk, d.department_id from staging_employees s
    join departments d on d.department_name = trim(s.Department)""",
)
add(
    "c02_join_two_columns",
    lambda w: oltp.with_lookups(w["staging_employees"], w["departments"], w["job_roles"]).select("employee_sk", "job_role_id"),
    """select s.employee_sk, j.job_role_id from staging_employees s
    join job_roles j on j.job_role_name = trim(s.JobRole) and j.job_level = s.JobLevel""",
)
add(
    "c03_star_of_lookups",
    lambda w: analytics.employee_listing(w["employees"], w["departments"], w["job_roles"]).select(
        "employee_id", "department_name", "job_role_name", "job_level"
    ),
    """select e.employee_id, d.department_name, j.job_role_name, j.job_level from employees e
    join departments d on d.department_id = e.department_id join job_roles j on j.job_role_id = e.job_role_id""",
)
add(
    "c04_left_lookup",
    lambda w: lookup_join(w["projects"], w["departments"], ["department_id"], "left").select(
        "project_id", "department_id", "department_name"
    ),
    """select p.project_id, p.department_id, d.department_name from projects p
    left join departments d on d.department_id = p.department_id""",
)
add(
    "c05_left_join_aggregated",
    lambda w: w["dim_employee"].select("employee_sk", "department_name").join(
        w["fact_performance_reviews"].groupBy("employee_sk").agg(
            F.count("*").alias("reviews"), F.sum("performance_rating").alias("rating_sum")
        ),
        "employee_sk",
        "left",
    ).groupBy("department_name").agg(
        F.count("*").alias("versions"),
        F.sum(F.greatest(F.coalesce("reviews", F.lit(0)), F.lit(1))).alias("joined_rows"),
        F.sum("rating_sum").alias("rating_sum"),
    ),
    """select de.department_name, count(distinct de.employee_sk) as versions, count(*) as joined_rows,
    cast(sum(f.performance_rating) as bigint) as rating_sum
    from dim_employee de left join fact_performance_reviews f on f.employee_sk = de.employee_sk group by de.department_name""",
)
add(
    "c06_two_left_joins",
    lambda w: analytics.project_load(w["projects"], w["departments"], w["assignments"]).select(
        "project_name", "department_name", "assigned_employees"
    ),
    """select p.project_name, coalesce(d.department_name, 'Unknown') as department_name, count(a.assignment_id) as assigned_employees
    from projects p left join departments d on d.department_id = p.department_id
    left join assignments a on a.project_id = p.project_id group by p.project_id, p.project_name, d.department_name""",
)
add(
    "c07_version_of_date",
    lambda w: match_valid(
        w["reviews"].select("review_id", "employee_id", "review_date"),
        w["dim_employee"].select("employee_id", "employee_sk", "effective_start_date", "effective_end_date"),
        "employee_id",
        "review_date",
        spread_by=["review_id"],
    ).select("review_id", "employee_sk"),
    """select r.review_id, de.employee_sk from reviews r join dim_employee de on de.employee_id = r.employee_id
    and r.review_date >= de.effective_start_date and r.review_date <= de.effective_end_date""",
)
# The way of keys too big for one task, taken by all keys.
add(
    "c07_version_of_date_by_nodes",
    lambda w: match_valid(
        w["reviews"].select("review_id", "employee_id", "review_date"),
        w["dim_employee"].select("employee_id", "employee_sk", "effective_start_date", "effective_end_date"),
        "employee_id",
        "review_date",
        spread_by=["review_id"],
        few=False,
    ).select("review_id", "employee_sk"),
    REGISTRY["c07_version_of_date"].sql,
)


def _valid_assignments(w):
    """How many assignments each review falls into, and the latest of them."""
    given = w["assignments"].select("employee_id", "assignment_id", "assigned_date", "end_date")
    spans = ("employee_id", "review_date", "assigned_date", "end_date")
    reviews = w["reviews"].select("review_id", "employee_id", "review_date")
    counted = count_valid(reviews, given, *spans, "valid_assignments", spread_by=["review_id"])
    return latest_valid(counted, given, *spans, ["assigned_date", "assignment_id"], ["assignment_id"], spread_by=["review_id"])


add(
    "c08_open_interval_left_join",
    lambda w: _valid_assignments(w).select("review_id", "valid_assignments", "assignment_id"),
    """select r.review_id, count(a.assignment_id) as valid_assignments,
    arg_max(a.assignment_id, struct_pack(d := a.assigned_date, i := a.assignment_id)) as assignment_id
    from reviews r left join assignments a on a.employee_id = r.employee_id and r.review_date >= a.assigned_date
    and (a.end_date is null or r.review_date <= a.end_date) group by r.review_id""",
)
add(
    "c09_latest_assignment",
    lambda w: star.latest_assignment(
        w["reviews"].select("review_id", "employee_id", "review_date"), w["assignments"], ["project_id"]
    ).select("review_id", "project_id"),
    "select review_id, project_id from review_project",
)
add(
    "c09_latest_assignment_by_nodes",
    lambda w: star.latest_assignment(
        w["reviews"].select("review_id", "employee_id", "review_date"), w["assignments"], ["project_id"], few=False
    ).select("review_id", "project_id"),
    REGISTRY["c09_latest_assignment"].sql,
)
add(
    "c10_anti_join_three_columns",
    lambda w: star.load_dim_employee(
        w["dim_employee"].filter("is_current = 1"),
        *w.many("employee_job_history", "employees", "departments", "job_roles"),
    ).select("employee_sk", "employee_id"),
    """select h.employee_sk, h.employee_id from employee_job_history h where not exists (
     select 1 from dim_employee de where de.is_current = 1 and de.employee_id = h.employee_id
     and de.effective_start_date = h.effective_start_date and de.effective_end_date = h.effective_end_date)""",
)
add(
    "c11_semi_join",
    lambda w: lookup_join(
        w["reviews"],
        w["dim_date"].filter("is_weekend = 1").select(c("full_date").alias("review_date")),
        ["review_date"],
        "left_semi",
    ).select("review_id", "review_date"),
    """select review_id, review_date from reviews r where exists (
     select 1 from dim_date d where d.full_date = r.review_date and d.is_weekend = 1)""",
)
add(
    "c12_scalar_lookup",
    lambda w: lookup_join(w["hires"], w["departments"], ["department_id"], "left").select(
        "employee_number", "department_name"
    ),
    """select employee_number, (select department_name from departments d where d.department_id = h.department_id) as department_name
    from hires h""",
)
add(
    "c13_join_on_name",
    lambda w: lookup_join(w["dim_employee"], w["dim_department"], ["department_name"]).select("employee_sk", "department_sk"),
    """select de.employee_sk, dd.department_sk from dim_employee de
    join dim_department dd on dd.department_name = de.department_name""",
)
add(
    "c14_join_date",
    lambda w: lookup_join(
        w["fact_performance_reviews"], w["dim_date"].select("date_sk", "full_date", "month_name"), ["date_sk"]
    ).select("review_sk", "full_date", "month_name"),
    """select f.review_sk, d.full_date, d.month_name from fact_performance_reviews f join dim_date d on d.date_sk = f.date_sk""",
)
add(
    "c15_computed_key",
    lambda w: lookup_join(
        w["employees"].select("employee_id", "department_id", (c("employee_id") % 3 + 1).alias("place")),
        in_order(w["projects"].select("project_id", "department_id"), ["department_id"], ["project_id"], number="place"),
        ["department_id", "place"],
    ).select("employee_id", "project_id"),
    """select e.employee_id, p.project_id from employees e join (select project_id, department_id,
     row_number() over (partition by department_id order by project_id) as place from projects) p
    on p.department_id = e.department_id and p.place = e.employee_id % 3 + 1""",
)
add(
    "c16_join_version_key",
    lambda w: w["employee_job_history"].join(
        w["staging_employees"].select("employee_sk", "OverTime", "EducationField"), "employee_sk"
    ).select("employee_sk", "job_history_id", "EducationField"),
    """select h.employee_sk, h.job_history_id, s.EducationField from employee_job_history h
    join staging_employees s on s.employee_sk = h.employee_sk""",
)
add(
    "c17_orphans",
    lambda w: checks.orphans(w["projects"], "department_id", w["departments"], "department_id"),
    """select p.department_id as key_value, count(*) as n_rows from projects p
    left join departments d on d.department_id = p.department_id
    where d.department_id is null and p.department_id is not null group by p.department_id""",
)
add(
    "c18_outside_current_version",
    # Every fact against its version: the facts of each version status, and how many lie outside their version.
    lambda w: checks.version_check(*w.many("fact_performance_reviews", "dim_employee", "dim_date")),
    """select is_current, count(*) as facts, cast(count_if(full_date < effective_start_date or full_date > effective_end_date) as bigint) as outside
    from fact_performance_reviews join dim_date using (date_sk) join dim_employee using (employee_sk) group by is_current""",
)
define(
    "key_figures",
    """select (select count(distinct employee_id) from dim_employee where is_current = 1) as total_employees,
 (select count(*) from fact_performance_reviews) as total_reviews, (select count(*) from dim_department) as departments,
 (select count(*) from dim_project) as projects, (select count(*) from dim_employee) as scd2_versions,
 (select round(avg(performance_rating), 2) from fact_performance_reviews) as avg_rating""",
)
add(
    "c19_one_row_of_aggregates",
    lambda w: analytics.key_figures(*w.many("dim_employee", "fact_performance_reviews", "dim_department", "dim_project")).select(
        "departments", "projects", "scd2_versions"
    ),
    "select departments, projects, scd2_versions from key_figures",
)
add(
    "c20_left_dimension",
    lambda w: lookup_join(
        star.latest_assignment(
            w["reviews"].select("review_id", "employee_id", "review_date"), w["assignments"], ["project_id"]
        ),
        w["dim_project"].select("project_id", "project_sk"),
        ["project_id"],
        "left",
    ).select("review_id", "project_sk"),
    """select v.review_id, p.project_sk from review_project v left join dim_project p on p.project_id = v.project_id""",
)

# Window functions

add(
    "e01_first_per_key",
    lambda w: latest(
        w["staging_employees"].select(F.trim("Department").alias("department"), "employee_sk", "employee_id"),
        ["department"],
        ["employee_sk"],
        smallest=True,
    ),
    """select department, employee_sk, employee_id from (select trim(Department) as department, employee_sk, employee_id,
     row_number() over (partition by trim(Department) order by employee_sk) as rn from staging_employees) x where rn = 1""",
)
add(
    "e02_latest_per_group",
    lambda w: latest(
        w["assignments"].select("employee_id", "assigned_date", "assignment_id", "project_id"),
        ["employee_id"],
        ["assigned_date", "assignment_id"],
    ),
    """select employee_id, assigned_date, assignment_id, project_id from (select *, row_number() over (
     partition by employee_id order by assigned_date desc, assignment_id desc) as rn from assignments) x where rn = 1""",
)
add(
    "e03_version_number",
    lambda w: in_order(
        w["employee_job_history"].select("employee_sk", "employee_id", "effective_start_date"),
        ["employee_id"],
        ["effective_start_date", "employee_sk"],
        number="version_num",
    ),
    """select employee_sk, employee_id, effective_start_date,
    row_number() over (partition by employee_id order by effective_start_date) as version_num from employee_job_history""",
)
add(
    "e04_group_size",
    lambda w: compare_with_previous(w["employee_job_history"], {}).select("employee_sk", "total_versions"),
    "select employee_sk, count(*) over (partition by employee_id) as total_versions from employee_job_history",
)
add(
    "e05_previous_values",
    lambda w: compare_with_previous(
        w["employee_job_history"],
        {"prev_department_id": "department_id", "prev_job_role_id": "job_role_id", "prev_income": "monthly_income"},
    ).select("employee_sk", "prev_department_id", "prev_job_role_id", "prev_income"),
    """select employee_sk, lag(department_id) over w as prev_department_id, lag(job_role_id) over w as prev_job_role_id,
    lag(monthly_income) over w as prev_income from employee_job_history
    window w as (partition by employee_id order by effective_start_date)""",
)
add(
    "e06_next_start",
    lambda w: in_order(
        w["employee_job_history"].select("employee_sk", "employee_id", "effective_start_date"),
        ["employee_id"],
        ["effective_start_date", "employee_sk"],
        following={"next_start_date": "effective_start_date"},
    ).select("employee_sk", "next_start_date"),
    """select employee_sk, lead(effective_start_date) over (partition by employee_id order by effective_start_date) as next_start_date
    from employee_job_history""",
)
