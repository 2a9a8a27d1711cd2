"""Loads of the current-state tables and the star, and batch writes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.operators.parts import PartedTable
from rosterlake.operators.skew import lookup_join
from rosterlake.operators.versions import (
    apply_to_dimension,
    apply_to_employees,
    apply_to_history,
    judge_changes,
    mark_attrition,
)
from rosterlake.plans import analytics, oltp, star
from rosterlake.registry.core import REGISTRY, add, define
from rosterlake.session import new_path, written

c = F.col
STAGED = ["staging_employees", "departments", "job_roles"]
AS_OF = dt.date(2024, 2, 1)

add("j01_departments", lambda w: oltp.load_departments(w["staging_employees"]), "select * from departments")
add("j02_job_roles", lambda w: oltp.load_job_roles(w["staging_employees"]), "select * from job_roles")
add("j03_employees", lambda w: oltp.load_employees(*w.many(*STAGED)), "select * from employees")
add("j04_job_history", lambda w: oltp.load_job_history(*w.many(*STAGED)), "select * from employee_job_history")

_REVIEW = """select row_number() over (order by employee_id, effective_start_date, employee_sk) as review_id, employee_id,
 cast(null as bigint) as reviewer_id, effective_start_date as review_date, PerformanceRating as performance_rating,
 EnvironmentSatisfaction as environment_satisfaction, JobInvolvement as job_involvement, JobSatisfaction as job_satisfaction,
 RelationshipSatisfaction as relationship_satisfaction, WorkLifeBalance as work_life_balance,
 PercentSalaryHike as percent_salary_hike, TrainingTimesLastYear as training_times_last_year from staging_employees """

add("j05_reviews_current", lambda w: oltp.load_reviews(w["staging_employees"]), _REVIEW + "where is_current = 1")
add(
    "j05_reviews_all_versions",
    lambda w: oltp.load_reviews(w["staging_employees"], current_only=False),
    _REVIEW + "where PerformanceRating is not null",
)
add("j06_dim_department", lambda w: star.load_dim_department(w["departments"]), "select * from dim_department")
add(
    "j06_dim_department_deduplicated",
    lambda w: star.load_dim_department(
        w["staging_employees"].select(c("employee_sk").alias("department_id"), c("Department").alias("department_name")),
        deduplicate=True,
    ),
    """select row_number() over (order by department_id) as department_sk, department_id, department_name from (
     select trim(Department) as department_name, min(employee_sk) as department_id from staging_employees
     where Department is not null group by trim(Department)) x""",
)
add("j07_dim_project", lambda w: star.load_dim_project(w["projects"]), "select * from dim_project")
add(
    "j07_dim_project_sentinel",
    lambda w: star.load_dim_project(w["projects"], sentinel=True),
    """select * from dim_project union all
    select 1, -1, 'No Project Assigned', null, null, null where not exists (select 1 from projects)""",
)
add("j08_dim_date", lambda w: star.load_dim_date(w["reviews"]), "select * from dim_date")
add(
    "j08_dim_date_fixed",
    # The fixed calendar, with the reviews that fall on each of its days.
    lambda w: lookup_join(
        star.load_fixed_dim_date(w.spark, dt.date(1995, 1, 1), dt.date(2030, 12, 31)),
        w["reviews"].groupBy(c("review_date").alias("full_date")).agg(F.count("*").alias("reviews")),
        ["full_date"],
        "left",
    ).select("date_sk", "full_date", "month_name", "quarter", "is_weekend", F.coalesce("reviews", F.lit(0)).alias("reviews")),
    """select cast(strftime(d, '%Y%m%d') as int) as date_sk, d as full_date, monthname(d) as month_name,
    cast(quarter(d) as int) as quarter, cast(case when isodow(d) >= 6 then 1 else 0 end as int) as is_weekend,
    coalesce(n, 0) as reviews
    from (select cast(unnest(generate_series(date '1995-01-01', date '2030-12-31', interval 1 day)) as date) as d) x
    left join (select review_date, count(*) as n from reviews group by review_date) r on r.review_date = d""",
)
DIMENSION = ["employee_job_history", "employees", "departments", "job_roles"]
add("j09_dim_employee", lambda w: star.load_dim_employee(None, *w.many(*DIMENSION)), "select * from dim_employee")
add(
    "j09_dim_employee_incremental",
    lambda w: star.load_dim_employee(w["dim_employee"].filter("is_current = 0"), *w.many(*DIMENSION)),
    """select * from dim_employee d where not exists (select 1 from dim_employee o where o.is_current = 0
     and o.employee_id = d.employee_id and o.effective_start_date = d.effective_start_date
     and o.effective_end_date = d.effective_end_date)""",
)
define(
    "dim_employee_outrigger",
    """select h.employee_sk, h.employee_id, dd.department_sk, e.first_name, e.last_name, e.gender, e.education_field,
 j.job_role_name as job_role, h.job_level, h.monthly_income, h.daily_rate, h.hourly_rate, s.employee_id as manager_id,
 coalesce(trim(h.change_reason), 'Initial Onboarding') as change_reason, h.effective_start_date, h.effective_end_date, h.is_current,
 row_number() over w as version_num, count(*) over (partition by h.employee_id) as total_versions,
 lag(h.department_id) over w as prev_department_id, lag(j.job_role_name) over w as prev_job_role,
 lag(h.monthly_income) over w as prev_income
from employee_job_history h join employees e on e.employee_id = h.employee_id
join job_roles j on j.job_role_id = h.job_role_id join staging_employees s on s.employee_sk = h.employee_sk
join dim_department dd on dd.department_id = h.department_id
where h.effective_start_date is not null
window w as (partition by h.employee_id order by h.effective_start_date)""",
)


def _outrigger(w):
    managers = w["staging_employees"].select("employee_sk", c("employee_id").alias("manager_id"))
    return star.load_dim_employee_outrigger(*w.many("employee_job_history", "employees", "job_roles"), managers, w["dim_department"])


add("j10_dim_employee_outrigger", _outrigger, "select * from dim_employee_outrigger")
add(
    "j11_dim_assignment",
    lambda w: star.load_dim_assignment(*w.many("assignments", "dim_employee", "dim_project")),
    "select * from dim_assignment",
)
STAR_INPUTS = ["reviews", "dim_employee", "dim_department", "dim_date", "assignments", "dim_project"]
add(
    "j12_fact_reviews",
    lambda w: star.load_fact_reviews(*w.many(*STAR_INPUTS)),
    "select * from fact_performance_reviews",
)
add(
    "j13_fact_reviews_ranked",
    lambda w: star.load_fact_reviews_ranked(
        w["reviews"],
        lookup_join(w["dim_employee"], w["dim_department"], ["department_name"]),
        w["dim_date"],
    ),
    """select review_id, employee_sk, department_sk, cast(null as bigint) as project_sk, date_sk, performance_rating, review_sequence,
     avg(performance_rating) over (partition by department_sk) as dept_avg_rating,
     rank() over (partition by department_sk order by performance_rating desc) as dept_rating_rank
    from (select r.review_id, de.employee_sk, dd.department_sk, cast(strftime(r.review_date, '%Y%m%d') as int) as date_sk,
      r.performance_rating, r.review_sequence
     from (select *, dense_rank() over (partition by employee_id order by review_date) as review_sequence from reviews
      where review_date is not null and performance_rating is not null
      and exists (select 1 from dim_date d where d.full_date = review_date)) r
     join dim_employee de on de.employee_id = r.employee_id and r.review_date between de.effective_start_date and de.effective_end_date
     join dim_department dd on dd.department_name = de.department_name) x""",
)
STAR = ["dim_department", "dim_project", "dim_date", "dim_employee", "dim_assignment", "fact_performance_reviews"]
add(
    "j14_whole_star",
    lambda w: star.star_counts(
        star.load_star({t: w[t] for t in ("departments", "projects", "reviews", "assignments", *DIMENSION)})
    ),
    " union all ".join(
        f"select '{t}' as table_name, count(*) as row_count, case when count(*) > 0 then 'loaded' else 'empty' end as status from {t}"
        for t in STAR
    ),
)


def _onboarded(w):
    return oltp.onboard(*w.many("hires", "employee_job_history", "departments", "job_roles"), AS_OF, w["employees"])


define(
    "onboarded",
    """select (select max(employee_sk) from employee_job_history) + row_number() over (order by employee_number) as employee_sk,
 employee_number as employee_id, department_name, trim(first_name) as first_name, trim(last_name) as last_name,
 trim(email) as email, age, gender, marital_status, education_field, job_role, job_level,
 cast(round(monthly_income, 0) as int) as monthly_income,
 greatest(1, cast(round_even(monthly_income / 22, 0) as int)) as daily_rate,
 greatest(1, cast(round_even(greatest(1, cast(round_even(monthly_income / 22, 0) as int)) / 8.0, 0) as int)) as hourly_rate,
 'Non-Travel' as business_travel, distance_from_home, cast(0 as int) as years_with_curr_manager,
 cast(0 as int) as years_since_last_promotion, years_at_company, 'No' as attrition, cast(null as bigint) as manager_id,
 'New Hire' as change_reason, date '2024-02-01' as effective_start_date, date '9999-12-31' as effective_end_date,
 cast(1 as int) as is_current
from checked_hires where first_broken is null""",
)
add("j15_onboarding", lambda w: _onboarded(w).dim_employee, "select * from onboarded")
add(
    "j15_onboarding_rejects",
    lambda w: _onboarded(w).rejected.select("employee_number", "first_broken"),
    "select employee_number, first_broken from checked_hires where first_broken is not null",
)



def _onboarded_again(w):
    """The batch sent twice at once: every acceptable request is there twice, and one of the two is refused."""
    hires = w["hires"]
    return oltp.onboard(hires.unionByName(hires), *w.many("employee_job_history", "departments", "job_roles"), AS_OF, w["employees"])


add(
    "j15_onboarding_repeated",
    lambda w: _onboarded_again(w).rejected.groupBy("first_broken").agg(F.count("*").alias("n_rows")),
    """select coalesce(first_broken, 'employee number is repeated') as first_broken,
    cast(sum(case when first_broken is null then 1 else 2 end) as bigint) as n_rows from checked_hires group by 1""",
)

define(
    "judged_changes",
    """select d.*, r.job_role_id, dep.department_name, cur.current_start
from (select * from (select *, row_number() over (partition by employee_id, change_date order by change_seq desc) as n from changes) y
 where n = 1) d
left join job_roles r on r.job_role_name = d.job_role_name and r.job_level = d.job_level
left join departments dep on dep.department_id = d.department_id
left join (select employee_id, max(effective_start_date) as current_start from employee_job_history where is_current = 1
 group by employee_id) cur on cur.employee_id = d.employee_id""",
)
define(
    "accepted_changes",
    """select *, lead(change_date) over (partition by employee_id order by change_date) as next_date,
 (select max(employee_sk) from employee_job_history) + row_number() over (order by employee_id, change_date) as employee_sk,
 (select max(job_history_id) from employee_job_history) + row_number() over (order by employee_id, change_date) as job_history_id,
 greatest(1, cast(round_even(monthly_income / 22.0, 0) as int)) as daily_rate,
 greatest(1, cast(round_even(greatest(1, cast(round_even(monthly_income / 22.0, 0) as int)) / 8.0, 0) as int)) as hourly_rate
from judged_changes where job_role_id is not null and department_name is not null and change_date > current_start""",
)
define(
    "first_changes",
    "select employee_id, min(change_date) as first_date from accepted_changes group by employee_id",
)
define(
    "moved",
    "select employee_id, department_id, job_role_id from accepted_changes where next_date is null",
)
define(
    "changed_history",
    """select h.job_history_id, h.employee_sk, h.employee_id, h.department_id, h.job_role_id, h.job_level, h.monthly_income,
 h.daily_rate, h.hourly_rate, h.monthly_rate, h.business_travel, h.over_time, h.stock_option_level, h.percent_salary_hike,
 h.years_in_current_role, h.years_since_last_promotion, h.years_with_curr_manager, h.effective_start_date,
 case when h.is_current = 1 and f.first_date is not null then f.first_date - 1 else h.effective_end_date end as effective_end_date,
 cast(case when f.first_date is not null then 0 else h.is_current end as int) as is_current, h.change_reason
from employee_job_history h left join first_changes f on f.employee_id = h.employee_id
union all
select job_history_id, employee_sk, employee_id, department_id, job_role_id, job_level, monthly_income, daily_rate, hourly_rate,
 monthly_income, 'Non-Travel', 'No', 0, 0, 0, 0, 0, change_date,
 case when next_date is null then date '9999-12-31' else next_date - 1 end,
 case when next_date is null then 1 else 0 end, change_reason from accepted_changes""",
)


def _judged(w):
    return judge_changes(*w.many("changes", "employee_job_history", "departments", "job_roles"))


def _changed_dimension(w):
    judged = _judged(w)
    applied = apply_to_history(w["employee_job_history"], judged.accepted)
    return apply_to_dimension(w["dim_employee"], judged.accepted, applied.added)


add(
    "j16_changes_history",
    lambda w: apply_to_history(w["employee_job_history"], _judged(w).accepted).history,
    "select * from changed_history",
)


def _history_in_parts(w):
    """The same changes to a history in parts by employee: only parts with changed employees are written anew."""
    history, accepted = w["employee_job_history"], written(_judged(w).accepted, "accepted")
    table = PartedTable(w.spark, new_path(w.spark, "history-in-parts"), history.schema, ["employee_id"])
    table.create(history)
    table.rewrite(accepted, lambda rows: apply_to_history(rows, accepted, keys_from=history).history)
    return table.rows()


add("j16_changes_history_of_parts", _history_in_parts, REGISTRY["j16_changes_history"].sql)
add(
    "j16_changes_dimension",
    _changed_dimension,
    """select d.* replace (
     case when d.is_current = 1 and f.first_date is not null then f.first_date - 1 else d.effective_end_date end as effective_end_date,
     cast(case when f.first_date is not null then 0 else d.is_current end as int) as is_current)
    from dim_employee d left join first_changes f on f.employee_id = d.employee_id
    union all
    select a.employee_sk, a.employee_id, a.department_name, d.first_name, d.last_name, d.email, d.age, d.gender, d.marital_status,
     d.education_field, a.job_role_name, a.job_level, a.monthly_income, a.daily_rate, a.hourly_rate, d.business_travel,
     d.distance_from_home, d.years_with_curr_manager, d.years_since_last_promotion, d.years_at_company, d.attrition, d.manager_id,
     a.change_reason, a.change_date, case when a.next_date is null then date '9999-12-31' else a.next_date - 1 end,
     case when a.next_date is null then 1 else 0 end
    from accepted_changes a join dim_employee d on d.employee_id = a.employee_id and d.is_current = 1""",
)
add(
    "j16_changes_employees",
    lambda w: apply_to_employees(w["employees"], _judged(w).accepted).select(
        "employee_id", "department_id", "job_role_id", "monthly_income"
    ),
    """select e.employee_id, coalesce(m.department_id, e.department_id) as department_id,
    coalesce(m.job_role_id, e.job_role_id) as job_role_id, e.monthly_income
    from employees e left join moved m on m.employee_id = e.employee_id""",
)
add(
    "j16_changes_rejected",
    lambda w: _judged(w).rejected.select("employee_id", "change_date", "change_seq", "reject_reason"),
    """select employee_id, change_date, change_seq, case when job_role_id is null then 'unknown job role'
    when department_name is null then 'unknown department' when current_start is null then 'no current version'
    else 'late change' end as reject_reason from judged_changes
    where job_role_id is null or department_name is null or current_start is null
     or (change_date < current_start and not exists (select 1 from employee_job_history h where h.employee_id = judged_changes.employee_id
      and h.effective_start_date = change_date and h.department_id = judged_changes.department_id
      and h.job_role_id = judged_changes.job_role_id and h.monthly_income = judged_changes.monthly_income))""",
)
add(
    "j17_mark_attrition",
    lambda w: mark_attrition(w["employees"], w["changes"].filter("change_reason = 'Internal Move'")).select("employee_id", "attrition"),
    """select employee_id, case when employee_id in (select employee_id from changes where change_reason = 'Internal Move')
    then 'Yes' else attrition end as attrition from employees""",
)
define(
    "judged_projects",
    """select * replace (coalesce(first_broken, case when department_id not in (select department_id from departments)
  then 'unknown department' end) as first_broken) from checked_projects""",
)
define(
    "judged_assignments",
    """select * replace (coalesce(first_broken, case when employee_id not in (select employee_id from employees) then 'unknown employee'
  when project_id not in (select project_id from projects) then 'unknown project' end) as first_broken) from checked_assignments""",
)
define(
    "judged_reviews",
    """select *, case when performance_rating not between 1 and 5 then 'rating outside 1 to 5'
 when employee_id not in (select employee_id from employees) then 'unknown employee' end as first_broken from review_requests""",
)


def _created_projects(w):
    return oltp.create_projects(*w.many("project_requests", "projects", "departments"))


def _created_assignments(w):
    return oltp.create_assignments(*w.many("assignment_requests", "assignments", "employees", "projects"))


def _submitted_reviews(w):
    return oltp.submit_reviews(*w.many("review_requests", "reviews", "employees"))


def _odd_reviews(w):
    """The same requests with ratings up to 7, some of them for people who are not employed."""
    odd = w["review_requests"].withColumns(
        {
            "performance_rating": (1 + F.pmod("request_seq", F.lit(7))).cast("int"),
            "employee_id": F.when(F.pmod("request_seq", F.lit(10)) == 0, -1).otherwise(c("employee_id")),
        }
    )
    return oltp.submit_reviews(odd, *w.many("reviews", "employees"))


add(
    "j18_create_projects",
    lambda w: _created_projects(w)[0],
    """select (select max(project_id) from projects) + row_number() over (order by request_seq) as project_id, project_name,
    department_id, start_date, case when status in ('Completed', 'On Hold') then end_date end as end_date, status
    from judged_projects where first_broken is null""",
)
add(
    "j18_rejected",
    lambda w: _created_projects(w)[1].select("request_seq", "first_broken"),
    "select request_seq, first_broken from judged_projects where first_broken is not null",
)
add(
    "j19_create_assignments",
    lambda w: _created_assignments(w)[0],
    """select (select max(assignment_id) from assignments) + row_number() over (order by request_seq) as assignment_id, employee_id,
    project_id, role_on_project, allocation_ratio, assigned_date, end_date from judged_assignments where first_broken is null""",
)
add(
    "j19_rejected",
    lambda w: _created_assignments(w)[1].select("request_seq", "first_broken"),
    "select request_seq, first_broken from judged_assignments where first_broken is not null",
)
add(
    "j20_submit_reviews",
    lambda w: _submitted_reviews(w)[0].select("review_id", "employee_id", "reviewer_id", "review_date", "performance_rating"),
    """select (select max(review_id) from reviews) + row_number() over (order by request_seq) as review_id, employee_id,
    nullif(reviewer_id, 0) as reviewer_id, review_date, performance_rating from judged_reviews where first_broken is null""",
)
add(
    "j20_rejected",
    lambda w: _odd_reviews(w)[1].select("request_seq", "first_broken"),
    """select request_seq, first_broken from (
     select request_seq, case when 1 + request_seq % 7 > 5 then 'rating outside 1 to 5'
      when request_seq % 10 = 0 or employee_id not in (select employee_id from employees) then 'unknown employee' end as first_broken
     from review_requests) x where first_broken is not null""",
)
add(
    "j21_version_history",
    lambda w: analytics.version_history(w["dim_employee"], 12),
    """select employee_sk, first_name || ' ' || last_name as name, department_name, job_role, job_level, monthly_income, change_reason,
    effective_start_date, effective_end_date, case when is_current = 1 then '✅ Current' else '📜 History' end as status
    from dim_employee where employee_id = 12 order by effective_start_date""",
)
