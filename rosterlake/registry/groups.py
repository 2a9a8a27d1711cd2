"""Aggregations, ranks, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.operators import checks, statistics
from rosterlake.operators.numbering import first_n, number_rows
from rosterlake.operators.ordering import latest, ranked
from rosterlake.operators.skew import lookup_join, with_group_values
from rosterlake.plans import analytics, synthesis
from rosterlake.registry.core import add, define

c = F.col
_ALL = list(S.TABLES)


def _counts_sql(tables: list[str]) -> str:
    return " union all ".join(
        f"select '{t}' as table_name, count(*) as row_count, case when count(*) > 0 then 'loaded' else 'empty' end as status from {t}"
        for t in tables
    )


add("d01_table_row_counts", lambda w: statistics.row_counts({t: w.figures(t) for t in _ALL if t != "dim_assignment"}), _counts_sql([t for t in _ALL if t != "dim_assignment"]))
add(
    "d02_distinct_counts",
    lambda w: w["staging_employees"].agg(
        F.countDistinct("employee_id").alias("employees"),
        F.countDistinct("employee_sk").alias("versions"),
        F.countDistinct(F.when(c("is_current") == 1, c("employee_id"))).alias("current_employees"),
    ),
    """select count(distinct employee_id) as employees, count(distinct employee_sk) as versions,
    count(distinct case when is_current = 1 then employee_id end) as current_employees from staging_employees""",
)
add(
    "d03_group_count",
    lambda w: w["staging_employees"].groupBy("is_current", "change_reason").agg(F.count("*").alias("n")),
    "select is_current, change_reason, count(*) as n from staging_employees group by is_current, change_reason",
)
add(
    "d04_having",
    lambda w: checks.not_one_current(w["dirty_versions"]),
    """select employee_id, count(*) as total_versions, cast(sum(is_current) as bigint) as current_versions
    from dirty_versions group by employee_id having sum(is_current) <> 1""",
)
add(
    "d05_count_of_counts",
    lambda w: checks.version_histogram(w["employee_job_history"]),
    """select version_count, count(*) as employee_count from (select employee_id, count(*) as version_count
     from employee_job_history group by employee_id) x group by version_count""",
)
add(
    "d06_group_average",
    lambda w: w["dim_employee"].groupBy("department_name", "job_role").agg(
        F.round(F.avg("monthly_income"), 2).alias("avg_income"), F.count("*").alias("n")
    ),
    """select department_name, job_role, round(avg(monthly_income), 2) as avg_income, count(*) as n from dim_employee
    group by department_name, job_role""",
)
add(
    "d07_conditional_sum",
    lambda w: w["employees"].groupBy("department_id").agg(
        F.sum(F.when(c("attrition") == "Yes", 1).otherwise(0)).alias("attrited"),
        F.round(F.lit(100.0) * F.sum(F.when(c("attrition") == "Yes", 1).otherwise(0)) / F.count("*"), 2).alias("rate"),
    ),
    """select department_id, cast(sum(case when attrition = 'Yes' then 1 else 0 end) as bigint) as attrited,
    round(100.0::double * sum(case when attrition = 'Yes' then 1 else 0 end) / count(*), 2) as rate from employees group by department_id""",
)
define(
    "department_summary",
    """with marks as (select employee_sk, sum(performance_rating) as points, count(performance_rating) as rated, count(*) as facts
 from fact_performance_reviews group by employee_sk),
staff as (from dim_employee left join marks using (employee_sk) select *, greatest(coalesce(facts, 0), 1) as weight where is_current = 1)
select department_name, count(distinct employee_id) as headcount,
 round(cast(sum(monthly_income * weight) as double) / sum(case when monthly_income is not null then weight end), 0) as avg_income,
 round(cast(sum(points) as double) / nullif(sum(rated), 0), 2) as avg_rating
from staff group by department_name""",
)
add(
    "d08_distinct_and_averages",
    lambda w: analytics.department_summary(w["dim_employee"], w["fact_performance_reviews"]),
    "select * from department_summary",
)
define(
    "project_load",
    """with used as (select project_id, count(*) as n, avg(cast(allocation_ratio as double)) as mean, cast(sum(allocation_ratio) as double) as total
 from assignments group by all)
select p.project_name, coalesce(d.department_name, 'Unknown') as department_name, p.status, coalesce(u.n, 0) as assigned_employees,
 round(coalesce(u.mean, 0), 2) as avg_allocation_pct, round(coalesce(u.total, 0), 2) as total_allocation_pct
from projects p left join departments d on d.department_id = p.department_id left join used u on u.project_id = p.project_id""",
)
add(
    "d09_nullable_count_and_defaults",
    lambda w: analytics.project_load(w["projects"], w["departments"], w["assignments"]).groupBy("status").agg(
        F.sum("assigned_employees").alias("assigned"), F.round(F.sum("total_allocation_pct"), 2).alias("allocation")
    ),
    """select status, cast(sum(assigned_employees) as bigint) as assigned, round(sum(total_allocation_pct), 2) as allocation
    from project_load group by status""",
)
add(
    "d10_min_max",
    lambda w: w["staging_employees"].groupBy(F.trim("Department").alias("department")).agg(
        F.min("effective_start_date").alias("first_start"), F.max("effective_end_date").alias("last_end")
    ),
    """select trim(Department) as department, min(effective_start_date) as first_start, max(effective_end_date) as last_end
    from staging_employees group by trim(Department)""",
)
add(
    "d11_two_levels",
    lambda w: w["reviews"].groupBy("employee_id").agg(F.min("review_date").alias("first_review")).groupBy(
        F.year("first_review").alias("year")
    ).agg(F.countDistinct("employee_id").alias("employees")),
    """select cast(year(first_review) as int) as year, count(distinct employee_id) as employees from (
     select employee_id, min(review_date) as first_review from reviews group by employee_id) x group by 1""",
)
add(
    "d12_next_keys",
    lambda w: number_rows(
        w["project_requests"].select("request_seq"), ["request_seq"], "project_sk", statistics.next_key(w.figures("dim_project"), "project_sk")
    ),
    """select request_seq, (select coalesce(max(project_sk), 0) from dim_project) + row_number() over (order by request_seq) as project_sk
    from project_requests""",
)
add(
    "d13_distinct",
    lambda w: w["staging_employees"].select(F.trim("JobRole").alias("job_role"), c("JobLevel").alias("job_level")).distinct(),
    "select distinct trim(JobRole) as job_role, JobLevel as job_level from staging_employees",
)
define(
    "income_by_level",
    """select department_name, job_level, round(avg(monthly_income), 0) as avg_income, count(*) as employee_count
from dim_employee where is_current = 1 group by department_name, job_level""",
)
add(
    "d14_pivot",
    lambda w: analytics.income_pivot(analytics.income_by_level(w["dim_employee"])),
    "select department_name, "
    + ", ".join(f"max(case when job_level = {n} then avg_income end) as level_{n}" for n in range(1, 6))
    + " from income_by_level group by department_name",
)
add(
    "d15_rollup",
    lambda w: analytics.attrition_totals(analytics.attrition_counts(w["employees"], w["departments"])),
    """select department_name, attrition, count(*) as employee_count from employees join departments using (department_id)
    group by rollup (department_name, attrition)""",
)
add(
    "d16_five_numbers",
    lambda w: analytics.income_spread(analytics.income_rows(w["dim_employee"])),
    """select department_name, min(monthly_income) as low, quantile_cont(monthly_income, 0.25) as q1,
    quantile_cont(monthly_income, 0.5) as median, quantile_cont(monthly_income, 0.75) as q3, max(monthly_income) as high
    from dim_employee where is_current = 1 group by department_name""",
)
add(
    "d17_all_groups_pass",
    lambda w: checks.not_one_current(w["staging_employees"]).agg((F.count("*") == 0).alias("all_pass")),
    """select count(*) = 0 as all_pass from (select employee_id from staging_employees group by employee_id
     having sum(is_current) <> 1) x""",
)
add(
    "d18_sum_of_result",
    lambda w: analytics.project_load(w["projects"], w["departments"], w["assignments"]).agg(
        (F.sum("assigned_employees") > 0).alias("has_activity"), F.sum("assigned_employees").alias("total")
    ),
    """select sum(assigned_employees) > 0 as has_activity, cast(sum(assigned_employees) as bigint) as total from project_load""",
)


def _rated(w):
    totals = w["fact_performance_reviews"].groupBy("employee_sk").agg(F.avg("performance_rating").alias("mean_rating"))
    people = w["dim_employee"].select("employee_sk", "department_name", "monthly_income")
    return totals.join(people, "employee_sk")


add(
    "e07_dense_rank_of_average",
    lambda w: ranked(
        _rated(w), ["department_name"], [("mean_rating", "desc"), ("monthly_income", "desc")], dense_rank="dept_rank"
    ).select("employee_sk", "department_name", "dept_rank"),
    """select employee_sk, department_name, dense_rank() over (partition by department_name order by mean_rating desc, monthly_income desc)
     as dept_rank from (select f.employee_sk, de.department_name, de.monthly_income, avg(f.performance_rating) as mean_rating
     from fact_performance_reviews f join dim_employee de on de.employee_sk = f.employee_sk group by 1, 2, 3) x""",
)
add(
    "e08_review_sequence",
    lambda w: ranked(w["reviews"], ["employee_id"], [("review_date", "asc")], dense_rank="review_sequence").select(
        "review_id", "review_sequence"
    ),
    """select review_id, dense_rank() over (partition by employee_id order by review_date) as review_sequence from reviews""",
)
add(
    "e09_department_average",
    lambda w: with_group_values(
        w["fact_performance_reviews"], ["department_sk"], {"dept_avg_rating": F.avg("performance_rating")}
    ).select("review_sk", "dept_avg_rating"),
    """select review_sk, avg(performance_rating) over (partition by department_sk) as dept_avg_rating
    from fact_performance_reviews""",
)
add(
    "e10_rank_in_department",
    lambda w: ranked(
        w["fact_performance_reviews"], ["department_sk"], [("performance_rating", "desc")], rank="dept_rating_rank"
    ).select("review_sk", "dept_rating_rank"),
    """select review_sk, rank() over (partition by department_sk order by performance_rating desc) as dept_rating_rank
    from fact_performance_reviews""",
)
define(
    "yearly_change",
    """with y as (select cast(date_sk // 10000 as int) as year, count(*) as total_reviews, round(avg(performance_rating), 3) as avg_performance
 from fact_performance_reviews group by 1),
p as (select y.*, (select arg_max(e.avg_performance, e.year) from y e where e.year < y.year) as prev_year_avg from y)
select *, round(avg_performance - prev_year_avg, 3) as performance_change from p""",
)
add(
    "e11_change_to_previous_year",
    lambda w: analytics.yearly_change(w["fact_performance_reviews"], w["dim_date"]).select("year", "prev_year_avg", "performance_change"),
    "select year, prev_year_avg, performance_change from yearly_change",
)
add(
    "e12_project_rank",
    lambda w: ranked(w["projects"], ["department_id"], [("project_id", "asc")], dense_rank="place").select("project_id", "place"),
    "select project_id, row_number() over (partition by department_id order by project_id) as place from projects",
)

# Sort, limit, top-k

add(
    "f01_newest_employees",
    lambda w: analytics.newest_employees(w["employees"], w["departments"], w["job_roles"], 50),
    """select e.employee_id, e.first_name, e.last_name, e.email, e.age, e.attrition, e.years_at_company, e.monthly_income,
    d.department_name, j.job_role_name, j.job_level from employees e join departments d on d.department_id = e.department_id
    join job_roles j on j.job_role_id = e.job_role_id order by e.employee_id desc limit 50""",
)
add(
    "f01_employee_choices",
    lambda w: analytics.employee_choices(w["employees"], w["departments"], w["job_roles"], 500),
    """select e.employee_id, e.first_name || ' ' || e.last_name as name, d.department_name, j.job_role_name
    from employees e join departments d on d.department_id = e.department_id
    join job_roles j on j.job_role_id = e.job_role_id
    order by e.first_name, e.last_name nulls first, e.employee_id limit 500""",
)
add("f02_project_listing", lambda w: analytics.project_listing(w["projects"], w["departments"]),
    """select p.project_id, p.project_name, d.department_name, p.status, p.start_date, p.end_date from projects p
    join departments d on d.department_id = p.department_id order by p.project_id desc""")
add(
    "f02_assignment_listing",
    lambda w: analytics.assignment_listing(w["assignments"], w["employees"], w["projects"]),
    """select a.assignment_id, e.first_name || ' ' || e.last_name as employee_name, p.project_name, a.role_on_project,
    a.allocation_ratio, a.assigned_date, a.end_date from assignments a join employees e on e.employee_id = a.employee_id
    join projects p on p.project_id = a.project_id order by a.assignment_id desc""",
)
add(
    "f02_reviews_of_employee",
    lambda w: analytics.reviews_of(w["reviews"], 7),
    "select * from reviews where employee_id = 7 order by review_date desc, review_id desc",
)
add(
    "f03_top_earners",
    lambda w: analytics.top_earners(w["employees"], w["departments"], w["job_roles"], 100),
    """select e.first_name || ' ' || e.last_name as employee_name, d.department_name, j.job_role_name, j.job_level, e.monthly_income
    from employees e join departments d on d.department_id = e.department_id join job_roles j on j.job_role_id = e.job_role_id
    order by e.monthly_income desc, e.employee_id limit 100""",
)
define(
    "ranked_performers",
    """with means as (select employee_sk, department_sk, avg(performance_rating) as mean from fact_performance_reviews group by all)
select e.first_name || ' ' || e.last_name as employee_name, d.department_name, e.job_role, e.job_level, e.monthly_income,
 round(m.mean, 2) as avg_rating,
 dense_rank() over (partition by d.department_name order by m.mean desc nulls last, e.monthly_income desc) as dept_rank
from means m join dim_employee e on e.employee_sk = m.employee_sk join dim_department d on d.department_sk = m.department_sk
where e.is_current = 1""",
)
add(
    "f04_top_n_per_group",
    lambda w: analytics.top_performers(*w.many("fact_performance_reviews", "dim_employee", "dim_department"), 25),
    "select * from ranked_performers where dept_rank <= 25",
)
add(
    "f05_latest_row",
    lambda w: latest(
        w["dim_employee"].select("employee_id", "effective_end_date", "employee_sk", "monthly_income"),
        ["employee_id"],
        ["effective_end_date", "employee_sk"],
    ),
    """select employee_id, effective_end_date, employee_sk, monthly_income from (select *, row_number() over (
     partition by employee_id order by effective_end_date desc, employee_sk desc) as n from dim_employee) x where n = 1""",
)
add(
    "f06_sorted_versions",
    lambda w: number_rows(
        w["staging_employees"].select("employee_id", "effective_start_date", "employee_sk"),
        ["employee_id", "effective_start_date", "employee_sk"],
        "position",
    ),
    """select employee_id, effective_start_date, employee_sk,
    row_number() over (order by employee_id, effective_start_date, employee_sk) as position from staging_employees""",
)
add(
    "f07_first_n",
    lambda w: first_n(w["people"], ["EmployeeNumber"], 1000).select("EmployeeNumber", "Age", "Department"),
    "select EmployeeNumber, Age, Department from people order by EmployeeNumber limit 1000",
)

# Set operations

add("g01_union_of_counts", lambda w: checks.row_counts({t: w[t] for t in _ALL[:8]}), _counts_sql(_ALL[:8]))
add(
    "g02_append_rows",
    lambda w: w["staging_employees"].filter("is_current = 0").select("employee_id", "employee_sk", "change_reason").unionByName(
        w["staging_employees"].filter("is_current = 1").select("change_reason", "employee_sk", "employee_id")
    ),
    "select employee_id, employee_sk, change_reason from staging_employees",
)
add(
    "g03_multiply_rows",
    lambda w: w["departments"].join(w["employees"].groupBy("department_id").agg(F.count("*").alias("n")), "department_id").select(
        "department_name", "n", F.explode(F.array(*[F.lit(n) for n, _ in synthesis.GENERATED_PROJECTS])).alias("ending")
    ),
    "union all".join(
        f""" select d.department_name, count(*) as n, '{ending}' as ending from employees e
        join departments d on d.department_id = e.department_id group by d.department_name """
        for ending, _ in synthesis.GENERATED_PROJECTS
    ),
)
add(
    "g04_day_series",
    lambda w: lookup_join(
        w["dim_date"].select(c("full_date").alias("review_date")),
        w["reviews"].groupBy("review_date").agg(F.count("*").alias("n")),
        ["review_date"],
        "left",
    ).select("review_date", F.coalesce("n", F.lit(0)).alias("n")),
    """select d.full_date as review_date, count(r.review_id) as n from dim_date d
    left join reviews r on r.review_date = d.full_date group by d.full_date""",
)
