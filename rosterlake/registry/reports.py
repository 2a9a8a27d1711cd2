"""Analytics reports."""

from __future__ import annotations

from rosterlake.plans import analytics
from rosterlake.plans.kept_reports import KeptRatings
from rosterlake.plans.warehouse import Warehouse
from rosterlake.registry.core import REGISTRY, add
from rosterlake.session import new_path
from rosterlake.streaming.tables import run_available

FACT, EMP, DEPT, PROJ, DATE = "fact_performance_reviews", "dim_employee", "dim_department", "dim_project", "dim_date"

add("k01_key_figures", lambda w: analytics.key_figures(*w.many(EMP, FACT, DEPT, PROJ)), "select * from key_figures")
add(
    "k02_top_performers",
    lambda w: analytics.top_performers(*w.many(FACT, EMP, DEPT), 3),
    "select * from ranked_performers where dept_rank <= 3",
)
add(
    "k03_yearly_trend",
    lambda w: analytics.yearly_trend(*w.many(FACT, DATE, DEPT)),
    """with t as (select date_sk // 10000 as y, department_sk, count(*) as n, sum(performance_rating) as points, count(performance_rating) as rated
     from fact_performance_reviews group by all)
    select cast(y as int) as year, department_name, round(cast(points as double) / rated, 3) as avg_rating, n as reviews
    from t join dim_department d on d.department_sk = t.department_sk""",
)
add("k04_yearly_change", lambda w: analytics.yearly_change(*w.many(FACT, DATE)), "select * from yearly_change")
add(
    "k05_quarterly_trend",
    lambda w: analytics.quarterly_trend(*w.many(FACT, DATE)),
    """select cast(1 + (date_sk // 100 % 100 - 1) // 3 as int) as quarter, round(avg(performance_rating), 3) as avg_rating, count(*) as reviews
    from fact_performance_reviews group by 1""",
)
add(
    "k06_attrition_counts",
    lambda w: analytics.attrition_counts(*w.many("employees", "departments")),
    """with n as (select department_id, attrition, count(*) as employee_count from employees group by all)
    select department_name, attrition, cast(sum(employee_count) as bigint) as employee_count
    from departments join n using (department_id) group by all""",
)
add("k07_department_summary", lambda w: analytics.department_summary(*w.many(EMP, FACT)), "select * from department_summary")
add(
    "k08_attrition_rate",
    lambda w: analytics.attrition_rate(*w.many("employees", "departments")),
    """with n as (select department_id, count(*) as total, count_if(attrition = 'Yes') as attrited from employees group by department_id)
    select department_name, total, cast(attrited as bigint) as attrited, round(attrited * 100.0::double / total, 2) as attrition_rate_pct
    from n join departments using (department_id)""",
)
add(
    "k09_income_rows",
    lambda w: analytics.income_rows(w[EMP]),
    "select department_name, job_role, monthly_income from dim_employee where is_current = 1",
)
add("k10_income_by_level", lambda w: analytics.income_by_level(w[EMP]), "select * from income_by_level")
add(
    "k11_top_earners",
    lambda w: analytics.top_earners(*w.many("employees", "departments", "job_roles"), 20),
    """select e.first_name || ' ' || e.last_name as employee_name, d.department_name, j.job_role_name, j.job_level, e.monthly_income
    from employees e join departments d on d.department_id = e.department_id join job_roles j on j.job_role_id = e.job_role_id
    order by e.monthly_income desc, e.employee_id limit 20""",
)
add(
    "k12_headcount_growth",
    lambda w: analytics.headcount_growth(w[EMP]),
    """select cast(year(effective_start_date) as int) as hire_year, count(*) as new_employees from dim_employee d
    where not exists (select 1 from dim_employee e where e.employee_id = d.employee_id
     and (e.effective_start_date, e.employee_sk) < (d.effective_start_date, d.employee_sk)) group by 1""",
)
add(
    "k13_project_load",
    lambda w: analytics.project_load(*w.many("projects", "departments", "assignments")),
    "select * from project_load",
)
add(
    "k14_income_journeys",
    lambda w: analytics.income_journeys(w[EMP]),
    """select employee_id, first_name || ' ' || last_name as name, effective_start_date, monthly_income from dim_employee
    where employee_id in (select employee_id from dim_employee group by employee_id having count(*) > 1)""",
)


def _kept(w: Warehouse) -> KeptRatings:
    """Sums kept over a stream of facts, one file of them a batch."""

    def make() -> KeptRatings:
        kept = KeptRatings(w.spark, new_path(w.spark, "kept-ratings"), w[DATE])
        stream = w.spark.readStream.schema(w[FACT].schema).option("maxFilesPerTrigger", 1).parquet(w.path(FACT))
        run_available(stream, kept.add, new_path(w.spark, "progress-kept-ratings"))
        return kept

    return w.once("kept-ratings", make)


add("k03_kept_yearly_trend", lambda w: _kept(w).yearly_trend(w[DEPT]), REGISTRY["k03_yearly_trend"].sql)
add("k04_kept_yearly_change", lambda w: _kept(w).yearly_change(), REGISTRY["k04_yearly_change"].sql)
add("k05_kept_quarterly_trend", lambda w: _kept(w).quarterly_trend(), REGISTRY["k05_quarterly_trend"].sql)
