"""Row-wise queries: projections, filters and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.functions import chance, dates, pay, text
from rosterlake.operators.fragments import FragmentIndex
from rosterlake.operators.skew import lookup_join
from rosterlake.plans import analytics, synthesis
from rosterlake.registry.core import REGISTRY, add
from rosterlake.session import new_path

c = F.col

# Projections, filters, predicates

add(
    "b01_rename",
    lambda w: w["raw_people"]
    .withColumnRenamed("YearsWithCurrManaer", "YearsWithCurrManager")
    .select("EmployeeNumber", "YearsWithCurrManager"),
    "select EmployeeNumber, YearsWithCurrManaer as YearsWithCurrManager from raw_people",
)
add(
    "b02_pruned_columns",
    lambda w: w["staging_employees"].select(*S.SOURCE.names),
    f"select {', '.join(S.SOURCE.names)} from staging_employees",
)
add(
    "b03_trim_all",
    lambda w: synthesis.source_columns(w["raw_people"]),
    "select "
    + ", ".join(
        f"trim({f}) as {f}"
        if f in "Attrition BusinessTravel Department EducationField Gender JobRole MaritalStatus Over18 OverTime Age DailyRate".split()
        else "YearsWithCurrManaer as YearsWithCurrManager"
        if f == "YearsWithCurrManager"
        else f
        for f in S.SOURCE.names
    )
    + " from raw_people",
)
add(
    "b04_number_or_default",
    lambda w: w["raw_people"].select(
        "EmployeeNumber", pay.whole_or(c("Age"), 35).alias("age"), pay.whole_or(c("DailyRate"), 800).alias("daily_rate")
    ),
    """select EmployeeNumber, coalesce(try_cast(Age as int), 35) as age, coalesce(try_cast(DailyRate as int), 800) as daily_rate
    from raw_people""",
)
add(
    "b05_strict_number",
    lambda w: w["raw_people"].select(
        c("EmployeeNumber").cast("string").cast("long").alias("employee_id"), c("DailyRate").cast("int").alias("daily_rate")
    ),
    "select cast(EmployeeNumber as bigint) as employee_id, cast(DailyRate as int) as daily_rate from raw_people",
)
add(
    "b06_split_name",
    lambda w: w["staging_employees"].select(
        "employee_sk",
        text.first_word(c("EmployeeName")).alias("first_name"),
        text.after_first_word(c("EmployeeName")).alias("last_name"),
    ),
    """select employee_sk, split_part(EmployeeName, ' ', 1) as first_name,
    case when contains(EmployeeName, ' ') then substring(EmployeeName, strpos(EmployeeName, ' ') + 1) end as last_name
    from staging_employees""",
)
add(
    "b07_full_name",
    lambda w: w["employees"].select("employee_id", text.full_name(c("first_name"), c("last_name")).alias("name")),
    "select employee_id, first_name || ' ' || last_name as name from employees",
)
add(
    "b08_weekend",
    lambda w: w["reviews"].select("review_id", dates.is_weekend(c("review_date")).alias("is_weekend")),
    "select review_id, cast(case when isodow(review_date) >= 6 then 1 else 0 end as int) as is_weekend from reviews",
)
add(
    "b09_status_label",
    lambda w: analytics.version_rows(w["dim_employee"]).select("employee_sk", "status"),
    """select employee_sk, case when is_current = 1 then '✅ Current' else '📜 History' end as status from dim_employee""",
)
add(
    "b10_current_rows",
    lambda w: w["dim_employee"].filter("is_current = 1"),
    "select * from dim_employee where is_current = 1",
)
add(
    "b11_not_blank",
    lambda w: w["hires"].filter(text.not_blank(c("first_name")) & text.not_blank(c("last_name"))).select(
        "employee_number", "first_name", "last_name"
    ),
    """select employee_number, first_name, last_name from hires
    where first_name is not null and trim(first_name) <> '' and last_name is not null and trim(last_name) <> ''""",
)
add(
    "b12_point_lookup",
    lambda w: analytics.find_employee(w["employees"], w["departments"], w["job_roles"], 42),
    """select e.*, d.department_name, j.job_role_name, j.job_level from employees e
    join departments d on d.department_id = e.department_id join job_roles j on j.job_role_id = e.job_role_id
    where e.employee_id = 42 limit 1""",
)
add(
    "b13_pay_rates",
    lambda w: w["employees"].select(
        "employee_id",
        pay.daily_rate(c("monthly_income")).alias("daily"),
        pay.hourly_rate(c("monthly_income")).alias("hourly"),
        pay.monthly_rate(c("monthly_income")).alias("monthly"),
    ),
    """select employee_id, greatest(1, cast(round_even(monthly_income / 22.0, 0) as int)) as daily,
    greatest(1, cast(round_even(greatest(1, round_even(monthly_income / 22.0, 0)) / 8.0, 0) as int)) as hourly,
    monthly_income as monthly from employees""",
)
add(
    "b14_null_default",
    lambda w: w["staging_employees"].select(
        "employee_sk", F.coalesce("PerformanceRating", F.lit(0)).alias("rating")
    ),
    "select employee_sk, coalesce(PerformanceRating, 0) as rating from staging_employees",
)
def _index(w, name, key, column):
    """A substring index of one table, built once."""

    def make():
        index = FragmentIndex(w.spark, new_path(w.spark, f"{name}-index"), w[name].schema, key, column, parts=16)
        index.build(w[name])
        return index

    return w.once(f"{name}-index", make)


def _names(w):
    return _index(w, "employees", "employee_id", text.full_name(c("first_name"), c("last_name")))


def _projects(w):
    return _index(w, "projects", "project_id", c("project_name"))


add(
    "b15_name_search",
    lambda w: analytics.search_employees(w["employees"], w["departments"], w["job_roles"], "building customer#"),
    """select e.employee_id, e.first_name || ' ' || e.last_name as name, e.email, e.age, e.attrition, d.department_name,
    j.job_role_name, j.job_level, e.monthly_income from employees e
    join departments d on d.department_id = e.department_id join job_roles j on j.job_role_id = e.job_role_id
    where e.first_name || ' ' || e.last_name ilike '%building customer#%'
    order by e.first_name, e.last_name, e.employee_id limit 30""",
)
add(
    "b15_name_search_by_index",
    lambda w: analytics.search_employees(_names(w).search("building customer#"), w["departments"], w["job_roles"], "building customer#"),
    REGISTRY["b15_name_search"].sql,
)
add(
    "b16_null_columns",
    lambda w: w["reviews"].select(
        "review_id", F.lit(None).cast("long").alias("project_sk"), F.lit(None).cast("long").alias("manager_id")
    ),
    "select review_id, cast(null as bigint) as project_sk, cast(null as bigint) as manager_id from reviews",
)
add(
    "b17_conditional_values",
    lambda w: w["project_requests"].select(
        "request_seq", pay.closed_end(c("status"), c("end_date")).alias("kept_end"),
        F.nullif(c("department_id"), F.lit(1)).alias("department_id"),
    ),
    """select request_seq, case when status in ('Completed', 'On Hold') then end_date end as kept_end,
    nullif(department_id, 1) as department_id from project_requests""",
)
add(
    "b18_flags",
    lambda w: w["reviews"].groupBy(pay.is_high_performer(c("performance_rating")).alias("high_performer"))
    .agg(F.count("*").alias("n"))
    .withColumn("kind", F.lit("reviews"))
    .select("kind", c("high_performer").alias("flag"), "n")
    .unionByName(
        w["projects"].groupBy(pay.is_active(c("status")).alias("flag")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("projects"))
    ),
    """select 'reviews' as kind, performance_rating >= 4 as flag, count(*) as n from reviews group by 2
    union all select 'projects', status = 'Active', count(*) from projects group by 2""",
)
add(
    "b19_allocation_share",
    lambda w: w["employees"].select("employee_id", pay.allocation_share(c("employee_id")).cast("double").alias("share")),
    """select employee_id, cast(case employee_id % 3 when 0 then 1.00 when 1 then 0.75 else 0.50 end as double) as share
    from employees""",
)
add(
    "b20_open_end_null",
    lambda w: w["staging_employees"].select(
        "employee_sk", F.when(c("is_current") != 1, c("effective_end_date")).alias("end_date")
    ),
    "select employee_sk, case when is_current = 1 then null else effective_end_date end as end_date from staging_employees",
)
add(
    "b21_delta_sign",
    lambda w: analytics.change_direction(analytics.yearly_change(w["fact_performance_reviews"], w["dim_date"])),
    """select year, coalesce(performance_change, 0.0) as delta,
    case when coalesce(performance_change, 0) >= 0 then 'up' else 'down' end as direction from yearly_change""",
)
add(
    "b22_groups_with_activity",
    lambda w: analytics.project_load(w["projects"], w["departments"], w["assignments"]).filter("assigned_employees > 0"),
    "select * from project_load where assigned_employees > 0",
)
add(
    "b23_reason_differs",
    lambda w: w["employee_job_history"].filter("change_reason <> 'Current Record'").select(
        "employee_sk", "employee_id", "change_reason"
    ).orderBy("employee_sk").limit(20),
    """select employee_sk, employee_id, change_reason from employee_job_history where change_reason <> 'Current Record'
    order by employee_sk limit 20""",
)

# Scalar functions

add(
    "h01_trim",
    lambda w: w["raw_people"].select("EmployeeNumber", text.tidy(c("Department")).alias("department")),
    "select EmployeeNumber, trim(Department) as department from raw_people",
)
add(
    "h02_substring_functions",
    lambda w: w["employees"].select(
        "employee_id",
        F.substring_index("email", "@", 1).alias("mailbox"),
        F.locate("@", "email").alias("at"),
        F.substring("email", 2, 3).alias("piece"),
    ),
    """select employee_id, split_part(email, '@', 1) as mailbox, cast(strpos(email, '@') as int) as at,
    substring(email, 2, 3) as piece from employees""",
)
add(
    "h03_concat",
    lambda w: lookup_join(w["projects"], w["departments"], ["department_id"]).select(
        "project_id", F.concat("department_name", F.lit(" - "), "project_name").alias("label")
    ),
    """select project_id, department_name || ' - ' || project_name as label
    from projects join departments using (department_id)""",
)
add(
    "h04_like",
    lambda w: w["projects"].filter(c("project_name").like("%ring%") | text.contains_fragment(c("project_name"), "BOLT")).select("project_id", "project_name"),
    "select project_id, project_name from projects where project_name like '%ring%' or project_name ilike '%bolt%'",
)
add(
    "h04_like_by_index",
    lambda w: _projects(w).search("ring").filter(c("project_name").like("%ring%")).union(_projects(w).search("BOLT")).distinct().select("project_id", "project_name"),
    REGISTRY["h04_like"].sql,
)
add(
    "h05_email",
    lambda w: w["employees"].select(
        "employee_id",
        text.email_variant(text.email_for(c("first_name"), F.coalesce("last_name", F.lit("x")), c("employee_id")), c("employee_id") % 2).alias("email"),
    ),
    """select employee_id, replace(lower(first_name || '.' || coalesce(last_name, 'x') || '.' || employee_id || '@example.com'),
    '@example.com', case when employee_id % 2 > 0 then '.' || (employee_id % 2) || '@example.com' else '@example.com' end) as email
    from employees""",
)
add(
    "h06_contains",
    lambda w: w["hires"].select(
        "employee_number", text.looks_like_email(c("email")).alias("email_ok"), text.has_digit(c("first_name")).alias("digit")
    ),
    """select employee_number, contains(email, '@') and contains(email, '.') as email_ok,
    regexp_matches(first_name, '[0-9]') as digit from hires""",
)
add(
    "h07_role_label",
    lambda w: lookup_join(w["employee_job_history"], w["job_roles"].drop("job_level"), ["job_role_id"]).select(
        "employee_sk", text.role_label(c("job_role_name"), c("job_level")).alias("label")
    ),
    """select employee_sk, job_role_name || ' (Lvl ' || h.job_level || ')' as label
    from employee_job_history h join job_roles r on r.job_role_id = h.job_role_id""",
)
add(
    "h08_date_parts",
    lambda w: w["reviews"].select(
        "review_id", F.year("review_date").alias("y"), F.month("review_date").alias("m"),
        F.dayofmonth("review_date").alias("d"), F.quarter("review_date").alias("q"),
    ),
    """select review_id, cast(year(review_date) as int) as y, cast(month(review_date) as int) as m,
    cast(day(review_date) as int) as d, cast(quarter(review_date) as int) as q from reviews""",
)
add(
    "h09_month_name",
    lambda w: w["reviews"].select("review_id", dates.month_name(c("review_date")).alias("month_name")),
    "select review_id, monthname(review_date) as month_name from reviews",
)
add(
    "h10_day_of_week",
    lambda w: w["reviews"].select("review_id", F.dayofweek("review_date").alias("dow")),
    "select review_id, cast(dayofweek(review_date) + 1 as int) as dow from reviews",
)
add(
    "h11_next_day",
    lambda w: w["reviews"].select("review_id", F.date_add("review_date", 1).alias("next_day")),
    "select review_id, cast(review_date + interval 1 day as date) as next_day from reviews",
)
add(
    "h12_date_key",
    lambda w: w["reviews"].select(
        "review_id", dates.date_key(c("review_date")).alias("date_sk"),
        F.date_format("review_date", "yyyyMMdd").cast("int").alias("from_text"),
    ),
    """select review_id, cast(strftime(review_date, '%Y%m%d') as int) as date_sk,
    cast(strftime(review_date, '%Y%m%d') as int) as from_text from reviews""",
)
add(
    "h13_months_and_days_back",
    lambda w: w["reviews"].select(
        "review_id", F.add_months("review_date", -c("performance_rating") * 7).alias("months_back"), F.date_sub("review_date", 1).alias("day_before")
    ),
    """select review_id, cast(review_date - interval '1' month * (performance_rating * 7) as date) as months_back,
    review_date - 1 as day_before from reviews""",
)
add(
    "h14_as_of",
    lambda w: w["employee_job_history"].select(
        "employee_sk", F.datediff(F.lit(dt.date(2024, 6, 30)), "effective_start_date").alias("days_in_version")
    ),
    """select employee_sk, cast(date '2024-06-30' - effective_start_date as int) as days_in_version
    from employee_job_history""",
)
add(
    "h15_round",
    lambda w: w["employees"].select("employee_id", F.round(c("monthly_income") / 22, 2).alias("daily")),
    "select employee_id, round(monthly_income / 22.0, 2) as daily from employees",
)
add(
    "h16_round_half_even",
    lambda w: w["employees"].select("employee_id", pay.half_even(c("monthly_income") / 8).cast("int").alias("eighth")),
    "select employee_id, cast(round_even(monthly_income / 8.0, 0) as int) as eighth from employees",
)
add(
    "h17_mod",
    lambda w: w["employees"].select("employee_id", (c("employee_id") % 3 + 1).alias("place")),
    "select employee_id, employee_id % 3 + 1 as place from employees",
)
add(
    "h18_clamp",
    lambda w: w["employees"].select(
        "employee_id", pay.clamp(c("age") * 2 - 30, 18, 65).alias("age"), pay.clamp(c("daily_rate"), 30, 100).alias("rate")
    ),
    """select employee_id, greatest(18, least(65, age * 2 - 30)) as age, greatest(30, least(100, daily_rate)) as rate
    from employees""",
)


def hash_uniform(entity: str, salt: str) -> str:
    """SQL for chance.uniform."""
    return f"(cast('0x' || substring(md5(cast({entity} as varchar) || ':{salt}'), 1, 8) as bigint) / 4294967296.0)"


add(
    "h19_hash_uniform",
    lambda w: w["employees"].select(
        "employee_id",
        chance.uniform(c("employee_id"), "a").alias("u"),
        chance.uniform_between(c("employee_id"), "b", 0.9, 1.1).alias("factor"),
        chance.pick_of(c("employee_id"), "c", [-2, -1, 0, 0, 1, 2]).alias("step"),
    ),
    f"""select employee_id, {hash_uniform('employee_id', 'a')} as u,
    0.9::double + (1.1::double - 0.9::double) * {hash_uniform('employee_id', 'b')} as factor,
    [-2, -1, 0, 0, 1, 2][1 + cast(floor({hash_uniform('employee_id', 'c')} * 6) as int)] as step from employees""",
)
add(
    "h20_conditions",
    lambda w: w["assignments"].select(
        "assignment_id",
        F.when(c("end_date").isNull(), "open").when(c("end_date").between(dt.date(1998, 1, 1), dt.date(1998, 12, 31)), "ended 1998").otherwise("ended").alias("state"),
        c("role_on_project").isin("Contributor", "Lead").alias("known_role"),
        F.coalesce("end_date", F.lit(S.OPEN_END)).alias("until"),
    ),
    """select assignment_id, case when end_date is null then 'open' when end_date between date '1998-01-01' and date '1998-12-31'
     then 'ended 1998' else 'ended' end as state, role_on_project in ('Contributor', 'Lead') as known_role,
    coalesce(end_date, date '9999-12-31') as until from assignments""",
)
add(
    "h21_text_to_number",
    lambda w: w["employees"].select("employee_id", F.substring("employee_name", -9, 9).cast("int").alias("number")),
    "select employee_id, cast(right(employee_name, 9) as int) as number from employees",
)
