"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.operators import checks, differences, rules, statistics
from rosterlake.operators.versions import apply_to_employees, apply_to_history, judge_changes, overlapping
from rosterlake.plans import oltp
from rosterlake.registry.core import add, define
from rosterlake.session import written

c = F.col


def _columns_check(w):
    """Missing source columns before and after the repair, next to the rows concerned."""
    raw = w["raw_people"]
    missing = checks.missing_columns(raw, S.SOURCE)
    return raw.agg(F.count("*").alias("n_rows")).select(F.explode(F.array(*[F.lit(m) for m in missing])).alias("column_name"), "n_rows")


add("l01_missing_columns", _columns_check, "select 'YearsWithCurrManager' as column_name, count(*) as n_rows from raw_people")
add(
    "l02_expected_counts",
    lambda w: checks.count_mismatches(
        w["staging_employees"], {"total": 130_000, "current": 100_000, "historical": 30_000, "employees": 100_000}
    ),
    """select measure, expected, found from (
     select 'total' as measure, cast(130000 as bigint) as expected, count(*) as found from staging_employees
     union all select 'current', 100000, count(*) from staging_employees where is_current = 1
     union all select 'historical', 30000, count(*) from staging_employees where is_current = 0
     union all select 'employees', 100000, count(distinct employee_id) from staging_employees) x where expected <> found""",
)
add(
    "l03_one_current_version",
    lambda w: checks.not_one_current(w["dirty_versions"]),
    """select employee_id, count(*) as total_versions, cast(sum(is_current) as bigint) as current_versions
    from dirty_versions group by employee_id having sum(is_current) <> 1""",
)
add(
    "l04_validity",
    lambda w: checks.bad_validity(w["dirty_versions"]),
    """select employee_id, employee_sk, 'start after end' as issue from dirty_versions where effective_start_date > effective_end_date
    union all select employee_id, employee_sk, 'current version ends' from dirty_versions
     where is_current = 1 and effective_end_date <> date '9999-12-31'
    union all select employee_id, employee_sk, 'history without reason' from dirty_versions
     where is_current = 0 and (change_reason is null or trim(change_reason) = '')""",
)


def _repeated_keys(w):
    """Every declared key of every table, and those of the damaged versions, with the values that repeat."""
    given = [(t, w[t], k) for t, keys in S.UNIQUE_KEYS.items() for k in keys]
    given += [("dirty_versions", w["dirty_versions"], ["employee_sk"]), ("current_versions", w["dirty_versions"].filter("is_current = 1"), ["Email"])]
    out = None
    for name, df, keys in given:
        found = checks.repeated(df, keys).agg(F.count("*").alias("repeated_values"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("n_rows"))
        line = found.select(F.lit(name).alias("table_name"), F.lit(", ".join(keys)).alias("key"), "repeated_values", "n_rows")
        out = line if out is None else out.unionByName(line)
    return out


def _repeated_sql(name: str, source: str, keys: list[str]) -> str:
    listed = ", ".join(keys)
    present = " and ".join(f"{k} is not null" for k in keys)
    return f"""select '{name}' as table_name, '{listed}' as key, count(*) as repeated_values, cast(coalesce(sum(n), 0) as bigint) as n_rows
    from (select count(*) as n from {source} where {present} group by {listed} having count(*) > 1) x"""


add(
    "l05_repeated_keys",
    _repeated_keys,
    " union all ".join(
        [_repeated_sql(t, t, k) for t, keys in S.UNIQUE_KEYS.items() for k in keys]
        + [_repeated_sql("dirty_versions", "dirty_versions", ["employee_sk"])]
        + [_repeated_sql("current_versions", "(select * from dirty_versions where is_current = 1) d", ["Email"])]
    ),
)
add(
    "l06_overlaps",
    lambda w: overlapping(w["dirty_versions"]),
    """select employee_id, effective_start_date, effective_end_date, next_start_date from (
     select employee_id, effective_start_date, effective_end_date, lead(effective_start_date) over (
      partition by employee_id order by effective_start_date, employee_sk) as next_start_date from dirty_versions) x
    where next_start_date is not null and effective_end_date >= next_start_date""",
)
add(
    "l07_version_histogram",
    lambda w: checks.version_histogram(w["dim_employee"]),
    """select version_count, count(*) as employee_count from (select employee_id, count(*) as version_count
     from dim_employee group by employee_id) x group by version_count""",
)

HIRE_RULES = [
    ("first name is empty", "coalesce(trim(first_name), '') = ''"),
    ("last name is empty", "coalesce(trim(last_name), '') = ''"),
    ("e-mail is empty", "coalesce(trim(email), '') = ''"),
    ("education field is empty", "coalesce(trim(education_field), '') = ''"),
    ("unknown department", "department_name is null"),
    ("unknown job role", "job_role_id is null"),
    ("invalid e-mail address", "not (email like '%@%' and email like '%.%')"),
    ("first name contains a digit", "regexp_matches(first_name, '[0-9]')"),
    ("last name contains a digit", "regexp_matches(last_name, '[0-9]')"),
    ("years at company exceed working years", "years_at_company > total_working_years"),
    ("years in role exceed years at company", "years_in_current_role > years_at_company"),
    ("too many working years for the age", "age - 16 < total_working_years"),
    ("younger than 18", "age < 18"),
    ("income is not positive", "monthly_income <= 0"),
]
define(
    "checked_hires",
    "select x.*, case "
    + " ".join(f"when {test} then '{name}'" for name, test in HIRE_RULES)
    + " end as first_broken, cast("
    + " + ".join(f"case when {test} then 1 else 0 end" for _, test in HIRE_RULES)
    + """ as int) as n_broken from (select h.*, d.department_name, j.job_role_id from hires h
 left join departments d on d.department_id = h.department_id
 left join job_roles j on j.job_role_name = h.job_role and j.job_level = h.job_level) x""",
)
add(
    "l08_onboarding_rules",
    lambda w: oltp.check_hires(*w.many("hires", "departments", "job_roles")).select(
        "employee_number", "first_broken", F.size("broken_rules").alias("n_broken")
    ),
    "select employee_number, first_broken, n_broken from checked_hires",
)
define(
    "checked_projects",
    """select *, case when coalesce(trim(project_name), '') = '' then 'project name is empty'
 when end_date < start_date then 'end date before start date' end as first_broken from project_requests""",
)
define(
    "checked_assignments",
    """select *, case when allocation_ratio <= 0 or allocation_ratio > 100 then 'allocation outside 1 to 100'
 when end_date < assigned_date then 'end date before assigned date'
 when coalesce(trim(role_on_project), '') = '' then 'role is empty' end as first_broken from assignment_requests""",
)
add(
    "l09_project_and_assignment_rules",
    lambda w: rules.check_rows(w["project_requests"], rules.project_rules()).select(
        F.lit("project").alias("kind"), "request_seq", "first_broken"
    ).unionByName(
        rules.check_rows(w["assignment_requests"], rules.assignment_rules()).select(
            F.lit("assignment").alias("kind"), "request_seq", "first_broken"
        )
    ),
    """select 'project' as kind, request_seq, first_broken from checked_projects
    union all select 'assignment', request_seq, first_broken from checked_assignments""",
)


def _declared(w):
    """Every table against its declaration, and the raw source against its declared types."""
    out = checks.type_violations(w["raw_people"], S.SOURCE).select(F.lit("raw_people").alias("table_name"), "column_name", F.lit("type").alias("violation"), "n_rows")
    for name, schema in S.TABLES.items():
        out = out.unionByName(checks.schema_violations(w[name], schema).withColumn("table_name", F.lit(name)))
    return out


def _declared_sql() -> str:
    parts = ["select 'raw_people' as table_name, 'Age' as column_name, 'type' as violation, count(*) as n_rows from raw_people where Age is not null and try_cast(Age as int) is null"]
    for name, schema in S.TABLES.items():
        for f in schema.fields:
            if not f.nullable:
                parts.append(f"select '{name}', '{f.name}', 'null', count(*) from {name} where {f.name} is null")
            if "length" in f.metadata:
                parts.append(f"select '{name}', '{f.name}', 'too long', count(*) from {name} where length({f.name}) > {f.metadata['length']}")
    return "select * from (" + " union all ".join(parts) + ") x where n_rows > 0"


add("l10_declared_schema", _declared, _declared_sql())
add(
    "l11_foreign_keys",
    lambda w: checks.all_orphans({t: w[t] for t in S.TABLES}),
    " union all ".join(
        f"select '{k.table}' as table_name, '{k.column}' as column_name, count(distinct c.{k.column}) as missing_keys, "
        f"count(*) as n_rows from {k.table} c left join {k.target} p on p.{k.target_column} = c.{k.column} "
        f"where c.{k.column} is not null and p.{k.target_column} is null"
        for k in S.FOREIGN_KEYS
    ),
)
add(
    "l12_fact_outside_version",
    # The dimension as it would look after an unnoticed change of start dates.
    lambda w: checks.facts_outside_version(
        w["fact_performance_reviews"],
        w["dim_employee"].withColumn("effective_start_date", F.add_months("effective_start_date", 6)),
        w["dim_date"],
    ).select("review_sk", "employee_sk", "full_date"),
    """select f.review_sk, f.employee_sk, d.full_date from fact_performance_reviews f
    join dim_date d on d.date_sk = f.date_sk join dim_employee e on e.employee_sk = f.employee_sk
    where d.full_date not between cast(e.effective_start_date + interval 6 month as date) and e.effective_end_date""",
)
add(
    "l13_dropped_reviews",
    # All reviews against dimensions that were loaded before the last year and the first department came.
    lambda w: checks.dropped_reviews(
        *w.many("reviews", "dim_employee"), w["dim_department"].filter("department_sk > 1"), w["dim_date"].filter("full_date < date '1998-01-01'")
    ),
    """select review_id, employee_id, review_date, cause from (
     select r.review_id, r.employee_id, r.review_date, case when de.employee_sk is null then 'no version'
      when de.department_name = (select department_name from dim_department where department_sk = 1) then 'no department'
      when r.review_date >= date '1998-01-01' then 'no date' end as cause
     from reviews r left join dim_employee de on de.employee_id = r.employee_id
      and r.review_date between de.effective_start_date and de.effective_end_date) x where cause is not null""",
)


def _drifted(w):
    judged = judge_changes(*w.many("changes", "employee_job_history", "departments", "job_roles"))
    return checks.drift(apply_to_employees(w["employees"], judged.accepted), w["employee_job_history"]).select(
        "employee_id", "department_id", "version_department_id", "job_role_id", "version_job_role_id"
    )


add(
    "l14_drift",
    _drifted,
    """select employee_id, department_id, version_department_id, job_role_id, version_job_role_id from (
     select e.employee_id, coalesce(m.department_id, e.department_id) as department_id, h.department_id as version_department_id,
      coalesce(m.job_role_id, e.job_role_id) as job_role_id, h.job_role_id as version_job_role_id
     from employees e join employee_job_history h on h.employee_id = e.employee_id and h.is_current = 1
     left join moved m on m.employee_id = e.employee_id) x
    where department_id <> version_department_id or job_role_id <> version_job_role_id""",
)
def _income_drift(w):
    """After a batch of changes: employees keep the pay of before, their current version has the new one."""
    accepted = judge_changes(*w.many("changes", "employee_job_history", "departments", "job_roles")).accepted
    of = lambda df: df.select("employee_id", "department_id", "job_role_id", "monthly_income")
    versions = of(apply_to_history(w["employee_job_history"], accepted).history.filter("is_current = 1"))
    # Both are read twice, so the two results of the changes are written first, as a job that applies them would.
    sides = [written(of(apply_to_employees(w["employees"], accepted)), "changed-employees"), written(versions, "changed-versions")]
    found = differences.differing(*sides, ["employee_id"])
    return found.filter("in_left and in_right").select(
        "employee_id",
        *[F.col(f"{side}.{n}").alias(f"{side}_{n}") for n in ("department_id", "job_role_id", "monthly_income") for side in ("left", "right")],
    )


add(
    "l14_drift_after_changes",
    _income_drift,
    """select e.employee_id, coalesce(m.department_id, e.department_id) as left_department_id, h.department_id as right_department_id,
     coalesce(m.job_role_id, e.job_role_id) as left_job_role_id, h.job_role_id as right_job_role_id,
     e.monthly_income as left_monthly_income, h.monthly_income as right_monthly_income
    from employees e join changed_history h on h.employee_id = e.employee_id and h.is_current = 1
    left join moved m on m.employee_id = e.employee_id
    where coalesce(m.department_id, e.department_id) is distinct from h.department_id
     or coalesce(m.job_role_id, e.job_role_id) is distinct from h.job_role_id or e.monthly_income is distinct from h.monthly_income""",
)
add(
    "l15_row_count_report",
    lambda w: statistics.row_counts({t: w.figures(t) for t in S.TABLES}),
    " union all ".join(
        f"select '{t}' as table_name, count(*) as row_count, case when count(*) > 0 then 'loaded' else 'empty' end as status from {t}"
        for t in S.TABLES
    ),
)
