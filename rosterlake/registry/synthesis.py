"""Resampling, variation, identities and generated versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.functions.text import tidy_all
from rosterlake.operators import checks
from rosterlake.plans import synthesis as syn
from rosterlake.registry.core import add, define
from rosterlake.registry.rows import hash_uniform

c = F.col


def _people(w):
    return tidy_all(w["people"])


def _between(salt: str, low: float, high: float, entity: str = "employee_id") -> str:
    return f"({low!r}::double + ({high!r}::double - {low!r}::double) * {hash_uniform(entity, salt)})"


def _whole(salt: str, low: int, high: int, entity: str = "employee_id") -> str:
    return f"cast({low} + floor({hash_uniform(entity, salt)} * {high - low + 1}) as int)"


def _listed(salt: str, values: list, entity: str = "employee_id") -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"[{items}][1 + cast(floor({hash_uniform(entity, salt)} * {len(values)}) as int)]"


define("clean_people", "select * replace (trim(Department) as Department, trim(JobRole) as JobRole) from people")
define("people_rows", "select *, row_number() over (order by EmployeeNumber) as row_no from clean_people")
_KEPT = "Age, Department, JobRole, MonthlyIncome"


def _drawn(n: str, first: str) -> str:
    return f"""select {first} + x.i as EmployeeNumber, {', '.join('b.' + k for k in _KEPT.split(', '))}
    from (select unnest(range(0, cast({n} as bigint))) as i) x
    join people_rows b on b.row_no = 1 + cast('0x' || substring(md5(cast(x.i as varchar) || ':scale'), 1, 15) as bigint)
     % (select count(*) from people)"""


add(
    "i01_scale_to_target",
    lambda w: syn.scale_to_target(_people(w), 3 * w["people"].count()).select("EmployeeNumber", *_KEPT.split(", ")),
    f"select EmployeeNumber, {_KEPT} from clean_people union all "
    + _drawn("(select 2 * count(*) from people)", "(select max(EmployeeNumber) + 1 from people)"),
)
add(
    "i02_resample",
    lambda w: syn.resample(_people(w), 2 * w["people"].count(), 100_001).select("EmployeeNumber", *_KEPT.split(", ")),
    _drawn("(select 2 * count(*) from people)", "100001"),
)


def _varied_sql(column: str, spec: syn.Jitter) -> str:
    if spec.steps:
        value = f"coalesce(try_cast({column} as int), {spec.default}) + {_listed(column, list(spec.steps), 'EmployeeNumber')}"
    else:
        factor = _between(column, 1 - spec.share, 1 + spec.share, "EmployeeNumber")
        value = f"cast(round_even(coalesce(try_cast({column} as double), {spec.default}.0::double) * {factor}, 0) as int)"
    if spec.low is not None:
        value = f"greatest({spec.low}, least({spec.high}, {value}))"
    return f"cast({value} as int) as {column}"


add(
    "i03_variation",
    lambda w: syn.add_variation(w["raw_people"]).select("EmployeeNumber", *syn.VARIATION),
    "select EmployeeNumber, " + ", ".join(_varied_sql(n, s) for n, s in syn.VARIATION.items()) + " from raw_people",
)
add(
    "i03_income_noise",
    lambda w: syn.add_variation(_people(w), spec=syn.INCOME_NOISE).select("EmployeeNumber", "MonthlyIncome"),
    "select EmployeeNumber, " + _varied_sql("MonthlyIncome", syn.INCOME_NOISE["MonthlyIncome"]) + " from people",
)
_FIRST, _LAST = _listed("first", syn.FIRST_NAMES), _listed("last", syn.LAST_NAMES)
add(
    "i04_identity",
    lambda w: syn.add_identity(w["raw_people"]).select("employee_id", "EmployeeName", "Email"),
    f"""select employee_id, {_FIRST} || ' ' || {_LAST} as EmployeeName,
    lower({_FIRST} || '.' || {_LAST} || '.' || employee_id || '@example.com') as Email from people""",
)
add(
    "i04_unique_emails",
    lambda w: syn.unique_emails(
        w["staging_employees"].select("employee_sk", "Email"), ["employee_sk"]
    ),
    """select employee_sk, case when n > 0 then replace(Email, '@example.com', '.' || n || '@example.com') else Email end as Email
    from (select employee_sk, Email, row_number() over (partition by Email order by employee_sk) - 1 as n from staging_employees) x""",
)
_SHARE = "(select cast(floor(count(*) * 0.3) as bigint) from people)"
define(
    "chosen",
    f"""select employee_id from (select employee_id, row_number() over (order by {hash_uniform('employee_id', 'subset')}, employee_id) as n
 from people) x where n <= {_SHARE}""",
)


def _subset_size(w) -> int:
    return w["people"].count() * 3 // 10


add(
    "i05_random_subset",
    lambda w: syn.random_subset(_people(w), _subset_size(w)).select("employee_id", "Email"),
    "select employee_id, Email from people where employee_id in (select employee_id from chosen)",
)


def _weighted_sql() -> str:
    u = hash_uniform("employee_id", "change")
    return (
        f"case when {u} < 0.4 then 'Promotion' when {u} < 0.65 then 'Salary Revision' "
        f"when {u} < 0.85 then 'Department Transfer' else 'Role Change' end"
    )


add(
    "i06_weighted_choice",
    lambda w: w["people"].select("employee_id", syn.chance.weighted(c("employee_id"), "change", syn.CHANGE_WEIGHTS).alias("change_reason")),
    f"select employee_id, {_weighted_sql()} as change_reason from people",
)

for _column, _name, _salt in (("Department", "other_department", "department"), ("JobRole", "other_role", "role")):
    define(
        f"{_name}_list",
        f"select {_column} as v, row_number() over (order by {_column}) as n from (select distinct {_column} from clean_people) x",
    )
    define(
        _name,
        f"""select y.employee_id, o.v from (select employee_id, n, 1 + cast(floor({hash_uniform('employee_id', _salt)}
  * ((select count(*) from {_name}_list) - 1)) as bigint) as draw from clean_people join {_name}_list on v = {_column}) y
 join {_name}_list o on o.n = case when y.draw >= y.n then y.draw + 1 else y.draw end""",
    )


def _changed_sql(reason: str, rows: str = "clean_people") -> str:
    income = "p.MonthlyIncome"
    return f"""select p.* replace (
     case when reason = 'Department Transfer' then d.v else p.Department end as Department,
     case when reason = 'Role Change' then r.v else p.JobRole end as JobRole,
     cast(case reason when 'Promotion' then least(p.JobLevel + 1, 5)
      when 'Role Change' then least(p.JobLevel + {_whole('role level', 0, 1, 'p.employee_id')}, 5) else p.JobLevel end as int) as JobLevel,
     cast(case reason when 'Promotion' then {income} + greatest(cast(round_even({income} * {_between('promotion', 0.08, 0.2, 'p.employee_id')}, 0) as int), 500)
      when 'Salary Revision' then {income} + greatest(cast(round_even({income} * {_between('revision', 0.05, 0.15, 'p.employee_id')}, 0) as int), 100)
      when 'Role Change' then round_even({income} * {_between('role pay', 1.05, 1.18, 'p.employee_id')}, 0)
      else {income} end as int) as MonthlyIncome,
     cast(case reason when 'Promotion' then {_whole('promotion hike', 8, 20, 'p.employee_id')}
      when 'Salary Revision' then {_whole('revision hike', 5, 15, 'p.employee_id')} else p.PercentSalaryHike end as int) as PercentSalaryHike,
     cast(case when reason in ('Promotion', 'Role Change') then 0 else p.YearsInCurrentRole end as int) as YearsInCurrentRole,
     cast(case when reason = 'Promotion' then 0 else p.YearsSinceLastPromotion end as int) as YearsSinceLastPromotion),
     reason as change_reason
    from (select *, {reason} as reason from {rows}) q join {rows} p on p.employee_id = q.employee_id
    join other_department d on d.employee_id = p.employee_id join other_role r on r.employee_id = p.employee_id"""


_SHOWN = (
    "employee_id, Department, JobRole, JobLevel, MonthlyIncome, PercentSalaryHike, YearsInCurrentRole, "
    "YearsSinceLastPromotion, change_reason"
)


def _changed(w, reason: str):
    people = _people(w)
    return syn.apply_change(syn.with_other_places(people, people), F.lit(reason)).select(*_SHOWN.split(", "))


for _id, _label, _reason in (
    ("i07", "salary_revision", "Salary Revision"),
    ("i08", "department_transfer", "Department Transfer"),
    ("i09", "promotion", "Promotion"),
    ("i10", "role_change", "Role Change"),
):
    add(
        f"{_id}_{_label}",
        lambda w, reason=_reason: _changed(w, reason),
        f"select {_SHOWN} from ({_changed_sql(repr(_reason))}) z",
    )

define("changed_people", _changed_sql(_weighted_sql()))
_DATED = f"{_SHOWN}, effective_start_date, effective_end_date, is_current"
_BACK = f"cast(date '2026-01-01' - interval '1' month * {_whole('months', 12, 36)} as date)"
define(
    "made_versions",
    f"""select {_SHOWN}, {_BACK} as effective_start_date, date '2025-12-31' as effective_end_date, cast(0 as int) as is_current
 from changed_people where employee_id in (select employee_id from chosen)
union all
select {_SHOWN.replace('change_reason', "'Current Record'")}, date '2026-01-01', date '9999-12-31', 1 from clean_people""",
)
add(
    "i11_version_set",
    lambda w: syn.make_versions(_people(w), _subset_size(w)).select(*_DATED.split(", ")),
    "select * from made_versions",
)
add(
    "i11_version_set_current_changed",
    lambda w: syn.make_versions(_people(w), _subset_size(w), apply_to="current").select(*_DATED.split(", ")),
    f"""select {_SHOWN.replace('change_reason', _weighted_sql() + ' as change_reason')}, {_BACK} as effective_start_date,
     date '2025-12-31' as effective_end_date, cast(0 as int) as is_current
    from clean_people where employee_id in (select employee_id from chosen)
    union all
    select {_SHOWN}, date '2026-01-01', date '9999-12-31', 1 from changed_people where employee_id in (select employee_id from chosen)
    union all
    select {_SHOWN.replace('change_reason', "'Current Record'")}, date '2026-01-01', date '9999-12-31', 1 from clean_people
     where employee_id not in (select employee_id from chosen)""",
)
add(
    "i11_whole_synthesis",
    lambda w: checks.version_counts(syn.synthesise(w["raw_people"], 2 * w["people"].count(), 0.30)),
    """select n + h as total, n as current, h as historical, n as employees, n + h as keys
    from (select 2 * count(*) as n, cast(round_even(2 * count(*) * 0.3, 0) as bigint) as h from people) x""",
)
add(
    "i12_version_keys",
    lambda w: syn.number_versions(syn.make_versions(_people(w), _subset_size(w))).select(
        "employee_sk", "employee_id", "is_current", "effective_start_date"
    ),
    """select row_number() over (order by is_current, employee_id, effective_start_date) as employee_sk, employee_id, is_current,
    effective_start_date from made_versions""",
)
define(
    "forward_chosen",
    f"""select EmployeeNumber from (select EmployeeNumber, row_number() over (
  order by {hash_uniform('EmployeeNumber', 'forward')}, EmployeeNumber) as n from people) x
 where n <= (select cast(floor(count(*) * 0.25) as bigint) from people)""",
)
add(
    "i13_forward_versions",
    lambda w: syn.forward_versions(_people(w)).select(
        "SCD_SK", "EmployeeNumber", "MonthlyIncome", "JobLevel", "EffectiveDate", "EndDate", "IsCurrent"
    ),
    f"""select row_number() over (order by EmployeeNumber, EffectiveDate) as SCD_SK, * from (
     select p.EmployeeNumber, MonthlyIncome, JobLevel, date '2022-01-01' as EffectiveDate,
      case when f.EmployeeNumber is not null then date '2024-01-01' end as EndDate,
      cast(case when f.EmployeeNumber is not null then 0 else 1 end as int) as IsCurrent
     from people p left join forward_chosen f on f.EmployeeNumber = p.EmployeeNumber
     union all
     select EmployeeNumber, cast(round_even(MonthlyIncome * {_between('forward pay', 1.1, 1.2, 'EmployeeNumber')}, 0) as int),
      cast(least(JobLevel + 1, 5) as int), date '2024-01-01', cast(null as date), 1
     from people where EmployeeNumber in (select EmployeeNumber from forward_chosen)) x""",
)
define(
    "generated_projects",
    """select row_number() over (order by department_id, project_name) as project_id, project_name, department_id, start_date, end_date, status
from (select d.department_name || ' - ' || k.ending as project_name, d.department_id, min(s.effective_start_date) as start_date,
  max(s.effective_end_date) as end_date, k.status from staging_employees s join departments d on d.department_name = trim(s.Department)
 cross join (values ('Initiative Alpha', 'Completed'), ('Initiative Beta', 'Active'), ('Initiative Gamma', 'In Progress')) k(ending, status)
 group by d.department_name, d.department_id, k.ending, k.status) x""",
)
add(
    "i14_generated_projects",
    lambda w: syn.make_projects(w["staging_employees"], w["departments"]),
    "select * from generated_projects",
)
add(
    "i15_spread_over_projects",
    lambda w: syn.spread_over_projects(
        w["employees"], syn.make_projects(w["staging_employees"], w["departments"]), w["job_roles"], w["staging_employees"]
    ),
    """select row_number() over (order by e.employee_id, s.effective_start_date) as assignment_id, e.employee_id, p.project_id,
     j.job_role_name as role_on_project,
     cast(case e.employee_id % 3 when 0 then 1.00 when 1 then 0.75 else 0.50 end as decimal(5,2)) as allocation_ratio,
     s.effective_start_date as assigned_date, cast(null as date) as end_date
    from employees e join (select project_id, department_id, row_number() over (partition by department_id order by project_id) as place
     from generated_projects) p on p.department_id = e.department_id and p.place = e.employee_id % 3 + 1
    join job_roles j on j.job_role_id = e.job_role_id
    join staging_employees s on s.employee_id = e.employee_id and s.is_current = 1""",
)
