"""Scaling a small employee table, varying it, and giving it a version history.

All random choices hash the employee id (rosterlake.functions.chance), so results do not depend
on partitioning.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.functions import chance, pay, text
from rosterlake.operators import checks
from rosterlake.operators.numbering import first_n, number_lookup, number_rows
from rosterlake.operators.ordering import in_order
from rosterlake.operators.skew import lookup_join

# Fixed values of the generated history.
CURRENT_START = dt.date(2026, 1, 1)
FIRST_MONTHS_BACK, LAST_MONTHS_BACK = 12, 36
CHANGE_WEIGHTS = {"Promotion": 0.40, "Salary Revision": 0.25, "Department Transfer": 0.20, "Role Change": 0.15}
TOP_LEVEL = 5

# Name lists to draw from.
FIRST_NAMES = "Ada Amir Bea Carl Dina Emil Fay Gus Hana Ivan Jana Kofi Lena Milo Nora Omar Pia Quin Rosa Sven".split()
LAST_NAMES = "Abel Berg Cole Diaz Egan Frey Gold Holm Ives Jung Kern Lund Mora Nash Otto Park Roth Silva Tran Weiss".split()


def source_columns(df: DataFrame) -> DataFrame:
    """Repair the misspelt manager column, require the source columns and trim all texts."""
    named = df.withColumnRenamed("YearsWithCurrManaer", "YearsWithCurrManager")
    checks.require_columns(named, S.SOURCE)
    return text.tidy_all(named.select(*S.SOURCE.names))


def scale_to_target(base: DataFrame, target: int, key: str = "EmployeeNumber", salt: str = "scale") -> DataFrame:
    """The base rows plus whole rows drawn from them with replacement, under fresh numbers.

    With target rows or more in the base, its first target rows in key order.
    """
    size = base.count()
    if size >= target:
        return first_n(base, [key], target)
    top = base.agg(F.max(F.col(key).cast("long"))).first()[0]
    extra = resample(base, target - size, top + 1, key, salt)
    kept = base.withColumn(key, F.col(key).cast("long"))
    return kept.unionByName(extra)


def resample(base: DataFrame, n: int, first_number: int, key: str = "EmployeeNumber", salt: str = "scale") -> DataFrame:
    """n whole rows drawn with replacement, numbered from first_number.

    Draws are uniform over the base, so the join on the drawn position is even.
    """
    rows = number_rows(base, [key], "_row")
    size = base.count()
    drawn = base.sparkSession.range(n).select(
        (F.col("id") + F.lit(first_number)).alias("_number"),
        (chance.position(F.col("id"), salt, size) + 1).alias("_row"),
    )
    return drawn.join(rows, "_row").withColumn(key, F.col("_number")).select(*base.columns)


@dataclass(frozen=True)
class Jitter:
    """How one column varies: add one of `steps`, or multiply by 1 ± share; then clamp."""

    default: int
    steps: tuple[int, ...] = ()
    share: float = 0.0
    low: int | None = None
    high: int | None = None


# Defaults, steps, shares and limits per column.
VARIATION = {
    "Age": Jitter(35, steps=(-2, -1, 0, 0, 0, 1, 2), low=18, high=65),
    "DailyRate": Jitter(800, share=0.10),
    "HourlyRate": Jitter(60, share=0.08, low=30, high=100),
    "MonthlyRate": Jitter(15000, share=0.08),
    "MonthlyIncome": Jitter(5000, share=0.08),
    "DistanceFromHome": Jitter(5, steps=(-2, -1, 0, 0, 1, 2), low=1, high=50),
    "TrainingTimesLastYear": Jitter(3, steps=(-1, 0, 0, 0, 1), low=0, high=10),
}

INCOME_NOISE = {"MonthlyIncome": Jitter(5000, share=0.05)}


def _varied(column: str, spec: Jitter, entity_id: Column) -> Column:
    if spec.steps:
        value = pay.whole_or(F.col(column), spec.default) + chance.pick_of(entity_id, column, list(spec.steps))
    else:
        number = F.coalesce(F.col(column).try_cast("double"), F.lit(float(spec.default)))
        factor = chance.uniform_between(entity_id, column, 1 - spec.share, 1 + spec.share)
        value = pay.half_even(number * factor).cast("int")
    return value if spec.low is None else pay.clamp(value, spec.low, spec.high)


def add_variation(df: DataFrame, key: str = "EmployeeNumber", spec: dict[str, Jitter] = VARIATION) -> DataFrame:
    return df.withColumns({c: _varied(c, j, F.col(key)).cast("int") for c, j in spec.items()})


def add_identity(df: DataFrame, key: str = "EmployeeNumber") -> DataFrame:
    """employee_id, a drawn name, and an e-mail that is unique because the id is."""
    entity = F.col("employee_id")
    named = df.withColumn("employee_id", F.col(key).cast("long")).withColumns(
        {
            "_first": chance.pick_of(entity, "first", FIRST_NAMES),
            "_last": chance.pick_of(entity, "last", LAST_NAMES),
        }
    )
    return named.withColumns(
        {
            "EmployeeName": text.full_name(F.col("_first"), F.col("_last")),
            "Email": text.email_for(F.col("_first"), F.col("_last"), entity),
        }
    ).drop("_first", "_last")


def unique_emails(df: DataFrame, order: list[str]) -> DataFrame:
    """Add .1, .2, … before the @ of the second, third, … row with the same address."""
    numbered = in_order(df, ["Email"], order, number="_copy")
    return numbered.withColumn("Email", text.email_variant(F.col("Email"), F.col("_copy") - 1)).drop("_copy")


def random_subset(df: DataFrame, n: int, key: str = "employee_id", salt: str = "subset") -> DataFrame:
    """Exactly n rows without replacement: those with the smallest hash of their key.

    Rows clearly beyond the n-th hash are dropped first. Only if that left too few are all rows
    numbered.
    """
    size = df.count()
    draws = df.withColumn("_draw", chance.uniform(F.col(key), salt))
    slack = 6 * (max(n, 1) ** 0.5)
    likely = draws.filter(F.col("_draw") <= (n + slack) / max(size, 1))
    pool = likely if likely.count() >= min(n, size) else draws
    return first_n(pool, ["_draw", key], n).drop("_draw")


def _another(df: DataFrame, column: str, salt: str, values: DataFrame) -> DataFrame:
    """Add _other_<column>: one of the other values of the column, each equally likely.

    The distinct values are numbered; a row draws a number among those that are not its own.
    """
    listed = number_lookup(values.select(column).filter(F.col(column).isNotNull()).distinct(), [column], "_own")
    size = listed.count()
    if size < 2:
        return df.withColumn(f"_other_{column}", F.col(column))
    placed = lookup_join(df, listed, [column], "left", spread_by=["employee_id"])
    draw = F.floor(chance.uniform(F.col("employee_id"), salt) * (size - 1)) + 1
    placed = placed.withColumn("_other", F.when(draw >= F.col("_own"), draw + 1).otherwise(draw))
    others = listed.select(F.col("_own").alias("_other"), F.col(column).alias(f"_other_{column}"))
    return lookup_join(placed, others, ["_other"], "left", spread_by=["employee_id"]).drop("_own", "_other")


def _raise(low: float, high: float, least: int, salt: str) -> Column:
    income = F.col("MonthlyIncome")
    gain = pay.half_even(income * chance.uniform_between(F.col("employee_id"), salt, low, high)).cast("int")
    return income + F.greatest(gain, F.lit(least))


def salary_revision() -> dict[str, Column]:
    """5 to 15 % more, at least 100."""
    return {
        "MonthlyIncome": _raise(0.05, 0.15, 100, "revision"),
        "PercentSalaryHike": chance.whole_between(F.col("employee_id"), "revision hike", 5, 15),
    }


def promotion() -> dict[str, Column]:
    """One level up to the highest, 8 to 20 % more and at least 500, years in role start again."""
    return {
        "JobLevel": F.least(F.col("JobLevel") + 1, F.lit(TOP_LEVEL)),
        "MonthlyIncome": _raise(0.08, 0.20, 500, "promotion"),
        "PercentSalaryHike": chance.whole_between(F.col("employee_id"), "promotion hike", 8, 20),
        "YearsInCurrentRole": F.lit(0),
        "YearsSinceLastPromotion": F.lit(0),
    }


def department_transfer() -> dict[str, Column]:
    return {"Department": F.col("_other_Department")}


def role_change() -> dict[str, Column]:
    """Another role, perhaps one level up, 5 to 18 % more, years in role start again."""
    factor = chance.uniform_between(F.col("employee_id"), "role pay", 1.05, 1.18)
    return {
        "JobRole": F.col("_other_JobRole"),
        "JobLevel": F.least(
            F.col("JobLevel") + chance.whole_between(F.col("employee_id"), "role level", 0, 1), F.lit(TOP_LEVEL)
        ),
        "MonthlyIncome": pay.half_even(F.col("MonthlyIncome").cast("double") * factor).cast("int"),
        "YearsInCurrentRole": F.lit(0),
    }


def with_other_places(df: DataFrame, population: DataFrame) -> DataFrame:
    """Add the department and role that a transfer or role change would move to."""
    moved = _another(df, "Department", "department", population)
    return _another(moved, "JobRole", "role", population)


def apply_change(df: DataFrame, reason: Column, changes: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    """Set change_reason and change each row in the way its reason says.

    df carries the columns of with_other_places.
    """
    changes = changes or {
        "Promotion": promotion(),
        "Salary Revision": salary_revision(),
        "Department Transfer": department_transfer(),
        "Role Change": role_change(),
    }
    named = df.withColumn("change_reason", reason)
    values: dict[str, Column] = {}
    for name, columns in changes.items():
        for column, value in columns.items():
            test = F.col("change_reason") == name
            chain = values.get(column)
            values[column] = F.when(test, value) if chain is None else chain.when(test, value)
    types = {f.name: f.dataType for f in df.schema.fields}
    changed = named.withColumns({c: v.otherwise(F.col(c)).cast(types[c]) for c, v in values.items()})
    return changed.drop("_other_Department", "_other_JobRole")


def make_versions(
    people: DataFrame,
    history_rows: int,
    apply_to: str = "history",
    current_start: dt.date = CURRENT_START,
) -> DataFrame:
    """Current versions of everybody and an earlier version of history_rows of them.

    The change falls on the earlier version (apply_to="history"), which then is ahead of the
    present one, or on the present version (apply_to="current").
    """
    if apply_to not in ("history", "current"):
        raise ValueError("apply_to is 'history' or 'current'")
    reason = chance.weighted(F.col("employee_id"), "change", CHANGE_WEIGHTS)
    chosen = random_subset(people, history_rows)
    changed = apply_change(with_other_places(chosen, people), reason)
    back = chance.whole_between(F.col("employee_id"), "months", FIRST_MONTHS_BACK, LAST_MONTHS_BACK)

    def past(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "effective_start_date": F.add_months(F.lit(current_start), -back),
                "effective_end_date": F.date_sub(F.lit(current_start), 1),
                "is_current": F.lit(0),
            }
        )

    def present(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "effective_start_date": F.lit(current_start),
                "effective_end_date": F.lit(S.OPEN_END),
                "is_current": F.lit(1),
            }
        )

    if apply_to == "history":
        current = present(people).withColumn("change_reason", F.lit("Current Record"))
        return past(changed).unionByName(current)
    others = people.join(chosen.select("employee_id"), "employee_id", "left_anti")
    unchanged = present(others).withColumn("change_reason", F.lit("Current Record"))
    return past(chosen.withColumn("change_reason", reason)).unionByName(present(changed)).unionByName(unchanged)


def number_versions(versions: DataFrame) -> DataFrame:
    """employee_sk: history first, then current versions, by employee and start."""
    return number_rows(versions, ["is_current", "employee_id", "effective_start_date"], "employee_sk")


def final_columns(versions: DataFrame) -> DataFrame:
    """The 43 columns in order, sorted by employee and start within each file."""
    ordered = S.shaped(versions, S.STAGING)
    checks.require_order(ordered, S.STAGING)
    return ordered.sortWithinPartitions("employee_id", "effective_start_date", "employee_sk")


def synthesise(source: DataFrame, target: int, history_share: float = 0.30) -> DataFrame:
    """From a source table to staged versions: clean, scale, vary, name, version, number."""
    people = add_identity(add_variation(scale_to_target(source_columns(source), target)))
    return final_columns(number_versions(make_versions(people, round(target * history_share))))


def forward_versions(
    people: DataFrame,
    share: float = 0.25,
    first_start: dt.date = dt.date(2022, 1, 1),
    second_start: dt.date = dt.date(2024, 1, 1),
) -> DataFrame:
    """Version 1 of everybody, and for a share of them a raised and promoted version 2.

    The open end is NULL, and version 1 ends on the day version 2 starts.
    """
    chosen = random_subset(people, int(people.count() * share), "EmployeeNumber", "forward")
    flagged = people.join(
        chosen.select("EmployeeNumber", F.lit(True).alias("_changed")), "EmployeeNumber", "left"
    )
    ended = F.coalesce(F.col("_changed"), F.lit(False))
    first = flagged.withColumns(
        {
            "EffectiveDate": F.lit(first_start),
            "EndDate": F.when(ended, F.lit(second_start)),
            "IsCurrent": F.when(ended, 0).otherwise(1),
        }
    ).drop("_changed")
    factor = chance.uniform_between(F.col("EmployeeNumber"), "forward pay", 1.10, 1.20)
    second = chosen.withColumns(
        {
            "MonthlyIncome": pay.half_even(F.col("MonthlyIncome") * factor).cast("int"),
            "JobLevel": F.least(F.col("JobLevel") + 1, F.lit(TOP_LEVEL)),
            "EffectiveDate": F.lit(second_start),
            "EndDate": F.lit(None).cast("date"),
            "IsCurrent": F.lit(1),
        }
    )
    return number_rows(first.unionByName(second), ["EmployeeNumber", "EffectiveDate"], "SCD_SK")


# Name ending and status of the projects made for each department.
GENERATED_PROJECTS = [
    ("Initiative Alpha", "Completed"),
    ("Initiative Beta", "Active"),
    ("Initiative Gamma", "In Progress"),
]


def make_projects(staging: DataFrame, departments: DataFrame) -> DataFrame:
    """Three projects per department that span the dates of its staged versions."""
    spans = (
        staging.groupBy(F.trim("Department").alias("department_name"))
        .agg(F.min("effective_start_date").alias("start_date"), F.max("effective_end_date").alias("end_date"))
    )
    kinds = F.array(
        *[F.struct(F.lit(n).alias("ending"), F.lit(s).alias("status")) for n, s in GENERATED_PROJECTS]
    )
    rows = (
        lookup_join(spans, departments, ["department_name"])
        .withColumn("kind", F.explode(kinds))
        .select(
            F.concat("department_name", F.lit(" - "), "kind.ending").alias("project_name"),
            "department_id",
            "start_date",
            "end_date",
            "kind.status",
        )
    )
    return S.shaped(number_lookup(rows, ["department_id", "project_name"], "project_id"), S.PROJECTS)


def spread_over_projects(
    employees: DataFrame,
    projects: DataFrame,
    job_roles: DataFrame,
    staging: DataFrame,
    as_percent: bool = False,
) -> DataFrame:
    """One assignment per employee: to the project of their department whose rank fits their id.

    Allocations are shares from 0.50 to 1.00, or percentages with as_percent, the form that the
    batch writes and reports use.
    """
    share = pay.allocation_share(F.col("employee_id"))
    places = in_order(projects.select("project_id", "department_id"), ["department_id"], ["project_id"], number="place")
    current = staging.filter("is_current = 1").select(
        "employee_id",
        F.col("effective_start_date").alias("assigned_date"),
        F.when(F.col("is_current") != 1, F.col("effective_end_date")).alias("end_date"),
    )
    people = employees.select(
        "employee_id", "department_id", "job_role_id", (F.pmod(F.col("employee_id"), F.lit(3)) + 1).alias("place")
    )
    rows = lookup_join(people, places, ["department_id", "place"], spread_by=["employee_id"])
    roles = job_roles.select("job_role_id", F.col("job_role_name").alias("role_on_project"))
    rows = lookup_join(rows, roles, ["job_role_id"], spread_by=["employee_id"], measure=employees)
    rows = rows.join(current, "employee_id").withColumn("allocation_ratio", share * 100 if as_percent else share)
    return S.shaped(number_rows(rows, ["employee_id", "assigned_date"], "assignment_id"), S.ASSIGNMENTS)
