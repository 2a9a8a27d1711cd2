"""Type 2 versions: applying changes, and comparing a version with the one before it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.functions import pay
from rosterlake.operators.numbering import next_key, number_rows
from rosterlake.operators.ordering import in_order, latest
from rosterlake.operators.skew import lookup_join, with_group_values
from rosterlake.session import written


def last_change_per_day(changes: DataFrame) -> DataFrame:
    """One change per employee and day: the one with the highest change_seq."""
    return latest(changes, ["employee_id", "change_date"], ["change_seq"])


def of_employees(versions: DataFrame, named: DataFrame) -> DataFrame:
    """The versions of the employees that occur in another table; a small one is broadcast."""
    ids = named.select("employee_id").distinct()
    return lookup_join(versions, ids, ["employee_id"], "left_semi", spread_by=["employee_sk"])


@dataclass
class JudgedChanges:
    accepted: DataFrame
    rejected: DataFrame


def judge_changes(
    changes: DataFrame, history: DataFrame, departments: DataFrame, job_roles: DataFrame
) -> JudgedChanges:
    """Collapse a batch to one change per employee and day, and decide which can be applied.

    Rejected are changes to an unknown role or department, changes of an employee without a
    current version, and late ones: older than the current version's start. A late change that an
    older version, started on that day, states in full has been applied before and is passed over.
    """
    daily = written(last_change_per_day(changes), "daily-changes")
    history = of_employees(history, daily)
    roles = job_roles.select("job_role_id", "job_role_name", "job_level")
    known = departments.select("department_id", "department_name")
    current = latest(
        history.filter("is_current = 1").select("employee_id", "effective_start_date", "employee_sk"),
        ["employee_id"],
        ["effective_start_date", "employee_sk"],
    ).select("employee_id", F.col("effective_start_date").alias("current_start"))
    # An employee has few versions that start on one day, so these lists are short.
    content = ("department_id", "job_role_id", "monthly_income")
    starts = history.groupBy("employee_id", F.col("effective_start_date").alias("change_date")).agg(
        F.collect_set(F.struct(*[F.col(c).cast("long").alias(c) for c in content])).alias("stored")
    )

    resolved = lookup_join(daily, roles, ["job_role_name", "job_level"], "left")
    resolved = lookup_join(resolved, known, ["department_id"], "left")
    # One change per employee and day at most, so no employee can be hot from here on.
    resolved = resolved.join(current, "employee_id", "left").join(starts, ["employee_id", "change_date"], "left")
    asked = F.struct(*[F.col(c).cast("long").alias(c) for c in content])
    seen = F.coalesce(F.array_contains("stored", asked), F.lit(False))
    reason = (
        F.when(F.col("job_role_id").isNull(), "unknown job role")
        .when(F.col("department_name").isNull(), "unknown department")
        .when(F.col("current_start").isNull(), "no current version")
        .when((F.col("change_date") < F.col("current_start")) & ~seen, "late change")
    )
    # Written once: the accepted rows are read several times from here.
    judged = written(resolved.withColumn("reject_reason", reason), "judged")
    return JudgedChanges(
        accepted=judged.filter(F.col("reject_reason").isNull() & (F.col("change_date") >= F.col("current_start"))).drop(
            "reject_reason", "stored"
        ),
        rejected=judged.filter(F.col("reject_reason").isNotNull()).select(*changes.columns, "reject_reason"),
    )


def _chain(accepted: DataFrame) -> DataFrame:
    """Add each change's validity: up to the day before the employee's next change.

    An employee has at most one change per day here, so a window per employee stays small.
    """
    w = Window.partitionBy("employee_id").orderBy("change_date")
    following = F.lead("change_date").over(w)
    return accepted.withColumns(
        {
            "effective_start_date": F.col("change_date"),
            "effective_end_date": F.coalesce(F.date_sub(following, 1), F.lit(S.OPEN_END)),
            "is_current": F.when(following.isNull(), 1).otherwise(0),
        }
    )


def _per_employee(accepted: DataFrame, fields: list[str]) -> DataFrame:
    """Per employee: the first day a new version starts, and what replaces a same-day version."""
    same_day = F.col("change_date") == F.col("current_start")
    return accepted.groupBy("employee_id").agg(
        F.min(F.when(~same_day, F.col("change_date"))).alias("_first_new"),
        F.max(F.when(same_day, F.struct(*fields))).alias("_instead"),
    )


def _closed(df: DataFrame, summary: DataFrame, instead: dict[str, Column]) -> DataFrame:
    """Expire current versions that a new one follows, and overwrite same-day ones.

    Adds _touched. `instead` gives, per column, the value that a same-day change puts in place.
    """
    # A batch that concerns few employees is broadcast, and the table is not shuffled at all.
    joined = lookup_join(df, summary, ["employee_id"], "left", spread_by=["employee_sk"], measure=df)
    current = F.col("is_current") == 1
    expire = current & F.col("_first_new").isNotNull()
    replace = current & F.col("_instead").isNotNull()
    columns = {c: F.when(replace, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in instead.items()}
    columns["effective_end_date"] = F.when(expire, F.date_sub("_first_new", 1)).otherwise(F.col("effective_end_date"))
    columns["is_current"] = F.when(expire, 0).otherwise(F.col("is_current"))
    return joined.select(
        *[columns.get(c, F.col(c)).alias(c) for c in df.columns], (expire | replace).alias("_touched")
    )


# What a change of post does to the tracked counters of a version.
_RESET = {
    "business_travel": "Non-Travel",
    "over_time": "No",
    "stock_option_level": 0,
    "percent_salary_hike": 0,
    "years_in_current_role": 0,
    "years_since_last_promotion": 0,
    "years_with_curr_manager": 0,
}


def _reset() -> dict[str, Column]:
    return {c: F.lit(v) for c, v in _RESET.items()}

_CHANGED = ["department_id", "department_name", "job_role_id", "job_role_name", "job_level", "monthly_income", "change_reason"]


def _rates(income: Column) -> dict[str, Column]:
    return {
        "daily_rate": pay.daily_rate(income),
        "hourly_rate": pay.hourly_rate(income),
        "monthly_rate": pay.monthly_rate(income),
    }


@dataclass
class AppliedChanges:
    """history is the whole new table; touched are its rows that are new or differ from before."""

    history: DataFrame
    touched: DataFrame
    added: DataFrame


def apply_to_history(history: DataFrame, accepted: DataFrame, keys_from: DataFrame | None = None) -> AppliedChanges:
    """Expire the current version the day before a change, and add a version per change.

    New versions reset travel, overtime and counters. Keys go on after the highest one in
    keys_from (by default history), in order of employee and start. A change on the very day the
    current version starts replaces its content and keeps its key, so applying a batch again
    changes nothing.
    """
    keys = history if keys_from is None else keys_from
    new = _chain(accepted).filter(F.col("change_date") > F.col("current_start"))
    new = number_rows(new, ["employee_id", "effective_start_date"], "_n")
    income = F.col("monthly_income")
    added = new.withColumns(
        {
            "employee_sk": F.col("_n") + F.lit(next_key(keys, "employee_sk") - 1),
            "job_history_id": F.col("_n") + F.lit(next_key(keys, "job_history_id") - 1),
            **_rates(income),
            **_reset(),
        }
    )
    instead = {c: F.col(f"_instead.{c}") for c in _CHANGED if c in history.columns}
    instead |= _rates(F.col("_instead.monthly_income")) | _reset()
    old = _closed(history, _per_employee(accepted, _CHANGED), instead)
    fresh = S.shaped(added, history.schema)
    return AppliedChanges(
        history=old.drop("_touched").unionByName(fresh),
        touched=old.filter("_touched").drop("_touched").unionByName(fresh),
        added=added.select(*history.columns, "department_name", "job_role_name"),
    )


def apply_to_dimension(dim_employee: DataFrame, accepted: DataFrame, added: DataFrame) -> DataFrame:
    """The same changes in the employee dimension.

    Here a new version copies everything that the change does not name from the version before
    it, travel and counters included. Keys are those of the history table.
    """
    changed = {
        "department_name": F.col("_instead.department_name"),
        "job_role": F.col("_instead.job_role_name"),
        "job_level": F.col("_instead.job_level"),
        "monthly_income": F.col("_instead.monthly_income"),
        "change_reason": F.col("_instead.change_reason"),
        "daily_rate": pay.daily_rate(F.col("_instead.monthly_income")),
        "hourly_rate": pay.hourly_rate(F.col("_instead.monthly_income")),
    }
    old = _closed(dim_employee, _per_employee(accepted, _CHANGED), changed).drop("_touched")
    named = [
        "employee_sk",
        "employee_id",
        "department_name",
        "job_level",
        "monthly_income",
        "daily_rate",
        "hourly_rate",
        "change_reason",
        "effective_start_date",
        "effective_end_date",
        "is_current",
    ]
    before = latest(of_employees(dim_employee, added), ["employee_id"], ["effective_end_date", "employee_sk"]).drop(
        *[c for c in named if c != "employee_id"], "job_role"
    )
    new = added.select(*named, F.col("job_role_name").alias("job_role")).join(before, "employee_id")
    return old.unionByName(S.shaped(new, dim_employee.schema))


def apply_to_employees(employees: DataFrame, accepted: DataFrame) -> DataFrame:
    """Move the current-state rows to the last department and role; pay stays as it was."""
    last = latest(
        accepted.select("employee_id", "change_date", "department_id", "job_role_id"), ["employee_id"], ["change_date"]
    ).drop("change_date")
    return update_rows(employees, last, ["employee_id"])


def update_rows(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed update: rows found in changes take its other columns, NULLs included."""
    values = [c for c in changes.columns if c not in keys]
    marked = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_hit"))
    joined = lookup_join(df, marked, keys, "left", measure=df)
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}").cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c in values
            else F.col(c)
            for c in df.columns
        ]
    )


def mark_attrition(employees: DataFrame, leavers: DataFrame) -> DataFrame:
    gone = leavers.select("employee_id").distinct().withColumn("attrition", F.lit("Yes"))
    return update_rows(employees, gone, ["employee_id"])


def compare_with_previous(versions: DataFrame, compared: dict[str, str]) -> DataFrame:
    """Add version_num, total_versions and the previous version's values of some columns."""
    numbered = in_order(
        versions,
        ["employee_id"],
        ["effective_start_date", "employee_sk"],
        number="version_num",
        previous=compared,
    )
    return with_group_values(numbered, ["employee_id"], {"total_versions": F.count("*")})


def overlapping(versions: DataFrame) -> DataFrame:
    """Versions that end on or after the start of the employee's next version."""
    return (
        in_order(
            versions.select("employee_id", "employee_sk", "effective_start_date", "effective_end_date"),
            ["employee_id"],
            ["effective_start_date", "employee_sk"],
            following={"next_start_date": "effective_start_date"},
        )
        .filter(F.col("effective_end_date") >= F.col("next_start_date"))
        .select("employee_id", "effective_start_date", "effective_end_date", "next_start_date")
    )
