"""Row rules: each broken rule is named, and a batch is split into good and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import text


def _blank(name: str) -> Column:
    return F.coalesce(~text.not_blank(F.col(name)), F.lit(True))


def onboarding_rules() -> dict[str, Column]:
    """What makes a new hire unacceptable, in the order in which it is reported.

    Expects department_name and job_role_id from a lookup, NULL where nothing was found.
    """
    c = F.col
    return {
        "first name is empty": _blank("first_name"),
        "last name is empty": _blank("last_name"),
        "e-mail is empty": _blank("email"),
        "education field is empty": _blank("education_field"),
        "unknown department": c("department_name").isNull(),
        "unknown job role": c("job_role_id").isNull(),
        "invalid e-mail address": ~text.looks_like_email(c("email")),
        "first name contains a digit": text.has_digit(c("first_name")),
        "last name contains a digit": text.has_digit(c("last_name")),
        "years at company exceed working years": c("years_at_company") > c("total_working_years"),
        "years in role exceed years at company": c("years_in_current_role") > c("years_at_company"),
        "too many working years for the age": c("age") - 16 < c("total_working_years"),
        "younger than 18": c("age") < 18,
        "income is not positive": c("monthly_income") <= 0,
    }


def project_rules() -> dict[str, Column]:
    return {
        "project name is empty": _blank("project_name"),
        "end date before start date": F.col("end_date") < F.col("start_date"),
    }


def assignment_rules() -> dict[str, Column]:
    ratio = F.col("allocation_ratio")
    return {
        "allocation outside 1 to 100": (ratio <= 0) | (ratio > 100),
        "end date before assigned date": F.col("end_date") < F.col("assigned_date"),
        "role is empty": _blank("role_on_project"),
    }


def review_rules() -> dict[str, Column]:
    return {"rating outside 1 to 5": ~F.col("performance_rating").between(1, 5)}


def broken(rules: dict[str, Column]) -> Column:
    """The names of the broken rules, in order; a rule that cannot be decided is not broken."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def check_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add broken_rules and first_broken (NULL for a good row)."""
    return df.withColumn("broken_rules", broken(rules)).withColumn("first_broken", F.get("broken_rules", F.lit(0)))


def split_rows(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with first_broken)."""
    checked = check_rows(df, rules)
    good = checked.filter(F.col("first_broken").isNull()).drop("broken_rules", "first_broken")
    return good, checked.filter(F.col("first_broken").isNotNull()).drop("broken_rules")
