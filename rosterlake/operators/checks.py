"""Data-quality checks. Each returns the offending rows; none means passed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake import schemas as S
from rosterlake.functions.text import not_blank
from rosterlake.operators.intervals import match_valid
from rosterlake.operators.skew import lookup_join, skew_join


def missing_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if f.name not in df.columns]


def require_columns(df: DataFrame, schema: T.StructType) -> None:
    missing = missing_columns(df, schema)
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))


def require_order(df: DataFrame, schema: T.StructType) -> None:
    if df.columns != schema.names:
        raise ValueError("columns differ from the declared ones or their order")


def version_counts(versions: DataFrame) -> DataFrame:
    """Total, current and historical versions, entities and distinct keys, in one row."""
    return versions.agg(
        F.count("*").alias("total"),
        F.sum(F.when(F.col("is_current") == 1, 1).otherwise(0)).alias("current"),
        F.sum(F.when(F.col("is_current") == 0, 1).otherwise(0)).alias("historical"),
        F.countDistinct("employee_id").alias("employees"),
        F.countDistinct("employee_sk").alias("keys"),
    )


def count_mismatches(versions: DataFrame, expected: dict[str, int]) -> DataFrame:
    """The expected counts that the table does not meet."""
    facts = F.array(
        *[
            F.struct(F.lit(k).alias("measure"), F.lit(v).cast("long").alias("expected"), F.col(k).alias("found"))
            for k, v in expected.items()
        ]
    )
    return version_counts(versions).select(F.explode(facts).alias("r")).select("r.*").filter("found <> expected")


def not_one_current(versions: DataFrame) -> DataFrame:
    return (
        versions.groupBy("employee_id")
        .agg(F.count("*").alias("total_versions"), F.sum("is_current").alias("current_versions"))
        .filter("current_versions <> 1")
    )


def bad_validity(versions: DataFrame, open_end: dt.date = S.OPEN_END) -> DataFrame:
    """Start after end, a current version that ends, or history without a reason; with the issue."""
    current = F.col("is_current") == 1
    issues = F.array_compact(
        F.array(
            F.when(F.col("effective_start_date") > F.col("effective_end_date"), F.lit("start after end")),
            F.when(current & (F.col("effective_end_date") != F.lit(open_end)), F.lit("current version ends")),
            F.when(
                (F.col("is_current") == 0) & ~F.coalesce(not_blank(F.col("change_reason")), F.lit(False)),
                F.lit("history without reason"),
            ),
        )
    )
    return versions.select("employee_id", "employee_sk", F.explode(issues).alias("issue"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Values of a key that occur more than once; NULLs do not count."""
    present = df
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def version_histogram(versions: DataFrame) -> DataFrame:
    """How many employees have one, two, … versions."""
    return (
        versions.groupBy("employee_id")
        .agg(F.count("*").alias("version_count"))
        .groupBy("version_count")
        .agg(F.count("*").alias("employee_count"))
    )


def schema_violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns with NULLs where none may be, or texts longer than declared; with the row count.

    All columns are counted in one pass over the table.
    """
    tests = []
    for f in schema.fields:
        if not f.nullable:
            tests.append((f.name, "null", F.col(f.name).isNull()))
        if "length" in f.metadata:
            tests.append((f.name, "too long", F.length(f.name) > f.metadata["length"]))
    counts = df.agg(*[F.count_if(bad).alias(f"_c{i}") for i, (_, _, bad) in enumerate(tests)])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("violation"), F.col(f"_c{i}").alias("n_rows"))
            for i, (c, k, _) in enumerate(tests)
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*").filter("n_rows > 0")


def type_violations(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Values that cannot be read as the declared type; with the row count per column."""
    checked = [f for f in schema.fields if f.name in df.columns]
    counts = df.agg(
        *[
            F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f"_c{i}")
            for i, f in enumerate(checked)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(f.name).alias("column_name"), F.col(f"_c{i}").alias("n_rows"))
            for i, f in enumerate(checked)
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*").filter("n_rows > 0")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """The child's key values that the parent lacks, with their number of rows.

    Values are counted before the join, so a hot value is one row in it.
    """
    used = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key_value")).agg(
        F.count("*").alias("n_rows")
    )
    return used.join(parent.select(F.col(parent_column).alias("key_value")), "key_value", "left_anti")


def all_orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """Orphan rows of every declared foreign key between the given tables."""
    out = None
    for fk in S.FOREIGN_KEYS:
        if fk.table in tables and fk.target in tables:
            rows = orphans(tables[fk.table], fk.column, tables[fk.target], fk.target_column).agg(
                F.count("*").alias("missing_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")
            )
            line = rows.select(
                F.lit(fk.table).alias("table_name"), F.lit(fk.column).alias("column_name"), "missing_keys", "n_rows"
            )
            out = line if out is None else out.unionByName(line)
    return out


def facts_outside_version(fact: DataFrame, dim_employee: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Fact rows whose day is not inside the validity of their employee version.

    Days are looked up per (version, day), so a version with many facts is one row per day.
    """
    pairs = fact.select("employee_sk", "date_sk").distinct()
    dated = lookup_join(pairs, dim_date.select("date_sk", "full_date"), ["date_sk"])
    versions = dim_employee.select("employee_sk", "effective_start_date", "effective_end_date")
    outside = dated.join(versions, "employee_sk").filter(
        ~F.col("full_date").between(F.col("effective_start_date"), F.col("effective_end_date"))
    )
    return skew_join(
        fact.select("review_sk", "employee_sk", "date_sk"), outside, ["employee_sk", "date_sk"], spread_by=["review_sk"]
    )


def version_check(fact: DataFrame, dim_employee: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Facts of current and of expired versions, and how many of each lie outside their version's days."""
    counted = fact.groupBy("employee_sk", "date_sk").agg(F.count("*").alias("n"))
    dated = lookup_join(counted, dim_date.select("date_sk", "full_date"), ["date_sk"])
    versions = dim_employee.select("employee_sk", "is_current", "effective_start_date", "effective_end_date")
    outside = ~F.col("full_date").between(F.col("effective_start_date"), F.col("effective_end_date"))
    return dated.join(versions, "employee_sk").groupBy("is_current").agg(
        F.sum("n").alias("facts"), F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outside")
    )


def dropped_reviews(
    reviews: DataFrame, dim_employee: DataFrame, dim_department: DataFrame, dim_date: DataFrame
) -> DataFrame:
    """Reviews that the fact load drops, with the first cause."""
    versions = dim_employee.select("employee_id", "department_name", "effective_start_date", "effective_end_date")
    known = dim_department.select("department_name", F.lit(True).alias("has_department"))
    found = match_valid(
        reviews.select("review_id", "employee_id", "review_date"),
        lookup_join(versions, known, ["department_name"], "left"),
        "employee_id",
        "review_date",
        how="left",
        spread_by=["review_id"],
        measure=reviews,
    )
    dates = dim_date.select(F.col("full_date").alias("review_date"), F.lit(True).alias("has_date"))
    dated = lookup_join(found, dates, ["review_date"], "left", measure=reviews, spread_by=["review_id"])
    cause = (
        F.when(F.col("effective_start_date").isNull(), "no version")
        .when(F.col("has_department").isNull(), "no department")
        .when(F.col("has_date").isNull(), "no date")
    )
    return dated.select("review_id", "employee_id", "review_date", cause.alias("cause")).filter("cause is not null")


def drift(employees: DataFrame, history: DataFrame) -> DataFrame:
    """Employees whose current-state row differs from their current version."""
    now = history.filter("is_current = 1").select(
        "employee_id",
        *[F.col(c).alias(f"version_{c}") for c in ("department_id", "job_role_id", "monthly_income")],
    )
    compared = employees.select("employee_id", "department_id", "job_role_id", "monthly_income").join(
        now, "employee_id"
    )
    return compared.filter(
        ~F.col("department_id").eqNullSafe(F.col("version_department_id"))
        | ~F.col("job_role_id").eqNullSafe(F.col("version_job_role_id"))
        | ~F.col("monthly_income").eqNullSafe(F.col("version_monthly_income"))
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, with a status."""
    out = None
    for name, df in tables.items():
        line = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.when(F.col("row_count") > 0, "loaded").otherwise("empty").alias("status"),
        )
        out = line if out is None else out.unionByName(line)
    return out
