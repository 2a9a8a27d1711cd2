"""Reports on the star schema and the current-state tables.

Facts are summed per key before they are joined to a dimension, so a version, day or project with
very many facts is one row in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import pay, text
from rosterlake.operators.ordering import ranked, top_by_dense_rank
from rosterlake.operators.skew import lookup_join, skew_join, with_group_values

# The two status labels of a version.
CURRENT_LABEL = "✅ Current"
HISTORY_LABEL = "📜 History"


def rating_totals(fact: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of ratings that can be added up further."""
    return fact.groupBy(*keys).agg(
        F.count("*").alias("reviews"),
        F.count("performance_rating").alias("rated"),
        F.sum("performance_rating").alias("rating_sum"),
    )


def _mean_rating() -> Column:
    return F.sum("rating_sum") / F.nullif(F.sum("rated"), F.lit(0))


def key_figures(
    dim_employee: DataFrame, fact: DataFrame, dim_department: DataFrame, dim_project: DataFrame
) -> DataFrame:
    """One row: employees, reviews, departments, projects, versions and the mean rating."""
    rows = F.count("*").alias("n")
    spark = fact.sparkSession
    return spark.range(1).select(
        dim_employee.filter("is_current = 1").agg(F.countDistinct("employee_id").alias("n")).scalar().alias(
            "total_employees"
        ),
        fact.agg(rows).scalar().alias("total_reviews"),
        dim_department.agg(rows).scalar().alias("departments"),
        dim_project.agg(rows).scalar().alias("projects"),
        dim_employee.agg(rows).scalar().alias("scd2_versions"),
        fact.agg(F.round(F.avg("performance_rating"), 2).alias("n")).scalar().alias("avg_rating"),
    )


def top_performers(fact: DataFrame, dim_employee: DataFrame, dim_department: DataFrame, top_n: int = 3) -> DataFrame:
    """The best-rated current versions per department, then by income, ties kept.

    Ranks go by the unrounded mean. Reviews of expired versions do not count.
    """
    people = dim_employee.filter("is_current = 1").select(
        "employee_sk", "first_name", "last_name", "job_role", "job_level", "monthly_income"
    )
    rated = rating_totals(fact, ["employee_sk", "department_sk"]).join(people, "employee_sk")
    rated = lookup_join(
        rated,
        dim_department.select("department_sk", "department_name"),
        ["department_sk"],
        spread_by=["employee_sk"],
        measure=fact,
    ).withColumn("mean_rating", F.col("rating_sum") / F.nullif(F.col("rated"), F.lit(0)))
    best = top_by_dense_rank(
        rated, ["department_name"], [("mean_rating", "desc"), ("monthly_income", "desc")], top_n, "dept_rank"
    )
    return best.select(
        text.full_name(F.col("first_name"), F.col("last_name")).alias("employee_name"),
        "department_name",
        "job_role",
        "job_level",
        "monthly_income",
        F.round("mean_rating", 2).alias("avg_rating"),
        "dept_rank",
    ).orderBy("department_name", "dept_rank", "employee_name")


def yearly_trend(fact: DataFrame, dim_date: DataFrame, dim_department: DataFrame) -> DataFrame:
    """Mean rating and reviews per year and department."""
    totals = rating_totals(fact, ["date_sk", "department_sk"])
    dated = lookup_join(totals, dim_date.select("date_sk", "year"), ["date_sk"], measure=totals)
    return yearly_trend_of(dated, dim_department)


def yearly_trend_of(sums: DataFrame, dim_department: DataFrame) -> DataFrame:
    """The same from rating sums by year and department key, or by anything finer."""
    named = lookup_join(
        sums, dim_department.select("department_sk", "department_name"), ["department_sk"], measure=sums
    )
    return (
        named.groupBy("year", "department_name")
        .agg(F.round(_mean_rating(), 3).alias("avg_rating"), F.sum("reviews").alias("reviews"))
        .orderBy("year", "department_name")
    )


def yearly_change(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Mean rating per year next to the year before; the change is taken between rounded means."""
    totals = rating_totals(fact, ["date_sk"])
    return yearly_change_of(lookup_join(totals, dim_date.select("date_sk", "year"), ["date_sk"], measure=totals))


def yearly_change_of(sums: DataFrame) -> DataFrame:
    """The same from rating sums by year, or by anything finer."""
    yearly = sums.groupBy("year").agg(
        F.sum("reviews").alias("total_reviews"), F.round(_mean_rating(), 3).alias("avg_performance")
    )
    # One row per calendar year: a single window over them is small.
    before = F.lag("avg_performance").over(Window.orderBy("year"))
    return yearly.select(
        "year",
        "total_reviews",
        "avg_performance",
        before.alias("prev_year_avg"),
        F.round(F.col("avg_performance") - before, 3).alias("performance_change"),
    ).orderBy("year")


def change_direction(changes: DataFrame) -> DataFrame:
    """The yearly change with 0 for the first year, and whether it is a gain."""
    filled = F.coalesce(F.col("performance_change"), F.lit(0.0))
    return changes.select("year", filled.alias("delta"), F.when(filled >= 0, "up").otherwise("down").alias("direction"))


def quarterly_trend(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Mean rating per quarter of the year, all years pooled."""
    totals = rating_totals(fact, ["date_sk"])
    return quarterly_trend_of(lookup_join(totals, dim_date.select("date_sk", "quarter"), ["date_sk"], measure=totals))


def quarterly_trend_of(sums: DataFrame) -> DataFrame:
    """The same from rating sums by quarter, or by anything finer."""
    return (
        sums.groupBy("quarter")
        .agg(F.round(_mean_rating(), 3).alias("avg_rating"), F.sum("reviews").alias("reviews"))
        .orderBy("quarter")
    )


def department_summary(dim_employee: DataFrame, fact: DataFrame) -> DataFrame:
    """Headcount, mean income and mean rating per department of current versions.

    Income is averaged over an employee's reviews (one row when there are none), so somebody with
    k reviews weighs k times.
    """
    totals = rating_totals(fact, ["employee_sk"])
    people = dim_employee.filter("is_current = 1").select(
        "employee_sk", "employee_id", "department_name", "monthly_income"
    )
    rows = F.coalesce(F.col("reviews"), F.lit(1))
    paid = F.when(F.col("monthly_income").isNotNull(), rows)
    return (
        people.join(totals, "employee_sk", "left")
        .groupBy("department_name")
        .agg(
            F.countDistinct("employee_id").alias("headcount"),
            F.round(F.sum(F.col("monthly_income") * rows) / F.sum(paid), 0).alias("avg_income"),
            F.round(_mean_rating(), 2).alias("avg_rating"),
        )
        .orderBy(F.desc("avg_rating"), "department_name")
    )


def _placed(employees: DataFrame, departments: DataFrame) -> DataFrame:
    return lookup_join(employees, departments, ["department_id"], spread_by=["employee_id"])


def attrition_counts(employees: DataFrame, departments: DataFrame) -> DataFrame:
    return (
        _placed(employees, departments)
        .groupBy("department_name", "attrition")
        .agg(F.count("*").alias("employee_count"))
        .orderBy("department_name", "attrition")
    )


def attrition_totals(counts: DataFrame) -> DataFrame:
    """The same counts with a total per department and one over all (NULL stands for all)."""
    return counts.rollup("department_name", "attrition").agg(F.sum("employee_count").alias("employee_count"))


def attrition_rate(employees: DataFrame, departments: DataFrame) -> DataFrame:
    left = F.sum(F.when(F.col("attrition") == "Yes", 1).otherwise(0))
    return (
        _placed(employees, departments)
        .groupBy("department_name")
        .agg(F.count("*").alias("total"), left.alias("attrited"))
        .withColumn("attrition_rate_pct", pay.percent(F.col("attrited"), F.col("total")))
        .orderBy(F.desc("attrition_rate_pct"), "department_name")
    )


def income_rows(dim_employee: DataFrame) -> DataFrame:
    return dim_employee.filter("is_current = 1").select("department_name", "job_role", "monthly_income")


def income_spread(incomes: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum per department.

    Equal incomes are counted, and the counts are summed up in order of income, over several tasks
    where a department has very many. Each distinct income then knows the places it covers, and a
    quartile lies between the incomes that cover the two places around it.
    """
    known = incomes.filter("monthly_income is not null").select("department_name", "monthly_income")
    placed = ranked(known, ["department_name"], [("monthly_income", "asc")], rank="_first")
    counted = placed.groupBy("department_name", "monthly_income", "_first").agg(F.count("*").alias("_n"))
    sized = with_group_values(counted, ["department_name"], {"_total": F.sum("_n")})
    aggregates = [F.min("monthly_income").alias("low")]
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        place = (F.col("_total") - 1) * share
        value = lambda at: F.max(F.when((F.col("_first") - 1 <= at) & (at < F.col("_first") - 1 + F.col("_n")), F.col("monthly_income")))
        part = F.max(place - F.floor(place))
        aggregates.append((value(F.floor(place)) * (1 - part) + value(F.ceil(place)) * part).alias(name))
    return sized.groupBy("department_name").agg(*aggregates, F.max("monthly_income").alias("high"))


def income_by_level(dim_employee: DataFrame) -> DataFrame:
    return (
        dim_employee.filter("is_current = 1")
        .groupBy("department_name", "job_level")
        .agg(F.round(F.avg("monthly_income"), 0).alias("avg_income"), F.count("*").alias("employee_count"))
        .orderBy("department_name", "job_level")
    )


def income_pivot(levels: DataFrame) -> DataFrame:
    """Departments by job level 1 to 5."""
    wide = levels.groupBy("department_name").pivot("job_level", [1, 2, 3, 4, 5]).agg(F.first("avg_income"))
    return wide.select("department_name", *[F.col(str(n)).alias(f"level_{n}") for n in range(1, 6)])


def top_earners(employees: DataFrame, departments: DataFrame, job_roles: DataFrame, n: int = 20) -> DataFrame:
    """The n highest incomes; equal ones go by employee id.

    The lookups come first, because an employee without a department or role is not listed.
    """
    placed = employees.select("employee_id", "first_name", "last_name", "monthly_income", "department_id", "job_role_id")
    known = lookup_join(placed, departments.select("department_id", "department_name"), ["department_id"])
    known = lookup_join(known, job_roles, ["job_role_id"])
    best = known.orderBy(F.desc("monthly_income"), "employee_id").limit(n)
    return best.select(
        text.full_name(F.col("first_name"), F.col("last_name")).alias("employee_name"),
        "department_name",
        "job_role_name",
        "job_level",
        "monthly_income",
    )


def headcount_growth(dim_employee: DataFrame) -> DataFrame:
    """New employees per year of their earliest version."""
    return (
        dim_employee.groupBy("employee_id")
        .agg(F.min("effective_start_date").alias("min_start"))
        .groupBy(F.year("min_start").alias("hire_year"))
        .agg(F.count("*").alias("new_employees"))
        .orderBy("hire_year")
    )


def project_load(projects: DataFrame, departments: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments and allocation per project, projects without any included."""
    load = assignments.groupBy("project_id").agg(
        F.count("*").alias("assigned"),
        F.count("allocation_ratio").alias("with_ratio"),
        F.sum("allocation_ratio").alias("ratio_sum"),
    )
    named = lookup_join(projects, departments, ["department_id"], "left", spread_by=["project_id"])
    total = F.coalesce(F.col("ratio_sum").cast("double"), F.lit(0.0))
    mean = F.coalesce(F.col("ratio_sum").cast("double") / F.nullif(F.col("with_ratio"), F.lit(0)), F.lit(0.0))
    return (
        named.join(load, "project_id", "left")
        .select(
            "project_name",
            F.coalesce("department_name", F.lit("Unknown")).alias("department_name"),
            "status",
            F.coalesce("assigned", F.lit(0)).alias("assigned_employees"),
            F.round(mean, 2).alias("avg_allocation_pct"),
            F.round(total, 2).alias("total_allocation_pct"),
        )
        .orderBy(F.desc("assigned_employees"), F.desc("total_allocation_pct"), "project_name")
    )


def version_rows(dim_employee: DataFrame) -> DataFrame:
    """Versions as listed for a reader, with a status label."""
    return dim_employee.select(
        "employee_sk",
        text.full_name(F.col("first_name"), F.col("last_name")).alias("name"),
        "department_name",
        "job_role",
        "job_level",
        "monthly_income",
        "change_reason",
        "effective_start_date",
        "effective_end_date",
        F.when(F.col("is_current") == 1, CURRENT_LABEL).otherwise(HISTORY_LABEL).alias("status"),
    )


def version_history(dim_employee: DataFrame, employee_id: int) -> DataFrame:
    """All versions of one employee, oldest first."""
    return version_rows(dim_employee.filter(F.col("employee_id") == employee_id)).orderBy(
        "effective_start_date", "employee_sk"
    )


def income_journeys(dim_employee: DataFrame) -> DataFrame:
    """Income over time of every employee with more than one version."""
    several = dim_employee.groupBy("employee_id").count().filter("count > 1").select("employee_id")
    return skew_join(dim_employee, several, ["employee_id"], "left_semi", spread_by=["employee_sk"]).select(
        "employee_id",
        text.full_name(F.col("first_name"), F.col("last_name")).alias("name"),
        "effective_start_date",
        "monthly_income",
    )


# Listings of the current-state tables.


def employee_listing(employees: DataFrame, departments: DataFrame, job_roles: DataFrame) -> DataFrame:
    roles = job_roles.select("job_role_id", "job_role_name", "job_level")
    return lookup_join(_placed(employees, departments), roles, ["job_role_id"], spread_by=["employee_id"])


def find_employee(
    employees: DataFrame, departments: DataFrame, job_roles: DataFrame, employee_id: int
) -> DataFrame:
    """One employee with department and role, or no row."""
    return employee_listing(employees.filter(F.col("employee_id") == employee_id), departments, job_roles).limit(1)


def newest_employees(
    employees: DataFrame, departments: DataFrame, job_roles: DataFrame, limit: int = 50
) -> DataFrame:
    return (
        employee_listing(employees, departments, job_roles)
        .select(
            *(
                "employee_id first_name last_name email age attrition years_at_company monthly_income "
                "department_name job_role_name job_level"
            ).split()
        )
        .orderBy(F.desc("employee_id"))
        .limit(limit)
    )


def employee_choices(
    employees: DataFrame, departments: DataFrame, job_roles: DataFrame, limit: int = 500
) -> DataFrame:
    return (
        employee_listing(employees, departments, job_roles)
        .orderBy("first_name", "last_name", "employee_id")
        .limit(limit)
        .select(
            "employee_id",
            text.full_name(F.col("first_name"), F.col("last_name")).alias("name"),
            "department_name",
            "job_role_name",
        )
    )


def search_employees(
    employees: DataFrame, departments: DataFrame, job_roles: DataFrame, fragment: str, limit: int = 30
) -> DataFrame:
    """Employees whose full name contains the fragment, upper and lower case alike."""
    name = text.full_name(F.col("first_name"), F.col("last_name"))
    found = employees.filter(text.contains_fragment(name, fragment))
    return (
        employee_listing(found, departments, job_roles)
        .orderBy("first_name", "last_name", "employee_id")
        .limit(limit)
        .select(
            "employee_id",
            name.alias("name"),
            *"email age attrition department_name job_role_name job_level monthly_income".split(),
        )
    )


def project_listing(projects: DataFrame, departments: DataFrame) -> DataFrame:
    return (
        lookup_join(projects, departments, ["department_id"], spread_by=["project_id"])
        .select("project_id", "project_name", "department_name", "status", "start_date", "end_date")
        .orderBy(F.desc("project_id"))
    )


def assignment_listing(assignments: DataFrame, employees: DataFrame, projects: DataFrame) -> DataFrame:
    people = employees.select(
        "employee_id", text.full_name(F.col("first_name"), F.col("last_name")).alias("employee_name")
    )
    rows = skew_join(assignments, people, ["employee_id"], spread_by=["assignment_id"])
    rows = skew_join(
        rows,
        projects.select("project_id", "project_name"),
        ["project_id"],
        spread_by=["assignment_id"],
        measure=assignments,
    )
    return rows.select(
        *"assignment_id employee_name project_name role_on_project allocation_ratio assigned_date end_date".split()
    ).orderBy(F.desc("assignment_id"))


def reviews_of(reviews: DataFrame, employee_id: int) -> DataFrame:
    return reviews.filter(F.col("employee_id") == employee_id).orderBy(F.desc("review_date"), F.desc("review_id"))
