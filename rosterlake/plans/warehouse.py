"""The tables of one warehouse, each built once from its inputs and then read from files."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rosterlake.operators import statistics
from rosterlake.plans import oltp, star
from rosterlake.schemas import UNIQUE_KEYS
from rosterlake.session import new_path
from rosterlake.sources import inputs


class Warehouse:
    """Builds a table when it is first asked for and keeps it in the shared folder.

    Later loads and reports read the written table, as they would in a scheduled job.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._figures: dict[str, DataFrame] = {}
        self._made: dict[str, Any] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            df, path = self.build(name), new_path(self.spark, name)
            keys = statistics.whole_number_columns(df, [k[0] for k in UNIQUE_KEYS.get(name, []) if len(k) == 1])
            self._tables[name] = statistics.write_measured(df, path, keys)
            self._figures[name] = statistics.figures(self.spark, path)
        return self._tables[name]

    def figures(self, name: str) -> DataFrame:
        """Row count and highest keys of a table, kept since it was written."""
        self[name]
        return self._figures[name]

    def once(self, name: str, make: Callable[[], Any]) -> Any:
        """What make() gives, made when it is first asked for."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def many(self, *names: str) -> list[DataFrame]:
        return [self[n] for n in names]

    def path(self, name: str) -> str:
        """The folder that a written table lies in."""
        return self[name].inputFiles()[0].rsplit("/", 1)[0]

    def base(self, name: str) -> DataFrame:
        """A given table as it is."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def build(self, name: str) -> DataFrame:
        """The load of one table over the written tables it needs."""
        if name in inputs.INPUTS:
            return inputs.derive(self.spark, self.sf_dir, name)
        loads = {
            "departments": (oltp.load_departments, ["staging_employees"]),
            "job_roles": (oltp.load_job_roles, ["staging_employees"]),
            "employees": (oltp.load_employees, ["staging_employees", "departments", "job_roles"]),
            "employee_job_history": (oltp.load_job_history, ["staging_employees", "departments", "job_roles"]),
            "dim_department": (star.load_dim_department, ["departments"]),
            "dim_project": (star.load_dim_project, ["projects"]),
            "dim_date": (star.load_dim_date, ["reviews"]),
            "dim_employee": (star.dimension_rows, ["employee_job_history", "employees", "departments", "job_roles"]),
            "dim_assignment": (star.load_dim_assignment, ["assignments", "dim_employee", "dim_project"]),
            "fact_performance_reviews": (
                star.load_fact_reviews,
                ["reviews", "dim_employee", "dim_department", "dim_date", "assignments", "dim_project"],
            ),
        }
        load, needs = loads[name]
        return load(*self.many(*needs))


_OPEN: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The warehouse over one folder of input tables, shared within a Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Warehouse(spark, sf_dir)
    return _OPEN[key]
