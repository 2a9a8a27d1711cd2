"""What happens to one micro-batch of each stream. Pass the result to run_available."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.operators.numbering import number_rows
from rosterlake.operators.ordering import latest
from rosterlake.operators.skew import lookup_join, skew_join
from rosterlake.operators.versions import (
    apply_to_dimension,
    apply_to_employees,
    apply_to_history,
    judge_changes,
    of_employees,
)
from rosterlake.plans import oltp
from rosterlake.session import written
from rosterlake.streaming.changing import ChangingTable
from rosterlake.streaming.tables import BatchTable

Batch = Callable[[DataFrame, int], None]


def _now(table: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """A dimension as it is when a batch runs: a function is asked anew each time."""
    return table() if callable(table) else table


def _once_only(batch: DataFrame, once: bool) -> DataFrame:
    """The batch of a stream with state, written: every action on it would run the steps with state anew."""
    return written(batch, "stateful-batch") if once else batch


def new_projects(dim_project: BatchTable, *, once: bool = False) -> Batch:
    """Every project not yet in the dimension goes into it under the next keys.

    With once the stream has dropped its repeats (waiting.first_requests), and no stored row is read.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        new = _once_only(batch, once).select(*S.PROJECTS.names)
        if not once:
            new = new.dropDuplicates(["project_id"])
            new = new.join(dim_project.rows(batch_id).select("project_id"), "project_id", "left_anti")
        keyed = number_rows(new, ["project_id"], "project_sk", dim_project.next_key("project_sk", batch_id))
        dim_project.write(S.shaped(keyed, S.DIM_PROJECT), batch_id, "project_sk")

    return process


def new_assignments(
    dim_assignment: BatchTable,
    dim_employee: DataFrame | Callable[[], DataFrame],
    dim_project: DataFrame | Callable[[], DataFrame],
    rejected: BatchTable | None = None,
    *,
    once: bool = False,
) -> Batch:
    """A new assignment gets the employee's present version and the project's latest key.

    Unlike the batch load, which takes the version of the assigned date. Dimensions given as
    functions are read for every batch. An assignment whose employee or project is unknown goes to
    the rejects with the reason; one that is stored already is passed over. With once the stream has
    dropped its repeats (waiting.first_requests), and no stored assignment is read. Columns
    employee_known and project_known, as made by waiting.await_parent, decide what is unknown if
    they are there: NULL means that the parent never came.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = _once_only(batch, once)
        present = latest(
            _now(dim_employee).filter("is_current = 1").select("employee_id", "employee_sk"), ["employee_id"], ["employee_sk"]
        )
        projects = latest(_now(dim_project).select("project_id", "project_sk"), ["project_id"], ["project_sk"])
        new = batch
        if not once:
            stored = dim_assignment.rows(batch_id).select("assignment_id")
            new = batch.dropDuplicates(["assignment_id"]).join(stored, "assignment_id", "left_anti")
        rows = skew_join(new, present, ["employee_id"], "left", spread_by=["assignment_id"])
        rows = skew_join(rows, projects, ["project_id"], "left", spread_by=["assignment_id"], measure=batch)
        unknown = {
            parent: F.col(f"{parent}_sk").isNull() | (~F.col(mark) if mark in batch.columns else F.lit(False))
            for parent, mark in (("employee", "employee_known"), ("project", "project_known"))
        }
        reason = F.when(unknown["employee"], "unknown employee").when(unknown["project"], "unknown project")
        rows = written(rows.withColumn("reject_reason", reason), "judged")
        good = rows.filter("reject_reason is null")
        keyed = number_rows(good, ["assignment_id"], "assignment_sk", dim_assignment.next_key("assignment_sk", batch_id))
        dim_assignment.write(S.shaped(keyed, S.DIM_ASSIGNMENT), batch_id, "assignment_sk")
        if rejected is not None:
            asked = [c for c in batch.columns if c not in ("employee_known", "project_known")]
            rejected.write(rows.filter("reject_reason is not null").select(*asked, "reject_reason"), batch_id)

    return process


def attribute_changes(
    history: BatchTable,
    rejected: BatchTable,
    departments: DataFrame,
    job_roles: DataFrame,
    dim_employee: BatchTable | None = None,
    employees: BatchTable | None = None,
) -> Batch:
    """Change requests become versions in the history and in the employee dimension, and move employees.

    Only the employees in the batch are looked at, and only their rows are added to a table's
    folders. The tables are read with history.newest("employee_sk"), dim_employee.newest("employee_sk")
    and employees.newest("employee_id").
    """

    def affected_rows(table: BatchTable, batch: DataFrame, batch_id: int, key: str) -> DataFrame:
        return latest(of_employees(table.read(batch_id), batch), [key], ["batch_id"]).drop("batch_id")

    def process(batch: DataFrame, batch_id: int) -> None:
        affected = affected_rows(history, batch, batch_id, "employee_sk")
        judged = judge_changes(batch, affected, departments, job_roles)
        applied = apply_to_history(affected, judged.accepted, keys_from=history.read(batch_id))
        history.write(applied.touched, batch_id)
        if dim_employee is not None:
            rows = affected_rows(dim_employee, batch, batch_id, "employee_sk")
            dim_employee.write(apply_to_dimension(rows, judged.accepted, applied.added), batch_id)
        if employees is not None:
            rows = affected_rows(employees, batch, batch_id, "employee_id")
            employees.write(apply_to_employees(rows, judged.accepted), batch_id)
        rejected.write(judged.rejected, batch_id)

    return process


def attribute_changes_in_parts(
    history: ChangingTable,
    dim_employee: ChangingTable,
    employees: ChangingTable,
    rejected: BatchTable,
    departments: DataFrame,
    job_roles: DataFrame,
) -> Batch:
    """attribute_changes for tables in parts by employee, of which a batch reads and rewrites those of its employees.

    history hands out employee_sk and job_history_id, and its mark says that all three tables are staged.
    An employee without a row, a change that comes late and a batch that changes nothing are treated as there.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = written(batch, "change-batch")
        if not history.is_staged(batch_id):
            versions = of_employees(history.touched(batch), batch)
            judged = judge_changes(batch, versions, departments, job_roles)
            applied = apply_to_history(versions, judged.accepted, keys_from=history.highest(batch_id))
            dimension = of_employees(dim_employee.touched(batch), batch)
            moved = lookup_join(employees.touched(batch), batch.select("employee_id").distinct(), ["employee_id"], "left_semi")
            rejected.write(judged.rejected, batch_id)
            employees.stage(batch, apply_to_employees(moved, judged.accepted), batch_id)
            dim_employee.stage(batch, apply_to_dimension(dimension, judged.accepted, applied.added), batch_id)
            history.stage(batch, applied.touched, batch_id)
        for table in (employees, dim_employee, history):
            table.put_in_place()

    return process


def new_hires(
    employees: BatchTable,
    history: BatchTable,
    dim_employee: BatchTable,
    rejected: BatchTable,
    departments: DataFrame,
    job_roles: DataFrame,
    as_of: dt.date,
) -> Batch:
    """Hire requests: acceptable ones go into the three tables, the others to the rejects."""

    def process(batch: DataFrame, batch_id: int) -> None:
        stored = employees.rows(batch_id)
        done = oltp.onboard(batch, history.rows(batch_id), departments, job_roles, as_of, stored)
        known = stored.select("employee_id")
        for table, rows in ((employees, done.employees), (history, done.history), (dim_employee, done.dim_employee)):
            table.write(rows.join(known, "employee_id", "left_anti"), batch_id)
        rejected.write(done.rejected, batch_id)

    return process


def new_reviews(reviews: BatchTable, *, once: bool = False) -> Batch:
    """Review requests get the next keys. Where the table stores request_seq, a request counts once.

    With once the stream has dropped its repeats (waiting.first_requests), and no stored row is read.
    """
    keep = ("request_seq",) if "request_seq" in reviews.schema.names else ()

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = _once_only(batch, once)
        if keep and not once:
            stored = reviews.rows(batch_id).select("request_seq")
            batch = batch.dropDuplicates(["request_seq"]).join(stored, "request_seq", "left_anti")
        added, _ = oltp.submit_reviews(batch, reviews.next_key("review_id", batch_id), keep=keep)
        reviews.write(added, batch_id, "review_id")

    return process


def late_or_unknown(rejected: BatchTable) -> DataFrame:
    """Rejected changes per reason."""
    return rejected.rows().groupBy("reject_reason").agg(F.count("*").alias("n_rows"))
