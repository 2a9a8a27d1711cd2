"""Structured Streaming jobs, run over everything that is there; the result is the written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.plans.warehouse import Warehouse
from rosterlake.registry.core import REGISTRY, add
from rosterlake.registry.loads import AS_OF
from rosterlake.session import new_path
from rosterlake.streaming import sync, waiting
from rosterlake.streaming.changing import ChangingTable, table_parts
from rosterlake.streaming.tables import START, BatchTable, run_available, state_parts


def _stream(w: Warehouse, name: str) -> DataFrame:
    return w.spark.readStream.schema(w[name].schema).parquet(w.path(name))


def _table(w: Warehouse, name: str, schema) -> BatchTable:
    return BatchTable(w.spark, new_path(w.spark, f"stream-{name}"), schema)


def _run(w: Warehouse, name: str, process) -> None:
    run_available(_stream(w, name), process, new_path(w.spark, f"progress-{name}"))


NOBODY = -1


def _in_parts(w: Warehouse, streams: dict[str, DataFrame], time: str, run, parts: int = 3) -> None:
    """Let the rows of several tables arrive in parts, in order of time, and run the job after each.

    Each table is a stream that starts empty. A last part closes the books: its only row, with the
    number NOBODY, moves the watermark past all that still waits. The job has to leave it out after the
    stateful steps, for a filter before them would be pushed below the watermark. run gets the streams and
    the number of parts for their state, by the rows of the largest of them.
    """
    paths = {n: new_path(w.spark, f"incoming-{n}") for n in streams}
    bounds = [df.agg(F.min(time), F.max(time), F.count(F.lit(1))).first() for df in streams.values()]
    state = state_parts(w.spark, max(b[2] for b in bounds))
    low, high = min(b[0] for b in bounds if b[0]), max(b[1] for b in bounds if b[1])
    cuts = [low + (high - low) * i / parts for i in range(1, parts)]
    which = sum((F.when(F.col(time) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    opened = {n: w.spark.readStream.schema(df.schema).parquet(paths[n]) for n, df in streams.items() if not df.limit(0).write.parquet(paths[n])}
    for part in range(parts + 1):
        for n, df in streams.items():
            closing = {f.name: F.lit(NOBODY if isinstance(f.dataType, S.T.LongType) else None).cast(f.dataType) for f in df.schema}
            closing[time] = F.lit(high) + F.expr("interval 100 years")
            rows = df.filter(which == part) if part < parts else w.spark.range(1).select(*[v.alias(c) for c, v in closing.items()])
            rows.write.mode("append").parquet(paths[n])
        run(opened, state)


def _at(day: str):
    return F.col(day).cast("timestamp")


def _projects(w: Warehouse) -> DataFrame:
    out = _table(w, "dim_project", S.DIM_PROJECT)
    _run(w, "projects", sync.new_projects(out))
    return out.rows()


add("m1_new_projects", _projects, "select * from dim_project")


def _projects_once(w: Warehouse) -> DataFrame:
    """Each project is announced three times; the repeats are dropped by the stream's state."""
    out, progress = _table(w, "dim_project", S.DIM_PROJECT), new_path(w.spark, "progress-projects")
    # Announced on its start, or the first of its kind's days where it has none, and on the next two days.
    first = F.coalesce(_at("start_date"), F.lit("2020-01-01").cast("timestamp"))
    times = F.explode(F.array(*[first + F.expr(f"interval {n} days") for n in range(3)]))
    given = w["projects"].withColumn("requested_at", times)

    def run(opened: dict[str, DataFrame], state: int) -> None:
        once = waiting.first_requests(opened["projects"], ["project_id"], "requested_at", "30 days")
        process = sync.new_projects(out, once=True)
        run_available(once, lambda batch, i: process(batch.filter(F.col("project_id") != NOBODY), i), progress, state)

    _in_parts(w, {"projects": given}, "requested_at", run)
    return out.rows().drop("project_sk")


add("m1_projects_once", _projects_once, "select * exclude (project_sk) from dim_project")


def _assignments(w: Warehouse) -> DataFrame:
    out = _table(w, "dim_assignment", S.DIM_ASSIGNMENT)
    _run(w, "assignments", sync.new_assignments(out, lambda: w["dim_employee"], lambda: w["dim_project"]))
    return out.rows()


add(
    "m2_new_assignments",
    _assignments,
    """select row_number() over (order by a.assignment_id) as assignment_sk, a.assignment_id, de.employee_sk, dp.project_sk, a.role_on_project, a.allocation_ratio, a.assigned_date, a.end_date
    from assignments a join dim_employee de on de.employee_id = a.employee_id and de.is_current = 1
    join dim_project dp on dp.project_id = a.project_id""",
)


#: How long an assignment waits for its employee and its project, and how late a parent of each kind comes.
WAIT_DAYS, EMPLOYEE_LATE, PROJECT_LATE = 250, 100, 140


def _early_assignments(w: Warehouse) -> DataFrame:
    """Assignments that come before their employee or project wait for it; who waits in vain is rejected.

    Parents come some time after their first assignment, depending on their number.
    """
    spark = w.spark
    out = _table(w, "dim_assignment", S.DIM_ASSIGNMENT)
    rejected = _table(w, "rejected", S.T.StructType([*S.ASSIGNMENTS.fields, S.T.StructField("reject_reason", S.T.StringType())]))
    given = w["assignments"]

    def late(key: str, dimension: str, days: int, kinds: int) -> DataFrame:
        known = w[dimension].select(key).distinct()
        first = given.groupBy(key).agg(F.min("assigned_date").alias("first")).join(known, key, "left_semi")
        return first.select(key, F.date_add("first", (F.col(key) % kinds * days).cast("int")).cast("timestamp").alias("arrived_at"))

    streams = {
        "assignments": given.withColumn("arrived_at", _at("assigned_date")),
        "employees": late("employee_id", "dim_employee", EMPLOYEE_LATE, 5),
        "projects": late("project_id", "dim_project", PROJECT_LATE, 3),
    }
    progress = new_path(spark, "progress-early-assignments")

    def run(opened: dict[str, DataFrame], state: int) -> None:
        rows = waiting.first_requests(opened["assignments"], ["assignment_id"], "arrived_at", "1 day")
        for parent, key in (("employee", "employee_id"), ("project", "project_id")):
            known = waiting.arrivals(opened[f"{parent}s"], key, "arrived_at", "1 day")
            rows = waiting.await_parent(rows, known, key, "arrived_at", "arrived_at", f"{WAIT_DAYS} days", f"{parent}_known")
        process = sync.new_assignments(out, lambda: w["dim_employee"], lambda: w["dim_project"], rejected, once=True)
        run_available(rows, lambda batch, i: process(batch.filter(F.col("assignment_id") != NOBODY).drop("arrived_at"), i), progress, state)

    _in_parts(w, streams, "arrived_at", run, parts=2)
    good = out.rows().select("assignment_id", "employee_sk", "project_sk", F.lit(None).cast("string").alias("reject_reason"))
    none = F.lit(None).cast("long")
    return good.unionByName(rejected.rows().select("assignment_id", none.alias("employee_sk"), none.alias("project_sk"), "reject_reason"))


add(
    "m2_early_assignments",
    _early_assignments,
    f"""with e as (select employee_id, min(assigned_date) + cast(employee_id % 5 * {EMPLOYEE_LATE} as integer) as known from assignments group by employee_id),
    p as (select project_id, min(assigned_date) + cast(project_id % 3 * {PROJECT_LATE} as integer) as known from assignments group by project_id),
    j as (select a.assignment_id, de.employee_sk, dp.project_sk,
     case when de.employee_sk is null or e.known > a.assigned_date + {WAIT_DAYS} then 'unknown employee'
      when dp.project_sk is null or p.known > a.assigned_date + {WAIT_DAYS} then 'unknown project' end as reject_reason
     from assignments a join e using (employee_id) join p using (project_id)
     left join dim_employee de on de.employee_id = a.employee_id and de.is_current = 1
     left join dim_project dp on dp.project_id = a.project_id)
    select assignment_id, case when reject_reason is null then employee_sk end as employee_sk,
     case when reject_reason is null then project_sk end as project_sk, reject_reason from j""",
)


def _changes(w: Warehouse, wanted: str = "history") -> DataFrame:
    history = _table(w, "history", S.JOB_HISTORY)
    rejected = _table(w, "rejected", S.T.StructType([*w["changes"].schema.fields, S.T.StructField("reject_reason", S.T.StringType())]))
    history.write(w["employee_job_history"], START)
    dim, employees = _table(w, "dim_employee", S.DIM_EMPLOYEE), _table(w, "employees", S.EMPLOYEES)
    dim.write(w["dim_employee"], START)
    employees.write(w["employees"], START)
    _run(w, "changes", sync.attribute_changes(history, rejected, w["departments"], w["job_roles"], dim, employees))
    return {"history": history, "dimension": dim}[wanted].newest("employee_sk") if wanted != "employees" else employees.newest("employee_id")


add("m3_attribute_changes", _changes, "select * from changed_history")
add("m3_changed_dimension", lambda w: _changes(w, "dimension"), REGISTRY["j16_changes_dimension"].sql)
add(
    "m3_changed_employees",
    lambda w: _changes(w, "employees").select("employee_id", "department_id", "job_role_id", "monthly_income"),
    REGISTRY["j16_changes_employees"].sql,
)


def _changes_in_parts(w: Warehouse, wanted: str) -> DataFrame:
    """The changes of each third of the time arrive together; three tables in parts are changed in place."""
    changes = w["changes"]
    keys = {"history": ("employee_sk", "job_history_id")}
    given = {"history": "employee_job_history", "dim_employee": "dim_employee", "employees": "employees"}
    row_key = {"history": "employee_sk", "dim_employee": "employee_sk", "employees": "employee_id"}
    tables = {n: ChangingTable(w.spark, new_path(w.spark, f"changing-{n}"), w[g].schema, row_key[n], numbered=keys.get(n, ()), parts=table_parts(w.figures(g).first()["row_count"])) for n, g in given.items()}
    for n, table in tables.items():
        table.create(w[given[n]])
    rejected = _table(w, "rejected", S.T.StructType([*changes.schema.fields, S.T.StructField("reject_reason", S.T.StringType())]))
    process = sync.attribute_changes_in_parts(*tables.values(), rejected, w["departments"], w["job_roles"])
    path, progress = new_path(w.spark, "incoming-changes"), new_path(w.spark, "progress-changes")
    low, high = changes.agg(F.min("change_date"), F.max("change_date")).first()
    third = F.least(F.lit(2), F.floor(F.datediff("change_date", F.lit(low)) * 3 / (F.datediff(F.lit(high), F.lit(low)) + 1)))
    for n in range(3):
        changes.filter(F.coalesce(third, F.lit(0)) == n).write.mode("append").parquet(path)
        run_available(w.spark.readStream.schema(changes.schema).parquet(path), process, progress)
    return tables[wanted].rows()


# Keys are handed out batch by batch, so only the others can be compared with those of one batch.
add(
    "m3_history_in_parts",
    lambda w: _changes_in_parts(w, "history").drop("employee_sk", "job_history_id"),
    "select * exclude (employee_sk, job_history_id) from changed_history",
)
add(
    "m3_dimension_in_parts",
    lambda w: _changes_in_parts(w, "dim_employee").drop("employee_sk"),
    f"select * exclude (employee_sk) from ({REGISTRY['j16_changes_dimension'].sql}) d",
)


def _hires(w: Warehouse) -> DataFrame:
    hires = w["hires"].schema
    rejected = _table(w, "rejected", S.T.StructType([*hires.fields, S.T.StructField("first_broken", S.T.StringType())]))
    employees = _table(w, "employees", S.EMPLOYEES)
    history, dim = _table(w, "history", S.JOB_HISTORY), _table(w, "dim_employee", S.DIM_EMPLOYEE)
    history.write(w["employee_job_history"], START)
    _run(w, "hires", sync.new_hires(employees, history, dim, rejected, w["departments"], w["job_roles"], AS_OF))
    return dim.rows()


add("m4_new_hires", _hires, "select * from onboarded")


def _reviews_once(w: Warehouse) -> DataFrame:
    """Review requests, each sent twice within a day; the second is dropped by the stream's state."""
    stored = S.T.StructType([*S.REVIEWS.fields, S.T.StructField("request_seq", S.T.LongType())])
    out, progress = _table(w, "reviews", stored), new_path(w.spark, "progress-reviews")
    out.write(w["reviews"].withColumn("request_seq", F.lit(None).cast("long")), START, "review_id")
    sent = F.explode(F.array(*[_at("review_date") + F.expr(f"interval {n} hours") for n in (0, 20)]))
    given = w["review_requests"].withColumn("sent_at", sent)

    def run(opened: dict[str, DataFrame], state: int) -> None:
        once = waiting.first_requests(opened["requests"], ["request_seq"], "sent_at", "7 days")
        process = sync.new_reviews(out, once=True)
        run_available(once, lambda batch, i: process(batch.filter(F.col("request_seq") != NOBODY).drop("sent_at"), i), progress, state)

    _in_parts(w, {"requests": given}, "sent_at", run)
    return out.rows().select("employee_id", "reviewer_id", "review_date", "performance_rating")


add(
    "m4_reviews_once",
    _reviews_once,
    """select employee_id, reviewer_id, review_date, performance_rating from reviews
    union all select employee_id, nullif(reviewer_id, 0), review_date, performance_rating from review_requests""",
)


def _reviews(w: Warehouse) -> DataFrame:
    stored = S.T.StructType([*S.REVIEWS.fields, S.T.StructField("request_seq", S.T.LongType())])
    out = _table(w, "reviews", stored)
    out.write(w["reviews"].withColumn("request_seq", F.lit(None).cast("long")), START)
    _run(w, "review_requests", sync.new_reviews(out))
    return out.rows().select("review_id", "employee_id", "reviewer_id", "review_date", "performance_rating")


add(
    "m4_new_reviews",
    _reviews,
    """select review_id, employee_id, reviewer_id, review_date, performance_rating from reviews
    union all select (select max(review_id) from reviews) + row_number() over (order by request_seq), employee_id,
     nullif(reviewer_id, 0), review_date, performance_rating from review_requests""",
)
