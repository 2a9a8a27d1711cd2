"""Streams in several micro-batches, and retried batches."""

import datetime as dt
import shutil
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake import schemas as S
from rosterlake.operators.versions import apply_to_history, judge_changes
from rosterlake.session import new_path
from rosterlake.streaming import sync, waiting
from rosterlake.streaming.tables import START, STATE_ROWS, STATE_STORE, BatchTable, run_available, state_parts


def same(a, b):
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


def table(spark, schema):
    return BatchTable(spark, new_path(spark, "test"), schema)


def files_in_order(df, spark, cuts):
    """Write the parts of df one after the other; the file source reads older files first."""
    path = new_path(spark, "incoming")
    for part in cuts:
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def rejects(schema):
    return S.T.StructType([*schema.fields, S.T.StructField("reject_reason", S.T.StringType())])


def test_changes_in_three_batches_equal_one(spark, warehouse):
    changes, history = warehouse["changes"], warehouse["employee_job_history"]
    lookups = warehouse["departments"], warehouse["job_roles"]
    cuts = ["change_date < '2024-01-09'", "change_date >= '2024-01-09' and change_date < '2024-01-20'", "change_date >= '2024-01-20'"]
    out, bad = table(spark, S.JOB_HISTORY), table(spark, rejects(changes.schema))
    out.write(history, START)
    stream = files_in_order(changes, spark, cuts)
    run_available(stream, sync.attribute_changes(out, bad, *lookups), new_path(spark, "progress"))
    assert out.read().select("batch_id").distinct().count() == 4
    judged = judge_changes(changes, history, *lookups)
    whole = apply_to_history(history, judged.accepted).history
    keys = ["employee_sk", "job_history_id"]
    same(out.newest("employee_sk").drop(*keys), whole.drop(*keys))
    assert bad.rows().count() == judged.rejected.count()
    compacted = table(spark, S.JOB_HISTORY)
    out.compact_into(compacted, "employee_sk")
    same(compacted.rows(), out.newest("employee_sk"))
    # Keys go on without a gap across batches.
    n, low, high, kinds = out.newest("employee_sk").filter("effective_start_date >= '2024-01-01'").agg(
        F.count("*"), F.min("job_history_id"), F.max("job_history_id"), F.countDistinct("employee_sk")
    ).first()
    assert n == kinds == high - low + 1


def test_a_retried_batch_counts_once(spark, warehouse):
    changes, history = warehouse["changes"], warehouse["employee_job_history"]
    out, bad = table(spark, S.JOB_HISTORY), table(spark, rejects(changes.schema))
    out.write(history, START)
    process = sync.attribute_changes(out, bad, warehouse["departments"], warehouse["job_roles"])
    early, late = changes.filter("change_date < '2024-01-15'"), changes.filter("change_date >= '2024-01-15'")
    process(early, 0)
    process(late, 1)
    before = out.newest("employee_sk").collect()
    process(late, 1)
    assert sorted(map(str, out.newest("employee_sk").collect())) == sorted(map(str, before))
    # The same events under a new batch id change nothing either.
    process(late, 2)
    assert sorted(map(str, out.newest("employee_sk").collect())) == sorted(map(str, before))


def test_only_touched_rows_are_written(spark, warehouse):
    out, bad = table(spark, S.JOB_HISTORY), table(spark, rejects(warehouse["changes"].schema))
    out.write(warehouse["employee_job_history"], START)
    one = warehouse["changes"].filter("employee_id = 5").orderBy("change_seq").limit(1)
    sync.attribute_changes(out, bad, warehouse["departments"], warehouse["job_roles"])(one, 0)
    assert out.read().filter("batch_id = 0").count() <= 2


def test_projects_get_consecutive_keys(spark, warehouse):
    projects = warehouse["projects"]
    out = table(spark, S.DIM_PROJECT)
    cuts = ["project_id < 70", "project_id >= 70 and project_id < 150", "project_id >= 150"]
    run_available(files_in_order(projects, spark, cuts), sync.new_projects(out), new_path(spark, "progress"))
    same(out.rows(), warehouse["dim_project"])
    assert out.read().select("batch_id").distinct().count() == 3


def test_back_dated_assignment_takes_the_present_version(spark, warehouse):
    day = dt.date(1997, 6, 1)
    two = warehouse["dim_employee"].groupBy("employee_id").count().filter("count = 2").select("employee_id").limit(1)
    employee = two.first()[0]
    batch = S.shaped(
        spark.createDataFrame([(1, employee, 3, "Lead", day), (2, 10**9, 3, "Lead", day), (3, employee, 10**9, "Lead", day)],
                              "assignment_id long, employee_id long, project_id long, role_on_project string, assigned_date date")
        .withColumns({"allocation_ratio": F.lit(50), "end_date": F.lit(None)}),
        S.ASSIGNMENTS,
    )
    out = table(spark, S.DIM_ASSIGNMENT)
    sync.new_assignments(out, warehouse["dim_employee"], warehouse["dim_project"])(batch, 0)
    got = out.rows().collect()
    assert [r["assignment_id"] for r in got] == [1]
    assert got[0]["employee_sk"] == 2 * employee + 1


def test_hires_already_known_are_not_added_again(spark, warehouse):
    hires = warehouse["hires"]
    broken = S.T.StructType([*hires.schema.fields, S.T.StructField("first_broken", S.T.StringType())])
    employees, history = table(spark, S.EMPLOYEES), table(spark, S.JOB_HISTORY)
    dim, bad = table(spark, S.DIM_EMPLOYEE), table(spark, broken)
    history.write(warehouse["employee_job_history"], START)
    process = sync.new_hires(
        employees, history, dim, bad, warehouse["departments"], warehouse["job_roles"], dt.date(2024, 2, 1)
    )
    process(hires, 0)
    first = dim.rows().count()
    process(hires, 1)
    assert first > 0 and dim.rows().count() == first and employees.rows().count() == first
    # The second time, the accepted ones are refused as well: their numbers are taken.
    assert bad.rows().count() == 2 * (hires.count() - first) + first


def test_reading_a_table_nobody_has_written(spark):
    assert table(spark, S.REVIEWS).rows().count() == 0


def arriving(spark, schema, parts):
    """A stream whose rows arrive in parts, and a function that lets the next part arrive."""
    path = new_path(spark, "arriving")
    spark.createDataFrame([], schema).write.parquet(path)
    waiting_parts = iter(parts)

    def step():
        spark.createDataFrame(next(waiting_parts), schema).coalesce(1).write.mode("append").parquet(path)

    return spark.readStream.schema(schema).parquet(path), step


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def test_a_child_waits_for_its_parent(spark):
    child_rows = [[(1, 10, at(0)), (2, 20, at(0)), (3, 30, at(1)), (4, None, at(1))], [(5, 10, at(2)), (1, 10, at(2))], [(6, 40, at(4))], [(-1, -1, at(400))]]
    parent_rows = [[(10, at(0))], [(99, at(2))], [(20, at(4)), (10, at(4))], [(30, at(60)), (40, at(3)), (-1, at(400))]]
    children, next_children = arriving(spark, "id long, parent long, asked timestamp", child_rows)
    parents, next_parents = arriving(spark, "parent long, came timestamp", parent_rows)
    once = waiting.first_requests(children, ["id"], "asked", "3 days")
    known = waiting.arrivals(parents, "parent", "came", "3 days")
    judged = waiting.await_parent(once, known, "parent", "asked", "came", "10 days", "known")
    progress, out = new_path(spark, "progress"), table(spark, T.StructType([*judged.schema.fields]))
    seen = []
    for _ in range(4):
        next_children()
        next_parents()
        run_available(judged, lambda batch, i: out.write(batch.filter("id <> -1"), i), progress)
        seen.append(sorted((r.id, r.known) for r in out.rows().collect()))
    assert seen[0] == [(1, True)]
    assert seen[1] == [(1, True), (5, True)]  # the request that came again counts once
    assert seen[2] == [(1, True), (2, True), (5, True)]  # its parent came two batches later
    # The rest is decided when the watermark has passed: 30 came too late, 4 has no parent, 40 came in time.
    assert seen[3] == [(1, True), (2, True), (3, False), (4, False), (5, True), (6, True)]
    # Nothing new arrived: a further run, and a replay of a batch, change nothing.
    run_available(judged, lambda batch, i: out.write(batch.filter("id <> -1"), i), progress)
    assert sorted((r.id, r.known) for r in out.rows().collect()) == seen[3]


def test_early_assignments_are_keyed_when_their_employee_is_there(spark, warehouse):
    employee = warehouse["dim_employee"].filter("is_current = 1").select("employee_id").first()[0]
    project = warehouse["dim_project"].select("project_id").first()[0]
    rows = [(1, employee, True, True), (2, employee, False, True), (3, employee, True, False), (4, 10**9, True, True)]
    batch = spark.createDataFrame(rows, "assignment_id long, employee_id long, employee_known boolean, project_known boolean").withColumn("project_id", F.lit(project))
    batch = S.shaped(batch.withColumns({"role_on_project": F.lit("x"), "allocation_ratio": F.lit(5), "assigned_date": F.lit(dt.date(2024, 1, 1)), "end_date": F.lit(None)}),
                     S.T.StructType([*S.ASSIGNMENTS.fields, S.T.StructField("employee_known", S.T.BooleanType()), S.T.StructField("project_known", S.T.BooleanType())]))
    out, bad = table(spark, S.DIM_ASSIGNMENT), table(spark, rejects(S.ASSIGNMENTS))
    process = sync.new_assignments(out, warehouse["dim_employee"], warehouse["dim_project"], bad, once=True)
    for _ in range(2):  # a retried batch counts once
        process(batch, 0)
        assert [(r.assignment_sk, r.assignment_id) for r in out.rows().collect()] == [(1, 1)]
        assert {(r.assignment_id, r.reject_reason) for r in bad.rows().collect()} == {(2, "unknown employee"), (3, "unknown project"), (4, "unknown employee")}


def test_no_batch_reads_what_earlier_ones_wrote(spark, warehouse):
    """Ten batches with repeats; the folders of earlier batches are gone by the third."""
    projects = warehouse["projects"].orderBy("project_id").limit(20).withColumn("at", F.lit(None).cast("timestamp"))
    rows = [tuple(r) for r in projects.drop("at").collect()]
    parts = [[(*r, at(i)) for r in rows[2 * i : 2 * i + 2] + rows[max(0, 2 * i - 2) : 2 * i]] for i in range(10)]
    stream, step = arriving(spark, projects.schema, parts)
    out, progress = table(spark, S.DIM_PROJECT), new_path(spark, "progress")
    once = waiting.first_requests(stream, ["project_id"], "at", "5 days")
    process, numbers = sync.new_projects(out, once=True), []

    def kept(batch, i):
        process(batch, i)
        numbers.extend((r.project_sk, r.project_id) for r in out.read().filter(F.col("batch_id") == i).collect())
        if i >= 1:
            for folder in (out.path, out._marks):
                shutil.rmtree(f"{folder.removeprefix('file:')}/batch_id={i - 1}")

    for _ in range(10):
        step()
        run_available(once, kept, progress)
    assert sorted(numbers) == [(i + 1, r[0]) for i, r in enumerate(rows)]


def test_marks_hold_rows_and_highest_key(spark):
    out = table(spark, T.StructType([T.StructField("k", T.LongType())]))
    make = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k long")
    out.write(make(1, 7), START)  # a table begun without marks is read once
    assert out.mark("k", 0) == (2, 7)
    for _ in range(2):
        out.write(make(8, 9), 0, "k")
    assert out.mark("k", 1) == (4, 9) and out.next_key("k", 1) == 10
    out.write(make(), 1, "k")
    assert out.mark("k", 2) == (4, 9)
    assert out.mark("k", 9) == (4, 9)  # batch numbers may leave gaps
    rows = out.rows().agg(F.count("*"), F.max("k")).first()
    assert out.mark("k", 2) == tuple(rows)
    assert table(spark, out.schema).mark("k", 0) == (0, 0)


def test_steps_with_state_run_once_a_batch_in_the_parts_asked_for(spark):
    """What a batch asks for again is read from files; the session's own setting stays."""
    name, ran = "spark.sql.shuffle.partitions", spark.sparkContext.accumulator(0)
    usual = spark.conf.get(name)
    assert state_parts(spark, 10) == min(int(usual), spark.sparkContext.defaultParallelism)
    assert state_parts(spark, 100 * STATE_ROWS + 1) == 101

    def counted(k):
        ran.add(1)
        return k

    columns = "employee_id long, reviewer_id long, review_date date, performance_rating int, request_seq long, sent timestamp"
    stream, step = arriving(spark, columns, [[(k, 1, at(0).date(), 3, k, at(0)) for k in range(20) for _ in range(2)]])
    step()
    once = waiting.first_requests(stream, ["request_seq"], "sent", "5 days").drop("sent")
    once = once.withColumn("request_seq", F.udf(counted, "long")("request_seq"))
    out = table(spark, S.T.StructType([*S.REVIEWS.fields, S.T.StructField("request_seq", S.T.LongType())]))
    progress = new_path(spark, "progress")
    run_available(once, sync.new_reviews(out, once=True), progress, parts=3)
    assert sorted(r.request_seq for r in out.rows().collect()) == list(range(20))
    assert ran.value == 20
    kept = [p.name for p in (Path(progress.removeprefix("file:")) / "state" / "0").iterdir() if p.name.isdigit()]
    assert sorted(kept) == ["0", "1", "2"]
    assert spark.conf.get(name) == usual


def stored_state(progress):
    """Kinds of the files that the first part of a run's first step with state left."""
    return {p.suffix for p in (Path(progress.removeprefix("file:")) / "state" / "0" / "0").rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_state_lies_in_files_and_not_on_the_heap(spark):
    """Waiting rows, repeats and parents as in memory, also by a second run; the session's settings stay."""
    child_rows = [[(k, k % 50, at(0)) for k in range(200)], [(k, k % 50, at(2)) for k in range(100, 300)], [(-1, -1, at(400))]]
    parent_rows = [[(p, at(0)) for p in range(0, 50, 2)], [(p, at(2)) for p in range(0, 25)], [(-1, at(400))]]
    provider, before = "spark.sql.streaming.stateStore.providerClass", {n: spark.conf.get(n, None) for n in STATE_STORE}
    found = {}
    for kind in ("files", "heap"):
        children, next_children = arriving(spark, "id long, parent long, asked timestamp", child_rows)
        parents, next_parents = arriving(spark, "parent long, came timestamp", parent_rows)
        once = waiting.first_requests(children, ["id"], "asked", "3 days")
        known = waiting.arrivals(parents, "parent", "came", "3 days")
        judged = waiting.await_parent(once, known, "parent", "asked", "came", "10 days", "known")
        progress, out = new_path(spark, "progress"), table(spark, T.StructType([*judged.schema.fields]))
        try:
            if kind == "heap":  # a session's own choice counts
                spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
            for _ in range(3):
                next_children()
                next_parents()
                run_available(judged, lambda batch, i: out.write(batch.filter("id <> -1"), i), progress, parts=2)
        finally:
            if kind == "heap":
                spark.conf.unset(provider)
        assert {n: spark.conf.get(n, None) for n in STATE_STORE} == before
        found[kind] = sorted((r.id, r.known) for r in out.rows().collect())
        assert (".zip" in stored_state(progress)) == (kind == "files")
        assert (".delta" in stored_state(progress)) == (kind == "heap")
    assert found["files"] == found["heap"] == [(k, k % 50 < 25 or k % 2 == 0) for k in range(300)]
