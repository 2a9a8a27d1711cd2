"""Tables that a stream changes in place: failures at every step, retried batches, what is read and rewritten."""

import re
import shutil

import pytest
from pyspark.sql import functions as F

from rosterlake import schemas as S
from rosterlake.operators.versions import apply_to_employees, apply_to_history, judge_changes
from rosterlake.session import new_path
from rosterlake.streaming import sync
from rosterlake.streaming.changing import LEAST_PARTS, PART_ROWS, ChangingTable, table_parts
from rosterlake.streaming.tables import BatchTable

KEYS = ("employee_sk", "job_history_id")
EARLY, LATE = "change_date < '2024-01-15'", "change_date >= '2024-01-15'"


class Job:
    def __init__(self, spark, warehouse, parts=8):
        self.history = self._table(spark, warehouse["employee_job_history"], "employee_sk", parts, KEYS)
        self.dimension = self._table(spark, warehouse["dim_employee"], "employee_sk", parts)
        self.employees = self._table(spark, warehouse["employees"], "employee_id", parts)
        schema = S.T.StructType([*warehouse["changes"].schema.fields, S.T.StructField("reject_reason", S.T.StringType())])
        self.rejected = BatchTable(spark, new_path(spark, "rejected"), schema)
        self.tables = [self.history, self.dimension, self.employees]
        self.process = sync.attribute_changes_in_parts(*self.tables, self.rejected, warehouse["departments"], warehouse["job_roles"])

    @staticmethod
    def _table(spark, rows, key, parts, numbered=()):
        out = ChangingTable(spark, new_path(spark, "changing"), rows.schema, key, numbered=numbered, parts=parts)
        out.create(rows)
        return out

    def state(self):
        return [sorted(map(repr, t.rows().collect())) for t in (*self.tables, self.rejected)]

    def files(self):
        return [set(t.rows().inputFiles()) for t in self.tables]


@pytest.fixture(scope="module")
def expected(spark, warehouse):
    """The state after the early and after the late batch, without failures."""
    job, changes = Job(spark, warehouse), warehouse["changes"]
    job.process(changes.filter(EARLY), 0)
    early = job.state()
    job.process(changes.filter(LATE), 1)
    return early, job.state(), job


def test_two_batches_equal_one(warehouse, expected):
    job, changes = expected[2], warehouse["changes"]
    judged = judge_changes(changes, warehouse["employee_job_history"], warehouse["departments"], warehouse["job_roles"])
    whole = apply_to_history(warehouse["employee_job_history"], judged.accepted).history.drop(*KEYS)
    moved = apply_to_employees(warehouse["employees"], judged.accepted)
    for ours, theirs in ((job.history.rows().drop(*KEYS), whole), (job.employees.rows(), moved)):
        assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty()
    assert job.rejected.rows().count() == judged.rejected.count()
    keys = job.history.rows().agg(F.count("*"), F.countDistinct("employee_sk"), F.max("employee_sk"), F.max("job_history_id")).first()
    assert keys[0] == keys[1]
    assert job.history.highest(2).select(*KEYS).first() == (keys[2], keys[3])


@pytest.mark.parametrize("step", ["stage", "put_in_place"])
@pytest.mark.parametrize("at", [0, 1, 2])
def test_a_batch_that_failed_is_done_again(spark, warehouse, expected, monkeypatch, step, at):
    job, changes = Job(spark, warehouse), warehouse["changes"]
    start = job.state()

    def stop(*_):
        raise RuntimeError("stop")

    with monkeypatch.context() as patch:
        patch.setattr(job.tables[at], step, stop)
        with pytest.raises(RuntimeError, match="stop"):
            job.process(changes.filter(EARLY), 0)
    if step == "stage":
        assert job.state()[:3] == start[:3]
    job.process(changes.filter(EARLY), 0)
    assert job.state() == expected[0]


def test_parts_lost_while_being_moved_come_back(spark, warehouse, expected, monkeypatch):
    """Overwriting removes a part's folder before the new one is moved there; a driver can be lost in between."""
    job, changes = Job(spark, warehouse), warehouse["changes"]

    def lose(*_):
        touched = job.dimension.touched(changes.filter(EARLY)).inputFiles()
        shutil.rmtree(touched[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/"))
        raise RuntimeError("stop")

    with monkeypatch.context() as patch:
        patch.setattr(job.dimension, "put_in_place", lose)
        with pytest.raises(RuntimeError, match="stop"):
            job.process(changes.filter(EARLY), 0)
    assert job.state() != expected[0]
    job.process(changes.filter(EARLY), 0)
    assert job.state() == expected[0]


def test_a_batch_again_changes_nothing(warehouse, expected):
    _, late, job = expected
    job.process(warehouse["changes"].filter(LATE), 1)
    assert job.state() == late
    # The same events under another number: those that came late are refused once more, no row changes.
    job.process(warehouse["changes"].filter(LATE), 2)
    assert job.state()[:3] == late[:3]


def test_only_parts_of_the_batch_are_read_and_rewritten(spark, warehouse):
    job, changes = Job(spark, warehouse, parts=16), warehouse["changes"]
    judged = judge_changes(changes, warehouse["employee_job_history"], warehouse["departments"], warehouse["job_roles"])
    someone = judged.accepted.agg(F.min("employee_id")).first()[0]
    before, batch = job.files(), changes.filter(F.col("employee_id") == someone)
    for table, old in zip(job.tables, before):
        touched = table.touched(batch)
        assert re.search(r"PartitionFilters: \[[^]]*part#\d+", touched._jdf.queryExecution().executedPlan().toString())
        assert touched.select(F.input_file_name().alias("f")).distinct().count() == 1 < len(old)
    job.process(batch, 0)
    for old, new in zip(before, job.files()):
        assert len(old - new) == 1 == len(new - old)


def test_batches_without_rows_or_with_unknown_people(spark, warehouse):
    job, changes = Job(spark, warehouse), warehouse["changes"]
    start = job.state()
    job.process(changes.limit(0), 0)
    nobody = changes.limit(1).withColumn("employee_id", F.lit(-5).cast("long"))
    job.process(nobody, 1)
    without = changes.limit(1).withColumn("employee_id", F.lit(None).cast("long"))
    job.process(without, 2)
    assert job.state()[:3] == start[:3]
    assert [r.reject_reason for r in job.rejected.rows().collect()] == ["no current version"] * 2


def test_a_larger_table_has_more_parts():
    assert [table_parts(n) for n in (0, 16 * PART_ROWS, 16 * PART_ROWS + 1)] == [LEAST_PARTS, LEAST_PARTS, 17]
