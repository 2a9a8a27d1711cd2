"""Tables that streams write to: one folder per micro-batch, written anew when a batch is retried.

A retried batch replaces its own folder, and reads only the folders of earlier batches, so each
batch counts once. One stream writes to one table.

A batch that hands out keys leaves a mark: the rows and the highest key so far, observed while the batch
was written. The next batch goes on from that one row, so no stored row is read to number new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.conf import RuntimeConfig

from rosterlake.operators.numbering import next_key
from rosterlake.operators.ordering import latest

START = -1
_MARK = T.StructType([T.StructField("n_rows", T.LongType()), T.StructField("last_key", T.LongType())])


class BatchTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, df: DataFrame, batch_id: int, key: str | None = None) -> None:
        """Write a batch; with a key column, leave a mark as well."""
        if key is None:
            df.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
            return
        n_rows, last_key = self.mark(key, batch_id)
        seen = Observation(f"batch-{batch_id}")
        observed = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.max(key).cast("long").alias("last_key"))
        observed.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        found = seen.get
        row = (n_rows + (found.get("n_rows") or 0), max(last_key, found.get("last_key") or 0))
        self.spark.createDataFrame([row], _MARK).coalesce(1).write.mode("overwrite").parquet(f"{self._marks}/batch_id={batch_id}")

    def mark(self, key: str, before: int) -> tuple[int, int]:
        """(rows, highest key) of all batches before the given one, from the mark of the last of them.

        A table that was begun without marks is read once, by the first batch that leaves one.
        """
        marks = self._stored(f"{self._marks}/batch_id={before - 1}", _MARK)
        if marks is None:
            rows = self._stored(self._marks, T.StructType([*_MARK.fields, T.StructField("batch_id", T.LongType())]))
            if rows is not None:
                marks = rows.filter(F.col("batch_id") < before).orderBy(F.desc("batch_id")).limit(1)
        found = None if marks is None else marks.first()
        if found is None:
            earlier = self.read(before)
            return earlier.count(), next_key(earlier, key) - 1
        return found["n_rows"], found["last_key"]

    def next_key(self, key: str, before: int) -> int:
        return self.mark(key, before)[1] + 1

    @property
    def _marks(self) -> str:
        return f"{self.path}-marks"

    def _stored(self, path: str, schema: T.StructType) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def one(self, batch_id: int) -> DataFrame | None:
        """The rows that one batch wrote, or None if it wrote nothing. No other batch's files are listed."""
        return self._stored(f"{self.path}/batch_id={batch_id}", self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        """All rows with their batch_id, or only those of batches before the given one."""
        stored = T.StructType([*self.schema.fields, T.StructField("batch_id", T.LongType())])
        rows = self._stored(self.path, stored)
        if rows is None:
            rows = self.spark.createDataFrame([], stored)
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    def rows(self, before: int | None = None) -> DataFrame:
        return self.read(before).drop("batch_id")

    def newest(self, key: str, before: int | None = None) -> DataFrame:
        """The last written row of each key: how a changing table is stored as additions only."""
        return latest(self.read(before), [key], ["batch_id"]).drop("batch_id")

    def compact_into(self, other: BatchTable, key: str) -> None:
        """Start another table with the newest row of each key, to read fewer files from then on."""
        other.write(self.newest(key), START)


# A step with state keeps its keys in so many parts that each has at most about this many rows of a run.
STATE_ROWS = 500_000

# State lies in RocksDB's files, not in maps on the executors' heaps, which would hold every key and row that still
# matters. All stores of an executor share one bounded piece of memory; a join has one store for each part, not four.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def state_parts(spark: SparkSession, rows: int) -> int:
    """Into how many parts steps with state should divide their keys, for a stream of so many rows.

    Each part of each step commits files of its own with every micro-batch, however few rows it has, so few rows
    get no more parts than there are cores.
    """
    cores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(cores, -(-rows // STATE_ROWS))


@contextmanager
def _settings(conf: RuntimeConfig, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and then as it was."""
    usual = {name: conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            conf.set(name, value)
        yield
    finally:
        for name, value in usual.items():
            conf.unset(name) if value is None else conf.set(name, value)


def run_available(stream: DataFrame, process, checkpoint: str, parts: int | None = None) -> None:
    """Run process(batch, batch_id) over everything that is there now, then stop.

    parts is for the steps with state (state_parts), whose state then lies in a STATE_STORE, unless the session names
    a provider of its own. Both hold as long as the checkpoint does: later runs keep those of the first.
    """
    conf, values = stream.sparkSession.conf, {}
    if parts is not None:
        own = conf.get("spark.sql.streaming.stateStore.providerClass", None) is not None
        values = {"spark.sql.shuffle.partitions": str(parts)} | ({} if own else STATE_STORE)
    # A started query has its own copy of the settings.
    with _settings(conf, values):
        query = (
            stream.writeStream.foreachBatch(process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
