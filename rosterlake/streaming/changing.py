"""Tables that a stream changes in place: a batch reads and rewrites only the parts that its employees fall into.

A batch works in two steps. First it stages what the touched parts will hold, and as the last of that a mark: the
highest keys so far. Then the staged parts replace the stored ones. A batch that is tried again before its mark is there
works everything out anew from tables that are still as they were; after that it only puts the same staged parts in place
again, so that a failure between two tables, or while parts are moved, neither loses rows nor counts any twice.
One stream writes to a table. A part is written by one task, so it should hold what a task can sort; an employee
has at most one version a day and cannot outgrow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.operators.parts import PARTS, PartedTable
from rosterlake.streaming.tables import START, BatchTable


# A part should be what one task can sort and rewrite; below so many parts, more of them only make more files.
PART_ROWS, LEAST_PARTS = 50_000, 16


def table_parts(rows: int) -> int:
    """The number of parts for a table of so many rows, with room to grow."""
    return max(LEAST_PARTS, -(-rows // PART_ROWS))


class ChangingTable:
    """Rows of a schema, each known by row_key, in parts by the columns part_by. numbered are keys that batches hand out."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        row_key: str,
        part_by: str = "employee_id",
        numbered: tuple[str, ...] = (),
        parts: int = PARTS,
    ):
        self.spark, self.schema, self.row_key, self.numbered = spark, schema, row_key, numbered
        self.table = PartedTable(spark, f"{path}/rows", schema, [part_by], parts)
        self._staged = f"{path}/staged"
        fields = [T.StructField(c, T.LongType()) for c in ("n_rows", *numbered)]
        self._marks = BatchTable(spark, f"{path}/marks", T.StructType(fields))

    def create(self, df: DataFrame) -> None:
        """Write the first rows; the path must be new. The highest keys are observed meanwhile."""
        self._marked(df, START, {c: 0 for c in self.numbered}, self.table.create)

    def rows(self) -> DataFrame:
        return self.table.rows()

    def touched(self, batch: DataFrame) -> DataFrame:
        """The rows of the parts that a batch falls into, all that it reads of the table."""
        return self.table.touched(batch)

    def highest(self, before: int) -> DataFrame:
        """One row: the highest keys that all batches before the given one have left. Batches are numbered without gaps."""
        last = self._marks.one(before - 1)
        if last is None:
            raise ValueError(f"batch {before - 1} has left no mark below {self._staged}")
        return last

    def is_staged(self, batch_id: int) -> bool:
        mark = self._marks.one(batch_id)
        return mark is not None and not mark.isEmpty()

    def stage(self, batch: DataFrame, changed: DataFrame, batch_id: int) -> None:
        """Write what the parts touched by a batch hold after it: changed rows in place of those with their key, and new ones.

        The mark says that everything before it is complete, so of several tables of one batch, the one
        that is asked is_staged is staged last. Rows staged by the batch before are in place by then.
        """
        kept = self.touched(batch).join(changed.select(self.row_key), self.row_key, "left_anti")
        last = self.highest(batch_id).first()
        self._marked(
            kept.select(*self.schema.names).unionByName(changed.select(*self.schema.names)),
            batch_id,
            {c: last[c] for c in self.numbered},
            lambda df: df.write.mode("overwrite").parquet(self._staged),
        )

    def put_in_place(self) -> None:
        """Replace the parts that are staged; done again, it changes nothing."""
        self.table.replace(self.spark.read.schema(self.schema).parquet(self._staged))

    def _marked(self, df: DataFrame, batch_id: int, last: dict[str, int], write) -> None:
        """Write and leave the mark: the highest of the keys so far and those observed in the rows."""
        seen = Observation(f"{self.row_key}-{batch_id}")
        write(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.max(c).cast("long").alias(c) for c in self.numbered]))
        found = seen.get
        row = (found.get("n_rows") or 0, *[max(last[c], found.get(c) or 0) for c in self.numbered])
        self._marks.write(self.spark.createDataFrame([row], self._marks.schema).coalesce(1), batch_id)
