"""Exact top-k inner products from a bit-sliced index.

Vectors are quantised to whole numbers. For a block of rows, each dimension is stored as slices: the
bits of one weight of all rows' values (less the block's smallest) form one bitmap. A query's score
is a sum of attributes times weights, and a product by a weight is the sum of the attribute's slices
moved up by each set bit of the weight; for a negative weight the complemented slices are taken.
Both changes add the same to every row of a block, so all slices are added by bitmap arithmetic alone
(full adders on whole bitmaps, column by column). The k best rows are then selected from the sum's
most significant slice downward: rows that have the bit stay in play as long as there are at least k
of them. Rows that tie at the boundary are resolved exactly by their ids.

Every row is in one block, and every query meets every block; blocks and groups of queries are joined
by explicit numbers, so a task holds one block and one group. Each gives k rows a query, and the best
k of those are the answer.

Defined results
* Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id.
* Scores are longs. If the largest norm of a query times the largest norm of a row says that one of those
  that take part might not fit, an error is raised; no row is left out for it. A component that is no long
  itself after scaling (2^63 or more) counts as the largest, so it raises unless all queries are zeros.
* Shorter vectors count as continued with zeros; an empty vector scores 0.
* Fewer than k candidates: all of them. Ties: the smaller id. A query's own row is every row with its id.
* Repeated rows are candidates one by one; a query that is repeated is answered once for each
  different vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import workers_import
from rosterlake.session import written

BLOCK_ROWS = 65_536
QUERY_ROWS = 1_024
LARGEST = 1 << 63


def quantised(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(id, values array<long>) of the rows that take part."""
    cells = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull())
    return rows.filter(finite).select(F.col(id_col).cast("long").alias("id"), cells.alias("values"))


def _norm(values: str) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def _matrix(values: pa.ListArray) -> np.ndarray:
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _sliced(ids: np.ndarray, matrix: np.ndarray) -> dict:
    """A block: ids in order, each dimension's least value and its bitmaps, low weights first."""
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    least = matrix.min(axis=0)
    shifted = matrix.astype(np.uint64) - least.astype(np.uint64)  # what wraps around comes out right
    counts, bitmaps = [], []
    words = -(-len(ids) // 64)
    for column in shifted.T:
        bits = int(column.max()).bit_length()
        counts.append(bits)
        for b in range(bits):
            packed = np.packbits((column >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little")
            bitmaps.append(packed.tobytes().ljust(words * 8, b"\0"))
    return {"ids": ids.tobytes(), "least": least.tolist(), "bits": counts, "slices": b"".join(bitmaps)}


_BLOCK = "ids binary, least array<long>, bits array<int>, slices binary"


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row (block, ids, least, bits, slices) for each block of at most block_rows rows, written."""
    workers_import(rows.sparkSession)

    def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            made = _sliced(table.column(0).to_numpy(), _matrix(table.column(1).combine_chunks()))
            kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([made[k]], t) for k, t in zip(made, kinds)], names=list(made))

        count = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_rows - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == block_rows:
                    yield block()
                    count = 0
        if held:
            yield block()

    blocks = max(1, -(-rows.count() // block_rows))
    made = rows.repartition(blocks).mapInArrow(slice_up, _BLOCK)
    return written(made.withColumn("block", F.monotonically_increasing_id()), "bit-slices")


def _added(columns: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """The sum of bitmaps, given by weight, as one bitmap for each weight: full and half adders."""
    total = []
    i = 0
    while i < len(columns):
        column = columns[i]
        if i + 1 == len(columns) and len(column) > 1:
            columns.append([])
        while len(column) > 2:
            a, b, c = column.pop(), column.pop(), column.pop()
            half = a ^ b
            columns[i + 1].append((a & b) | (half & c))
            half ^= c
            column.insert(0, half)
        if len(column) == 2:
            a, b = column
            columns[i + 1].append(a & b)
            column[:] = [a ^ b]
        total.append(column[0] if column else np.zeros(words, dtype=np.uint64))
        i += 1
    return total


class Block:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.words = -(-len(self.ids) // 64)
        self.least = row["least"]
        flat = np.frombuffer(row["slices"], dtype=np.uint64).reshape(-1, self.words)
        ends = np.cumsum([0, *row["bits"]])
        self.slices = [list(flat[a:b]) for a, b in zip(ends, ends[1:])]
        self.complements = [[~s for s in of] for of in self.slices]
        self.all = np.packbits(np.ones(len(self.ids), dtype=np.uint8), bitorder="little")
        self.all = np.frombuffer(self.all.tobytes().ljust(self.words * 8, b"\0"), dtype=np.uint64)

    def best(self, query: list[int], own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than `own`."""
        columns: list[list[np.ndarray]] = [[]]
        constant = 0
        for weight, least, plain, other in zip(query, self.least, self.slices, self.complements):
            constant += weight * least
            if weight < 0:  # -w * x = w * (complement of x) - w * (all bits set)
                constant += weight * ((1 << len(plain)) - 1)
            for up in range(abs(weight).bit_length()):
                if abs(weight) >> up & 1:
                    columns.extend([] for _ in range(up + len(plain) - len(columns)))
                    for b, s in enumerate(plain if weight >= 0 else other):
                        columns[up + b].append(s)
        total = _added(columns, self.words)
        play = self.all.copy()  # rows that may still be among the k best
        at = np.arange(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right"))
        if len(at):
            np.bitwise_and.at(play, at >> 6, ~(np.uint64(1) << (at & 63).astype(np.uint64)))
        sure, left = np.zeros_like(play), k
        for s in reversed(total):
            high = play & s
            n = int(np.bitwise_count(high).sum())
            if n > left:
                play = high
            else:
                sure |= high
                left -= n
                play = play & ~s
                if not left:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if left:  # the rows in play tie at the boundary; they stand in order of their ids
            rows = np.concatenate((rows, np.flatnonzero(np.unpackbits(play.view(np.uint8), bitorder="little"))[:left]))
        # The sum may be longer than a score; a score fits a long, so its lowest 64 bits are enough.
        scores = np.zeros(len(rows), dtype=np.uint64)
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        for b, s in enumerate(total[:64]):
            scores |= (s[word] >> bit & np.uint64(1)) << np.uint64(b)
        return self.ids[rows], (scores + np.uint64(constant % (1 << 64))).view(np.int64)


_ANSWER = "query_id long, same long, vec_id long, score long"


def top_k(
    df: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of df for each row that is_query picks."""
    workers_import(df.sparkSession)
    rows = quantised(df, id_col, vector, scale)
    index = build_index(rows, block_rows)
    asked = quantised(df.filter(is_query), id_col, vector, scale).distinct()
    n_asked, far_asked = asked.agg(F.count("*"), F.max(_norm("values"))).first()
    far = rows.agg(F.max(_norm("values"))).first()[0]
    if n_asked and far_asked * far >= LARGEST * (1 - 1e-9):  # norms are rounded
        raise OverflowError(f"scores may not fit a long: norms of up to {far_asked:g} and {far:g} after scaling")
    groups = max(1, -(-n_asked // QUERY_ROWS))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("id", "values"), F.lit(groups)).cast("int"))
    asked = asked.groupBy("group").agg(F.collect_list(F.struct("id", "values")).alias("queries"))
    tasks = (
        index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        .join(asked, "group")
        .repartition(max(1, index.count() * groups), "block", "group")  # about one block and one group in a task
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                block = Block(of)
                out: list[tuple] = []
                for same, q in enumerate(of["queries"]):
                    ids, scores = block.best(q["values"], q["id"], k)
                    out.append((np.full(len(ids), q["id"]), np.full(len(ids), hash(tuple(q["values"]))), ids, scores))
                arrays = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "same", "vec_id", "score"])

    found = tasks.select("ids", "least", "bits", "slices", "queries").mapInArrow(answer, _ANSWER)
    place = F.row_number().over(Window.partitionBy("query_id", "same").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
