"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])

#: Texts are long rows: fewer of them in an Arrow batch keep workers small. A session's own choice stays.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")

#: Words of the contracts: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did.

    Enough for local sessions and for clusters that mount the folder; elsewhere the package is
    installed on the executors or given with --py-files, as usual.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([ROOT, *paths])
    if spark.conf.get(BATCH_ROWS[0]) == "10000":  # Spark's default, meant for short rows
        spark.conf.set(*BATCH_ROWS)


def chunks(texts: Iterable[str], most_chars: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about most_chars characters (a longer text stands alone)."""
    held: list[str] = []
    chars = 0
    for text in texts:
        if held and chars + len(text) > most_chars:
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


def let_go(*caches) -> None:
    """Forget what functions have cached, and give the memory back to the system.

    For the end of a task: Spark reuses a worker for the stages that follow, which have no use for it.
    """
    for cache in caches:
        cache.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


class PieceArrays:
    """What a worker knows about pieces of text: an array of numbers for each, all in one buffer.

    Holds at most `most` pieces before it starts anew (more only if one group of texts needs them).
    """

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start = self.length = np.zeros(0, dtype=np.int64)
        self.values, self.used = np.zeros(1 << 16, dtype=np.int32), 0

    def missing(self, pieces: Iterable[str]) -> set[str]:
        """The pieces to be added for these to be known."""
        pieces = set(pieces)
        new = pieces.difference(self.number)
        if new and len(self.number) + len(new) > self.most:
            self.forget()
            return pieces
        return new

    def add(self, pieces: list[str], lengths: list[int], values: list[int]) -> None:
        """Add pieces whose arrays stand one after the other in values."""
        first = len(self.number)
        self.number.update(zip(pieces, range(first, first + len(pieces))))
        own = np.array(lengths, dtype=np.int64)
        self.start = np.concatenate((self.start, self.used + np.cumsum(own) - own))
        self.length = np.concatenate((self.length, own))
        if self.used + len(values) > len(self.values):
            self.values = np.concatenate((self.values, np.zeros(len(self.values) + len(values), dtype=np.int32)))
        self.values[self.used : self.used + len(values)] = values
        self.used += len(values)

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of known pieces."""
        return np.fromiter(map(self.number.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the arrays of these pieces one after the other, where each ends)."""
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        if not len(ends):
            return self.values[:0], ends
        places = np.arange(ends[-1]) + np.repeat(self.start[numbers] - ends + lengths, lengths)
        return self.values[places], ends
