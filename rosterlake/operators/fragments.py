"""Substring search by postings of trigrams.

A row's text, in lower case, has a posting (gram, key) for each of its distinct trigrams. A search intersects the
postings of the fragment's trigrams, reads only the parts of the table that those keys lie in, and applies the exact test to what
it finds. A fragment without three plain characters in a row is searched in the whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions.text import contains_fragment
from rosterlake.operators.parts import PARTS, PartedTable
from rosterlake.operators.skew import lookup_join
from rosterlake.session import written

GRAM = 3
GRAM_PARTS = 32


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for null or shorter ones."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - F.lit(GRAM - 1), F.lit(1)))
    cut = F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(GRAM))))
    return F.when(F.length(low) >= GRAM, cut).otherwise(F.array().cast("array<string>"))


def wanted_grams(fragment: str, *, literal: bool = False) -> list[str]:
    """Trigrams that every text with the fragment has.

    Wildcards end a run of characters, and so do characters outside ASCII, whose lower case is left to the exact
    test. A fragment with an escape has none.
    """
    if not literal and "\\" in fragment:
        return []
    runs = re.findall(r"[\x00-\x7f]+" if literal else r"[\x00-\x24\x26-\x5e\x60-\x7f]+", fragment)
    return sorted({r.lower()[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)})


class FragmentIndex:
    """A table below a path in parts by its key, with the postings of one text. The key is not null."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, text: Column, parts: int = PARTS):
        self.spark, self.key, self.text = spark, key, text
        self.table = PartedTable(spark, f"{path}/rows", schema, [key], parts)
        self._path = f"{path}/postings"
        self._stored = T.StructType([T.StructField("gram", T.StringType()), schema[key], T.StructField("part", T.IntegerType())])

    def build(self, df: DataFrame) -> None:
        """Write rows and postings. Ranges of (gram, key) split a gram that much of the table has."""
        checked = F.when(F.col(self.key).isNull(), F.raise_error(F.lit("null key"))).otherwise(F.col(self.key))
        self.table.create(df.withColumn(self.key, checked.cast(df.schema[self.key].dataType)))
        postings = df.select(F.col(self.key), F.explode(grams(self.text)).alias("gram")).withColumn("part", _part(F.col("gram")))
        order = ["part", "gram", self.key]
        postings.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("part").parquet(self._path)

    def candidates(self, fragment: str, *, literal: bool = False) -> DataFrame | None:
        """Keys whose texts have all trigrams of the fragment; None where it has none to ask for."""
        wanted = wanted_grams(fragment, literal=literal)
        if not wanted:
            return None
        asked = F.col("gram").isin(wanted) & F.col("part").isin([_part(F.lit(g)) for g in wanted])
        postings = self.spark.read.schema(self._stored).parquet(self._path).filter(asked)
        return postings.groupBy(self.key).agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == len(wanted)).select(self.key)

    def search(self, fragment: str, *, literal: bool = False) -> DataFrame:
        """The rows whose text contains the fragment, as contains_fragment says, wildcards and case included."""
        exact = contains_fragment(self.text, fragment, literal=literal)
        keys = self.candidates(fragment, literal=literal)
        if keys is None:
            return self.table.rows().filter(exact)
        keys = written(keys, "candidates")
        return lookup_join(self.table.touched(keys), keys, [self.key], "left_semi").filter(exact)


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_PARTS)).cast("int")
