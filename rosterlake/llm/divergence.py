"""Source divergence audit: how far the vocabularies of the sources of a language lie apart.

Texts are cut into terms by an Arrow compute pipeline in each task: ascii_lower, split_pattern_regex,
dictionary_encode, then hash group_by on the codes, first for each document and then for each (language,
source). What leaves a task are partial counts. Spark merges them by (language, term), which also gives the
number of documents of a language that hold a term, and keeps the terms that enough documents hold.

The merged counts are dealt into shards of about SHARD_TERMS terms. A shard is one matrix (terms by sources
of the language) in one task, and gives the partial sums of the divergence between each two sources; sums
over shards are the answer. So no row is made for a term and a pair of sources. A shard of a language with
many sources is split once more into blocks of BLOCK sources.

All arithmetic is in whole numbers. A term's share in a group of N occurrences is
p = 1 + floor(10^9 (n + 2) / (N + 2 V)), V the number of kept terms of the language; the divergence of
two groups at a term is f = floor((p - q)^2 / (p + q)).

Defined results
* Null text, lang and source count as ''. A row is a document, also if it repeats; its id is not used.
* A (language, source) without terms is a group like any other: all its counts are 0.
* A language without kept terms: 0 between its sources, and no terms.
* Ties stand in the order of the item's UTF-8 bytes.
* Texts of any length are read whole. An empty table gives no rows.
* Only the three named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import workers_import
from rosterlake.session import written

#: Everything between terms: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that must hold a term for it to be kept; terms reported for each group.
LEAST_DOCUMENTS, TOP = 10, 10
#: Terms of a shard, and sources whose rows of the matrix one task works out.
SHARD_TERMS, BLOCK = 1_000, 128
#: Bytes of text that are cut at a time (a longer text is cut alone), and partial counts held by a task.
PIECE_BYTES, HELD = 4 << 20, 400_000

_KEYS = ["lang", "source", "term"]


def _pieces(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes of text each."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _counts(piece: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of some documents."""
    terms = pc.split_pattern_regex(pc.ascii_lower(piece.column("text")), BETWEEN)
    row, term = pc.list_parent_indices(terms), pc.list_flatten(terms).dictionary_encode()
    # The empty string stands where a text begins or ends between terms.
    at = pc.index(term.dictionary, "").as_py()
    cells = pa.table({"row": row, "code": term.indices})
    if at >= 0:
        cells = cells.filter(pc.not_equal(cells["code"], at))
    cells = cells.group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    lang, source = piece.column("lang").dictionary_encode(), piece.column("source").dictionary_encode()
    group = pc.add(pc.multiply(lang.indices.cast(pa.int64()), len(source.dictionary)), source.indices.cast(pa.int64()))
    cells = pa.table({"group": group.take(cells["row"]), "code": cells["code"], "n": cells["count_all"]})
    cells = cells.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    group = cells["group"].to_numpy()
    return pa.table({
        "lang": lang.dictionary.take(pa.array(group // max(1, len(source.dictionary)))),
        "source": source.dictionary.take(pa.array(group % max(1, len(source.dictionary)))),
        "term": term.dictionary.take(cells["code"]),
        "n": cells["n_sum"],
        "docs": cells["n_count"],
    })


def _merged(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])


def _partial_counts(batches: Iterator[pa.RecordBatch], piece_bytes: int, most: int) -> Iterator[pa.RecordBatch]:
    """Counts of this task, added up as far as memory is bounded."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for piece in _pieces(batch, piece_bytes):
            held.append(_counts(piece))
            rows += held[-1].num_rows
            if rows > 2 * most:
                held = [_merged(held)]
                rows = held[0].num_rows
                if rows > most:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches(max_chunksize=50_000)


def count_terms(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs), merged over all documents and spread by (lang, term)."""
    workers_import(df.sparkSession)
    named = {"text": text, "lang": lang, "source": source}
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in named.items()])
    piece_bytes, most = PIECE_BYTES, HELD
    partial = docs.mapInArrow(lambda batches: _partial_counts(batches, piece_bytes, most), "lang string, source string, term string, n long, docs long")
    # Dealt by (lang, term) at once: the tasks have combined their counts, and what follows needs no other shuffle.
    return partial.repartition("lang", "term").groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """p of the module's docstring, exact for any count of a long."""
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + 2)
    return F.call_function("div", above, total.cast("decimal(20,0)") + 2 * terms) + 1


def divide(a: Column, b: Column) -> Column:
    """The floor of a / b for whole numbers that are not negative."""
    return F.call_function("div", a, b)


def _distance(p: Column, q: Column) -> Column:
    return divide((p - q) * (p - q), p + q)


class Audit:
    """Kept terms with their shares in each group and in the language, and the groups themselves.

    terms: lang, source, term, n, p, q (the language's share), place, sources and shards of the group.
    groups: lang, source, place (among the language's sources), p0 (the share of a count of 0), sources,
    vocabulary, shards.
    """

    def __init__(self, df: DataFrame, text: str, lang: str, source: str, least: int):
        blank = F.lit("")
        groups = df.select(
            F.coalesce(F.col(lang).cast("string"), blank).alias("lang"), F.coalesce(F.col(source).cast("string"), blank).alias("source")
        ).distinct()
        of_term = Window.partitionBy("lang", "term")
        counted = count_terms(df, text, lang, source)
        counted = counted.withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("in_lang", F.sum("n").over(of_term))
        kept = written(counted.filter(F.col("in_docs") >= least).select(*_KEYS, "n", "in_lang"), "terms")

        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        single = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("n"))
        of_lang = single.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n").alias("lang_total"))
        groups = groups.join(of_lang, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["vocabulary", "lang_total", "total"])
        some = F.col("vocabulary") > 0
        by_lang = Window.partitionBy("lang")
        self.groups = written(
            groups.select(
                "lang", "source", "vocabulary", "lang_total", "total",
                (F.row_number().over(by_lang.orderBy("source")) - 1).alias("place"),
                F.count("*").over(by_lang).alias("sources"),
                F.when(some, _share(F.lit(0), F.col("total"), F.col("vocabulary"))).alias("p0"),
                F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / SHARD_TERMS)).cast("int").alias("shards"),
            ),
            "groups",
        )
        self.terms = kept.join(self.groups, ["lang", "source"]).select(
            *_KEYS, "n", "place", "sources", "shards",
            _share(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"),
            _share(F.col("in_lang"), F.col("lang_total"), F.col("vocabulary")).alias("q"),
        )


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order))


def telling_terms(audit: Audit, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source uses most above its language."""
    above = audit.terms.filter(F.col("p") > F.col("q"))
    found = above.select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(found).filter(F.col("rank") <= top)


def _block_sums(key: tuple, cells: pa.Table, groups: pa.Table, size: int) -> pa.Table:
    """Sums of f over the terms of a shard, between the sources of a block and all sources of the language."""
    block = key[2].as_py()
    groups = groups.sort_by("at")
    n = groups.num_rows
    first, last = block * size, min(n, (block + 1) * size)
    sums = np.zeros((last - first, n), dtype=np.int64)
    if cells.num_rows:
        codes = cells["term"].combine_chunks().dictionary_encode()
        shares = np.repeat(groups["p0"].to_numpy()[:, None], len(codes.dictionary), axis=1)
        shares[cells["place"].to_numpy(), codes.indices.to_numpy()] = cells["p"].to_numpy()
        for i in range(first, last):
            d = shares - shares[i]
            sums[i - first] = (d * d // (shares + shares[i])).sum(axis=1)
    other = np.arange(first, last)[:, None] != np.arange(n)[None, :]
    a, b = np.nonzero(other)
    source = groups["source"]
    return pa.table({
        "lang": groups["in_lang"].take(pa.array(a)),
        "source": source.take(pa.array(a + first)),
        "item": source.take(pa.array(b)),
        "value": pa.array(sums[a, b]),
    })


def distances(audit: Audit) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language, the farthest first."""
    size = BLOCK
    blocks = F.explode(F.sequence(F.lit(0), divide(F.col("sources") - 1, F.lit(size)).cast("int"))).alias("block")
    shard = F.pmod(F.xxhash64("term"), F.col("shards").cast("long")).cast("int").alias("shard")
    cells = audit.terms.select("lang", shard, blocks, "term", "place", "p")
    sides = audit.groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    # New names, for both sides of the cogroup come from the same written table.
    sides = sides.select(F.col("lang").alias("in_lang"), F.col("shard").alias("in_shard"), blocks, "source", F.col("place").alias("at"), "p0")
    both = cells.groupBy("lang", "shard", "block").cogroup(sides.groupBy("in_lang", "in_shard", "block"))
    sums = both.applyInArrow(lambda key, cells, groups: _block_sums(key, cells, groups, size), "lang string, source string, item string, value long")
    return _ranked(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def divergence(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, least: int = LEAST_DOCUMENTS, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` holds distances, part `term` telling terms."""
    audit = Audit(df, text, lang, source, least)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = distances(audit).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(telling_terms(audit, top).withColumn("part", F.lit("term")).select(*columns))
