"""From raw documents to token ids: five stages, each on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns documents with their columns; the last returns, for
each document, the digests of its token ids. `run` writes each stage's result to the shared folder as
Parquet and reads it for the next. Language ID and near-dedup name their own columns so that they meet none
of the documents', whatever those are called; all of these come back as they were.

SQL cannot state MinHash candidates, Markov models, hash draws or BPE merges, so ORACLE_SQL is None; the
tests compare the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm import bpe, language, mixing, neardup, secrets
from rosterlake.session import written

#: A document whose most frequent n-grams are so far from every language is in none of them.
LEAST_SCORE = 0.1


def _free_name(docs: DataFrame, name: str) -> str:
    """The name, or the name with underscores before it, that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: null, without letters, or far from every profile.

    Profiles are learned from all rows with text and language. If there are none, only texts without
    letters go.
    """
    model = language.collect_model(language.learn(docs))
    own = _free_name(docs, "language")
    found = docs.withColumn(own, language.prediction(model, F.col("text")))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    kept = (F.col(f"{own}.lang_pred") != language.UNKNOWN) & (F.col(f"{own}.score") >= LEAST_SCORE)
    return found.filter(kept).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near duplicates (five words, 0.8) the row that comes first.

    Rows are told apart by a number, so null and repeated ids cost no other document. Texts without a
    word are linked with nothing and stay.
    """
    own = _free_name(docs, "row_number")
    numbered = written(docs.withColumn(own, F.monotonically_increasing_id()), "numbered")
    dropped = neardup.near_duplicates(numbered, own).filter("not kept").select(own)
    return numbered.join(dropped, own, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark and counts the characters anew; every document stays."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights, one row for each time that a document is taken."""
    mixed = mixing.mixed_texts(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of ids and decoded text."""
    coded = bpe.encode_and_decode(docs.select("doc_id", "source", "text"), bpe.build_lexicon(docs))
    return bpe.digests(coded, "doc_id", "source")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
