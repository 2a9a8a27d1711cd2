"""Language identification by rank-order n-gram profiles (out-of-place distance).

A language's profile is the list of its most frequent character n-grams, most frequent first. A
document's own list is made in the same way, and its distance to a language is the sum over its
n-grams of how far each stands from its place in the profile; an n-gram that the profile lacks
counts as PROFILE places. The language at the smallest distance is the answer.

Defined results
* Null text, empty text and text without a letter: `und`, score 0.
* Nothing learned (empty table, no labelled text with letters): `und`, score 0, for every text.
* Ties between languages: the smaller language code. Ties between n-grams: the smaller n-gram.
* Repeated rows are repeated in the result; a null id or label does not matter to a prediction.
* Columns `lang_pred` and `score` of the input are replaced; all its other columns stay.
* Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import workers_import

#: n-grams kept per language and per document; penalty of a missing one.
PROFILE = 400
#: Languages are bounded, because their profiles go to every executor: 1,000 profiles are 6 MB.
MOST_LANGUAGES = 1_000
#: n-grams that training gathers before it adds equal ones up.
FLUSH = 1_000_000

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str) -> np.ndarray:
    """All n-grams of 1 to 3 characters of the lower-cased words, as numbers.

    A word is a run of letters with one blank on each side; no n-gram has a blank in the middle.
    A character takes 21 bits, and blank is 0. Marks in the third character tell lengths apart:
    1 and 2 there are control characters, never letters.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(_letters()[points], points, 0).astype(np.uint64)
    padded = np.zeros(len(points) + 2, dtype=np.uint64)
    padded[1:-1] = points
    inside = padded != 0
    padded = padded[np.concatenate(([True], inside[1:] | inside[:-1]))]
    if len(padded) < 3:
        return padded[:0]
    ones = padded[padded != 0] | np.uint64(2 << 42)
    twos = (padded[:-1] << np.uint64(21)) | padded[1:] | np.uint64(1 << 42)
    threes = (padded[:-2] << np.uint64(42)) | (padded[1:-1] << np.uint64(21)) | padded[2:]
    return np.concatenate((ones, twos, threes[padded[1:-1] != 0]))


def most_frequent(text: str, size: int = PROFILE) -> np.ndarray:
    """The text's n-grams, most frequent first, at most `size`."""
    found, counts = np.unique(ngrams(text), return_counts=True)
    return found[np.lexsort((found, -counts))[:size]]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, ngram, n): n-grams of the texts, added up as far as memory is bounded."""
    held: dict[str, list[np.ndarray]] = {}
    kept = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            found, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(counts.astype(np.int64))],
                names=["lang", "ngram", "n"],
            )
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            part = ngrams(text.as_py())
            held.setdefault(lang.as_py(), []).append(part)
            kept += len(part)
            if kept > FLUSH:
                yield from flush()
                kept = 0
    yield from flush()


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """Profiles (lang, ngram, place) from all rows that have text and language.

    Tasks add up what they read, Spark adds up the tasks, and the rank keeps `size` n-grams of each
    language in every task before the shuffle.
    """
    workers_import(labelled.sparkSession)
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    counts = (
        rows.mapInArrow(_gather, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "ngram"))
    return counts.withColumn("place", place).filter(F.col("place") <= size).select("lang", "ngram", "place")


class Model:
    """Profiles as one sorted list of n-grams with a column of places for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.known = np.array(sorted({r[1] for r in rows}), dtype=np.uint64)
        self.places = np.full((len(self.known) + 1, len(self.langs)), -1, dtype=np.int64)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, ngram, place in rows:
            self.places[np.searchsorted(self.known, np.uint64(ngram)), at[lang]] = place - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        own = most_frequent(text, self.size)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = 0
        at[self.known[at] != own] = len(self.known)  # the last row: in no profile
        places = self.places[at]
        apart = np.abs(places - np.arange(len(own))[:, None])
        distance = np.where(places < 0, self.size, apart).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(own))


def collect_model(profiles: DataFrame, size: int = PROFILE) -> Model:
    """The profiles on the driver: at most MOST_LANGUAGES times `size` rows, or an error."""
    rows = profiles.limit(MOST_LANGUAGES * size + 1).collect()
    if len(rows) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; their profiles are not for a broadcast")
    return Model([tuple(r) for r in rows], size)


def prediction(model: Model, text: Column | str) -> Column:
    """A column struct<lang_pred, score> of the text alone."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for text in texts:
            lang, score = model.predict(text.as_py())
            langs.append(lang)
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return predict(text)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    workers_import(df.sparkSession)
    return df.withColumn("_language", prediction(model, F.col(text))).select(
        *[c for c in df.columns if c not in ("lang_pred", "score")], "_language.lang_pred", "_language.score"
    )
