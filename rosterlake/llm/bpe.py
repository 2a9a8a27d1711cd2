"""Encoding and decoding by BPE with a lexicon of frequent words in a minimal acyclic transducer.

The words of the whole collection are counted, and the frequent ones are compiled, with their token
ids, into one automaton in which words share their beginnings and, since equal states are merged,
their endings as well. Each arc carries a number; the numbers along a word's path add up to the
word's place in a table of ids. The automaton is a flat file that Spark brings to each executor
once; workers memory-map it. A batch's words walk through it together, one byte a step. Words that
it lacks are merged exactly by the vocabulary's merges.

Defined results
* Null text counts as empty: no ids, and decoding gives the empty text.
* Strings of special tokens in a text are single ids, as in the tokenizer's default.
* Decoding skips ids that the vocabulary lacks, and joins the tokens by blanks when the vocabulary
  names no decoder.
* Texts of any length are encoded whole; repeated rows repeat; empty tables give empty results.
* Output columns replace input columns of the same name.
"""

from __future__ import annotations

import json
import mmap
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlake.llm.common import PieceArrays, chunks, let_go, workers_import
from rosterlake.llm.prefix_tokens import beyond_plain, byte_letters, class_of
from rosterlake.session import new_path, written

VOCABULARY = "word_bpe_49k.json"
#: Words in the lexicon at most: some megabytes, whatever the collection.
LEXICON = 100_000
#: Longest lexicon word in bytes; longer ones are merged.
LONGEST = 40
#: Words that a worker remembers, and words a task counts before it passes them on.
MOST_WORDS, FLUSH = 150_000, 150_000


class WordTokenizer:
    """The vocabulary's own steps: normalise, cut into words, merge."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            given = json.load(f)
        special = [t["content"] for t in given["added_tokens"] if t["special"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.specials = {t["content"]: t["id"] for t in given["added_tokens"] if t["special"]}
        self.letters = {b: c for c, b in byte_letters().items()}
        letter, number, space = class_of("L"), class_of("N"), class_of("space")
        self.plain = re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{space}{letter}{number}]+")

    def words(self, text: str) -> list[str]:
        if beyond_plain(text):
            text = self.tokenizer.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.plain.findall(text.lower())  # below PLAIN nothing else is normalised

    def split(self, text: str | None) -> list[list[str] | str]:
        """Lists of words, and between them strings of special tokens."""
        parts = self.special.split(text or "")
        return [self.words(p) if i % 2 == 0 else p for i, p in enumerate(parts)]

    def merged(self, word: str) -> list[int]:
        """The ids of a word, or of a special token's string, by the vocabulary's merges."""
        special = self.specials.get(word)
        if special is not None:
            return [special]
        written = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.tokenizer.model.tokenize(written)]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def vocabulary(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def count_words(df: DataFrame, text: str = "text", *, path: str | None = None) -> DataFrame:
    """(word, n) over all texts: tasks add up what they read, Spark adds up the tasks."""
    workers_import(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = word_tokenizer(path or vocabulary())
        held: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                for part in t.split(value.as_py())[::2]:
                    held.update(part)
                if len(held) > FLUSH:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(held, pa.string()), "n": pa.array(held.values(), pa.int64())})
        del t, held
        let_go(word_tokenizer)

    return df.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, size: int = LEXICON) -> list[str]:
    """The words that occur at least so often that no more than `size` do, in byte order.

    Words longer than LONGEST bytes are left out. Only the numbers of words for each count, and then
    the chosen words, reach the driver.
    """
    counts = written(counts.filter(F.octet_length("word") <= LONGEST), "word-counts")
    total, least = 0, None
    # Counts below 64 stand alone, higher ones in steps of an eighth: a few hundred rows.
    step = F.floor(F.log2("n")) - 3
    level = F.when(F.col("n") < 64, F.col("n")).otherwise((F.floor(F.col("n") / F.pow(2.0, step)) * F.pow(2.0, step)).cast("long"))
    for level, words in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += words
        if total > size:
            break
        least = level
    if least is None:
        return []
    return sorted((r.word for r in counts.filter(F.col("n") >= least).select("word").collect()), key=str.encode)


class Lexicon:
    """The automaton as flat arrays. Arcs are sorted by (state, byte); state 0 is the start."""

    FIELDS = (("arcs", np.int64), ("target", np.int32), ("add", np.int32), ("final", np.uint8), ("first", np.int32), ("ids", np.int32))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compiled(cls, words: list[str], ids: list[list[int]]) -> Lexicon:
        """From words in byte order: a state is frozen once no further word passes through it, and
        becomes the same as a frozen one with equal arcs."""
        frozen: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, target), ...))
        path: list[list] = [[False, []]]  # open states of the previous word: final, arcs
        previous = b""

        def freeze(upto: int) -> None:
            while len(path) - 1 > upto:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in frozen:
                    frozen[key] = len(states)
                    states.append(key)
                path[-1][1][-1] = (path[-1][1][-1][0], frozen[key])

        for word in map(str.encode, words):
            same = 0
            while same < min(len(word), len(previous)) and word[same] == previous[same]:
                same += 1
            freeze(same)
            for b in word[same:]:
                path[-1][1].append((b, -1))
                path.append([False, []])
            path[-1][0] = True
            previous = word
        freeze(0)
        states.append((path[0][0], tuple(path[0][1])))
        start = len(states) - 1
        below: list[int] = []  # words that end in or after each state; targets come before their sources
        for final, arcs in states:
            below.append(final + sum(below[t] for _, t in arcs))
        number = lambda s: start - s  # noqa: E731  the start becomes 0
        arcs, target, add = [], [], []
        for s in range(start, -1, -1):
            passed = int(states[s][0])
            for b, t in states[s][1]:
                arcs.append(number(s) << 8 | b)
                target.append(number(t))
                add.append(passed)
                passed += below[t]
        lengths = [len(x) for x in ids]
        return cls({
            "arcs": np.array(arcs, dtype=np.int64),
            "target": np.array(target, dtype=np.int32),
            "add": np.array(add, dtype=np.int32),
            "final": np.array([states[s][0] for s in range(start, -1, -1)], dtype=np.uint8),
            "first": np.concatenate(([0], np.cumsum(lengths))).astype(np.int32),
            "ids": np.array([i for x in ids for i in x], dtype=np.int32),
        })

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, name) for name, _ in self.FIELDS]
        head = np.array([len(a) for a in arrays], dtype=np.int64).tobytes()
        return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)

    @classmethod
    def mapped(cls, file: str) -> Lexicon:
        """The file's arrays, read through a memory map that the workers of a machine share."""
        with open(file, "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        lengths = np.frombuffer(held, dtype=np.int64, count=len(cls.FIELDS))
        arrays, at = {}, lengths.nbytes
        for (name, kind), n in zip(cls.FIELDS, lengths.tolist()):
            arrays[name] = np.frombuffer(held, dtype=kind, count=n, offset=at)
            at += arrays[name].nbytes + -arrays[name].nbytes % 8
        return cls(arrays)

    def places(self, words: list[str]) -> np.ndarray:
        """The place of each word in the table of ids, or -1. All words take a step at a time."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(w) for w in raw], dtype=np.int64)
        found = np.full(len(raw), -1, dtype=np.int64)
        if not len(self.arcs):
            return found
        width = min(LONGEST, int(lengths.max(initial=0)))
        letters = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in raw), dtype=np.uint8).reshape(-1, width)
        rows = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        state, place = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for i in range(width):
            key = state << 8 | letters[rows, i]
            arc = np.searchsorted(self.arcs, key)
            arc[arc == len(self.arcs)] = 0
            on = self.arcs[arc] == key
            rows, arc = rows[on], arc[on]
            state, place = self.target[arc].astype(np.int64), place[on] + self.add[arc]
            ended = lengths[rows] == i + 1
            good = ended & (self.final[state] == 1)
            found[rows[good]] = place[good]
            rows, state, place = rows[~ended], state[~ended], place[~ended]
        return found


def build_lexicon(df: DataFrame, text: str = "text", *, path: str | None = None, size: int = LEXICON) -> str:
    """Count, compile, and hand the file to Spark; returns the file's name for SparkFiles."""
    spark = df.sparkSession
    words = frequent_words(count_words(df, text, path=path), size)
    t = word_tokenizer(path or vocabulary())
    lexicon = Lexicon.compiled(words, [t.merged(w) for w in words])
    return _share(spark, lexicon.to_bytes())


def _share(spark: SparkSession, content: bytes) -> str:
    """Write the bytes once to the shared folder; executors fetch them from there through Spark."""
    name = f"lexicon-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{new_path(spark, 'lexicon')}/{name}")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString())
    return name


class Encoder:
    def __init__(self, path: str, lexicon: Lexicon):
        self.words = word_tokenizer(path)
        self.lexicon = lexicon
        self.known = PieceArrays(MOST_WORDS)

    def learn(self, words: Iterable[str]) -> None:
        new = list(self.known.missing(words))
        if not new:
            return
        lengths: list[int] = []
        values: list[int] = []
        first, ids = self.lexicon.first, self.lexicon.ids
        for word, place in zip(new, self.lexicon.places(new).tolist()):
            own = ids[first[place] : first[place + 1]].tolist() if place >= 0 else self.words.merged(word)
            lengths.append(len(own))
            values += own
        self.known.add(new, lengths, values)

    def many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; new words of some texts are looked up together."""
        for group in chunks(t or "" for t in texts):
            parts = [self.words.split(t) for t in group]
            self.learn(set().union(*[[x] if isinstance(x, str) else x for of_text in parts for x in of_text]))
            for of_text in parts:
                flat = of_text[0] if len(of_text) == 1 else [w for x in of_text for w in ([x] if isinstance(x, str) else x)]
                yield self.known.joined(self.known.numbers(flat))[0]


@lru_cache(maxsize=1)
def encoder(path: str, lexicon: str) -> Encoder:
    """One encoder for each worker process, vocabulary and lexicon."""
    return Encoder(path, Lexicon.mapped(SparkFiles.get(lexicon)))


def _ids(texts: pa.Array, path: str, lexicon: str) -> pa.ListArray:
    found = list(encoder(path, lexicon).many(t.as_py() for t in texts))
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def encode(df: DataFrame, lexicon: str, text: str = "text", *, path: str | None = None, name: str = "ids") -> DataFrame:
    """df with the text's token ids."""
    workers_import(df.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _ids(texts, path or vocabulary(), lexicon)
        let_go(encoder, word_tokenizer)

    # Not to be repeated by the optimiser for every use of the column, such as decoding it again.
    return df.withColumn(name, ids.asNondeterministic()(F.col(text)))


class Decoder:
    """Joins tokens; the library's tokenizer is only kept where a list of tokens is not enough."""

    def __init__(self, path: str):
        self.path = path
        tokenizer = Tokenizer.from_file(path)
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.token = [tokenizer.id_to_token(i) for i in range(size)]
        self.plain = tokenizer.decoder is None and all(t is not None for t in self.token)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def decode(self, ids: np.ndarray) -> str:
        if not self.plain or (len(ids) and (ids.min() < 0 or ids.max() >= len(self.token))):
            return self.tokenizer.decode([i for i in ids.tolist() if i >= 0], skip_special_tokens=False)
        return " ".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _texts(arrays: pa.ListArray, path: str) -> pa.Array:
    d = decoder(path)
    values = arrays.values.to_numpy(zero_copy_only=False)
    ends = arrays.offsets.to_numpy()
    valid = arrays.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([d.decode(values[a:b]) if v else None for a, b, v in zip(ends, ends[1:], valid)], pa.string())


def decode(df: DataFrame, ids: str = "ids", *, path: str | None = None, name: str = "decoded") -> DataFrame:
    """df with the text that the ids stand for; null ids give null."""
    workers_import(df.sparkSession)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arrays in batches:
            yield _texts(arrays, path or vocabulary())
        let_go(decoder)

    return df.withColumn(name, text(F.col(ids)))


def encode_and_decode(
    df: DataFrame, lexicon: str, text: str = "text", *, path: str | None = None, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """df with the text's token ids and the text that these stand for, both by one worker for each task.

    encode and then decode keep two workers for a task, which Spark goes on using in turn for all that follows.
    """
    workers_import(df.sparkSession)

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = _ids(texts, path or vocabulary(), lexicon)
            yield pa.StructArray.from_arrays([found, _texts(found, path or vocabulary())], names=["ids", "decoded"])
        let_go(encoder, word_tokenizer, decoder)

    beside = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (ids.lower(), decoded.lower())]
    own = "_" + max(df.columns, key=len)  # longer than every other name, so there is none like it
    coded = df.select(*beside, both.asNondeterministic()(F.col(text)).alias(own))
    return coded.select(*beside, F.col(f"`{own}`.ids").alias(ids), F.col(f"`{own}`.decoded").alias(decoded))


def digests(coded: DataFrame, *keys: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """keys, n_tokens, and the SHA-256 of the ids (decimal, joined by a blank) and of the decoded text."""
    joined = F.array_join(F.col(ids).cast("array<string>"), " ")
    return coded.select(
        *keys,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    )
