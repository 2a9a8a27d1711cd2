"""Secret scans: exact patterns, and character Markov models for strings that no pattern names.

Base kinds are found by pattern. Beside them, every run of 16 or more characters that a key may
consist of is weighed outside base spans: the log-likelihood of each character under a model of random
strings, less that under a model of ordinary identifiers and words. Where these ratios add up, in one
stretch, to a clear sum over what is asked of each pair, a secret of kind `random` is marked, from one
sign (or run's end) to another, with neighbouring parts that mix classes. The path or name around a key
is no part of the stretch, so it does not hide the key.

The ordinary model is a chain of the next character given this one, trained on labelled runs only: those
whose parts between signs are all words (one case, or a capital first) or numbers of fewer than 16
characters. A key is too long or too mixed for that, so no number of keys makes keys ordinary. Letters
of both cases share their counts, and every chance has a fixed share of its class's even chance, so no
ratio grows with the collection. There are several random models: even draws from the usual alphabets
of keys, and the chain of what the base patterns match. Counts are added up over all documents; a model
is a table of 69 times 69 counts, whatever the collection.

Defined results
* Null text counts as empty: no spans.
* Spans count code points, the end is exclusive; within a text they stand in order of start and then
  of kind (assign, access, hex, random). A `random` span never overlaps a base span.
* Texts of any length are read whole; repeated rows repeat.
* Digits alone are ordinary, however many.
* Without any labelled runs there is no ordinary model, and no `random` span is found.
* Columns `spans` (or `text` and `n_chars` in `redact`) are replaced, all others stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import workers_import

KINDS = ("assign", "access", "hex", "random")
#: Least length of a run that is weighed; what is asked of each pair (nats); and the least sum beyond it,
#: which also ends a stretch when the sum has fallen by so much.
SHORTEST, RATIO, SUM = 16, 0.3, 11.0
#: Pairs that a stretch needs: a key's ends may look ordinary.
LEAST_PAIRS = 10
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
STATES = len(LETTERS) + 1  # the last: anything else
#: The first 62 states are letters and digits, in three classes; the rest are signs.
N_PLAIN, _CLASSES = 62, ((0, 26), (26, 52), (52, 62))
_UPPER, _LOWER, _DIGIT = LETTERS[:26], LETTERS[26:52], LETTERS[52:62]
#: Alphabets of keys: of one class, hex, letters or digits in one case, letters, all.
ALPHABETS = (
    _UPPER, _LOWER, _DIGIT + b"ABCDEF", _DIGIT + b"abcdef", _UPPER + _DIGIT, _LOWER + _DIGIT, _UPPER + _LOWER, _UPPER + _LOWER + _DIGIT,
)
#: The even chance's share in each chain, and its weight in characters before any is seen.
EVEN, PRIOR = 0.1, 20
#: The ratio of a pair with a sign in it: paths and names have more signs than keys.
SIGN = -1.0
#: Chances of upper case, lower case and digits after each, half fixed and half counted.
CHANGES = ((0.45, 0.45, 0.1), (0.04, 0.9, 0.06), (0.075, 0.075, 0.85))

# The scans run on UTF-8 bytes, whose ASCII letters alone change case; offsets are turned into code points.
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")  # the same as runs of any length with the shorter ones dropped
_RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % SHORTEST)
_SIGN = re.compile(rb"[/_.=-]")  # without +, which stands in keys alone
#: A change of class other than after a capital; no labelled run holds one, nor a part as long as a key.
_CHANGE = re.compile(rb"[a-z][A-Z0-9]|[0-9][A-Za-z]|[A-Z][0-9]|[A-Z]{2}[a-z]")
_MIXED = re.compile(rb"%b|[A-Za-z0-9]{%d}" % (_CHANGE.pattern, SHORTEST))

_CODE = np.full(256, STATES - 1, dtype=np.int64)
_CODE[np.frombuffer(LETTERS, dtype=np.uint8)] = np.arange(len(LETTERS))


def base_spans(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the secret itself) in bytes, sorted."""
    found = [(m.start(), m.end(), 0, m.start(1)) for m in _ASSIGN.finditer(raw.lower()) if m.end() - m.start(1) >= 8]
    found += [(m.start(), m.end(), 1, m.start()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2, m.start()) for m in _HEX.finditer(raw)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _pairs(codes: np.ndarray) -> np.ndarray:
    """Counts of (character, next character) between characters of the alphabet."""
    first, second = codes[:-1], codes[1:]
    inside = (first < STATES - 1) & (second < STATES - 1)
    return np.bincount(first[inside] * STATES + second[inside], minlength=STATES * STATES)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(random, pair, n): counts of this task, from spans of the base kinds and from labelled ordinary runs."""
    counts = np.zeros((2, STATES * STATES), dtype=np.int64)
    for batch in batches:
        for value in batch.column(0):
            raw = value.as_py().encode()
            codes = _CODE[np.frombuffer(raw, dtype=np.uint8)]
            run = np.cumsum(codes == STATES - 1)  # the number of each character's run
            mixed = [m.start() for m in _MIXED.finditer(raw)]
            done = 0
            for _, end, _, start in base_spans(raw):
                start = max(start, done)
                if end > start:
                    counts[1] += _pairs(codes[start:end])
                    mixed.append(start)
                    done = end
            if mixed:
                left_out = np.zeros(run[-1] + 1, dtype=bool)
                left_out[run[mixed]] = True
                codes[left_out[run]] = STATES - 1
            counts[0] += _pairs(codes)
    for label in (0, 1):
        at = np.flatnonzero(counts[label])
        yield pa.RecordBatch.from_pydict({"random": pa.array([label] * len(at), pa.int32()), "pair": pa.array(at, pa.int32()), "n": pa.array(counts[label][at], pa.int64())})


def _ordinary(counts: np.ndarray) -> np.ndarray:
    """Chances of the next of the 62 letters and digits, given one."""
    upper, lower, digit = (slice(a, b) for a, b in _CLASSES)
    counts = counts[:N_PLAIN, :N_PLAIN]

    def chain(n: np.ndarray) -> np.ndarray:
        even = 1 / n.shape[1]
        return (1 - EVEN) * (n + PRIOR * even) / (n.sum(axis=1, keepdims=True) + PRIOR) + EVEN * even

    letters = chain(counts[upper, upper] + counts[upper, lower] + counts[lower, lower])
    chances = np.empty((N_PLAIN, N_PLAIN))
    for i, (a, change) in enumerate(zip((upper, lower, digit), CHANGES)):
        n = np.array([counts[a, b].sum() for b in (upper, lower, digit)])
        change = (np.array(change) + (n + PRIOR * np.array(change)) / (n.sum() + PRIOR)) / 2
        for j, b in enumerate((upper, lower, digit)):
            within = letters if (i, j) in ((0, 0), (0, 1), (1, 1)) else chain(counts[a, b]) if i == j else 1 / (b.stop - b.start)
            chances[a, b] = change[j] * within
    return chances


def train(df: DataFrame, text: str = "text") -> np.ndarray:
    """For each random model, the log-likelihood ratio of each pair of characters, flat, from all texts."""
    workers_import(df.sparkSession)
    rows = df.select(text).filter(F.col(text).isNotNull()).mapInArrow(_samples, "random int, pair int, n long")
    counts = np.zeros((2, STATES * STATES))
    for random, pair, n in rows.groupBy("random", "pair").agg(F.sum("n")).collect():  # 2 * 69 * 69 at most
        counts[random, pair] += n
    plain, found = counts.reshape(2, STATES, STATES)
    ratios = np.zeros((len(ALPHABETS) + 1, STATES, STATES))
    if not plain[:N_PLAIN, :N_PLAIN].any():
        return ratios.reshape(len(ratios), -1)
    # The samples may know one alphabet only (say, hex digits): half of their model is uniform.
    found = found[:N_PLAIN, :N_PLAIN] + 1
    random = [np.broadcast_to((found / found.sum(axis=1, keepdims=True) + 1 / N_PLAIN) / 2, (N_PLAIN, N_PLAIN))]
    for alphabet in ALPHABETS:
        own = np.isin(np.arange(N_PLAIN), _CODE[np.frombuffer(alphabet, dtype=np.uint8)])
        random.append(np.broadcast_to(np.where(own, 0.99 / own.sum(), 0.01 / max(1, N_PLAIN - own.sum())), (N_PLAIN, N_PLAIN)))
    ratios[:, :-1, :-1] = SIGN
    ratios[:, :N_PLAIN, :N_PLAIN] = np.log(np.stack(random) / _ordinary(plain))
    return ratios.reshape(len(ratios), -1)


def _stretches(ratios: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) character of each stretch whose ratios add up to SUM beyond RATIO for each pair."""
    total, begin, top, at = 0.0, 0, 0.0, 0
    for i, r in enumerate((ratios - RATIO).tolist(), 1):
        total += r
        if total > top:
            top, at = total, i
        if total <= 0 or total < top - SUM:
            if top >= SUM and at - begin >= LEAST_PAIRS:
                yield begin, at
            total, begin, top, at = 0.0, i, 0.0, i
    if top >= SUM and at - begin >= LEAST_PAIRS:
        yield begin, at


def _random_spans(part: bytes, ratios: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the random strings in a run, from sign to sign, sorted and apart."""
    codes = _CODE[np.frombuffer(part, dtype=np.uint8)]
    found = set()
    for of in ratios[:, codes[:-1] * STATES + codes[1:]]:
        if (of - RATIO).clip(0).sum() >= SUM:  # most runs end here
            found.update(_stretches(of))
    if not found:
        return []
    signs = [-1, *(m.start() for m in _SIGN.finditer(part)), len(part)]
    merged: list[tuple[int, int]] = []
    for first, last in sorted(found):
        done = merged[-1][1] if merged else 0
        if last < done:
            continue
        i, j = bisect_right(signs, first) - 1, bisect_left(signs, last)
        while signs[i] > done and _CHANGE.search(part, signs[i - 1] + 1, signs[i]):
            i -= 1
        while signs[j] < len(part) and _CHANGE.search(part, signs[j] + 1, signs[j + 1]):
            j += 1
        start, end = max(signs[i] + 1, done), signs[j]
        while part[end : end + 1] == b"=":  # padding
            end += 1
        if merged and start == done:
            merged[-1] = (merged[-1][0], end)
        elif end - start >= SHORTEST:
            merged.append((start, end))
    return merged


def spans(text: str | None, ratios: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, sorted."""
    raw = (text or "").encode()
    base = base_spans(raw)
    found = [s[:3] for s in base]
    i = 0
    for m in _RUN.finditer(raw):
        # The parts of the run outside base spans; both are in order, and a base span may reach over several runs.
        at, j = m.start(), i
        while j < len(base) and base[j][0] < m.end():
            if base[j][0] - at >= SHORTEST:
                found += [(at + a, at + b, 3) for a, b in _random_spans(raw[at : base[j][0]], ratios)]
            at = max(at, base[j][1])
            j += 1
        i = max(i, j - 1)
        if m.end() - at >= SHORTEST:
            found += [(at + a, at + b, 3) for a, b in _random_spans(raw[at : m.end()], ratios)]
    found.sort(key=lambda s: (s[0], s[2]))
    if len(raw) == len(text or ""):
        return found
    starts = np.frombuffer(raw, dtype=np.uint8) & 0xC0 != 0x80
    before = np.concatenate(([0], np.cumsum(starts)))
    return [(int(before[a]), int(before[b]), k) for a, b, k in found]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scan(df: DataFrame, ratios: np.ndarray, text: str = "text", *, name: str = "spans") -> DataFrame:
    """df with array<struct<start, end, kind>> of all spans."""
    workers_import(df.sparkSession)

    @F.arrow_udf("array<struct<start: bigint, end: bigint, kind: string>>")
    def find(texts: pa.Array) -> pa.Array:
        rows = [[{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in spans(t.as_py(), ratios)] for t in texts]
        return pa.array(rows, _SPAN)

    return df.withColumn(name, find(F.col(text)))


def listed(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def redact(df: DataFrame, ratios: np.ndarray, text: str = "text", *, mark: str = "[secret]") -> DataFrame:
    """df with every span of its text replaced by a mark; overlapping spans share one. Null stays null."""
    workers_import(df.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            own = value.as_py()
            merged: list[list[int]] = []
            for a, b, _ in spans(own, ratios):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in reversed(merged):
                own = own[:a] + mark + own[b:]
            out.append(own)
        return pa.array(out, pa.string())

    return df.withColumn(text, clean(F.col(text)))
