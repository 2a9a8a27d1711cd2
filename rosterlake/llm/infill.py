"""Fill-in-the-middle: texts re-ordered so that a model learns to write what stands between two parts.

One full match of a repeated group gives every unit of a text at once: the regex library keeps all
repetitions of a group, so the list of their ends is the number of units and holds both cut offsets. The
quantifiers are possessive, since units never need to be given back; a text of any length is matched
without a stack of alternatives.

Two draws from a hash of the document's id place the cuts between units. Prefix, middle and suffix are
written in the order prefix, suffix, middle (`psm`) or suffix, prefix, middle (`spm`), each after its mark.
No draw depends on partitions, so a lost task that runs again gives the same rows.

Defined results
* Null text counts as empty. An empty text has no unit and stays `plain`, as does a text that holds a
  mark, or that the draw leaves out.
* A null id is hashed as the empty string.
* Prefix, middle or suffix may be empty; one unit may be a whole, very long text.
* Repeated rows repeat; rows with the same id and text get the same cuts.
* The column `infill` is replaced, all others stay, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.common import workers_import

#: Lines with their break; the last may lack it.
LINES = r"[^\n]*+\n|[^\n]++"
SEED = 7
#: Share of the texts that are re-ordered, and the share of these whose suffix comes first, in percent.
RATE, SUFFIX_FIRST = 100, 50
#: Marks before prefix, suffix and middle; each begins with a character that it does not end with.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"

_TYPE = pa.struct([
    ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()),
])
_SCHEMA = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


def draws(seed: int, row_id: object) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 that depend on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def unit_ends(pattern: regex.Pattern, text: str) -> list[int]:
    """Where each unit ends."""
    match = pattern.fullmatch(text)
    if match is None:
        raise ValueError("the units do not cover the text")
    return match.ends(1)


def reorder(
    pattern: regex.Pattern, text: str, numbers: tuple[int, int, int, int], rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    ends = unit_ends(pattern, text)
    if not text or numbers[2] % 100 >= rate or any(mark in text for mark in MARKS):
        return len(ends), PLAIN, None, None, text
    cuts = sorted(number % (len(ends) + 1) for number in numbers[:2])
    a, b = (ends[cut - 1] if cut else 0 for cut in cuts)
    prefix, middle, suffix = (mark + part for mark, part in zip((MARKS[0], MARKS[2], MARKS[1]), (text[:a], text[a:b], text[b:])))
    if numbers[3] % 100 < suffix_first:
        return len(ends), SPM, a, b - a, suffix + prefix + middle
    return len(ends), PSM, a, b - a, prefix + suffix + middle


def fill_in_middle(
    df: DataFrame,
    row_id: str,
    text: str = "text",
    *,
    units: str = LINES,
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    name: str = "infill",
) -> DataFrame:
    """df with struct<n, form, prefix_chars, middle_chars, output>.

    `units` is a pattern without groups of its own, whose repetition covers every text.
    """
    workers_import(df.sparkSession)

    @F.arrow_udf(_SCHEMA)
    def made(ids: pa.Array, texts: pa.Array) -> pa.Array:
        pattern = regex.compile(f"({units})*+")
        rows = (reorder(pattern, t.as_py() or "", draws(seed, i.as_py()), rate, suffix_first) for i, t in zip(ids, texts))
        columns = list(zip(*rows)) or [()] * len(_TYPE)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TYPE)], fields=list(_TYPE))

    return df.withColumn(name, made(F.col(row_id).cast("string"), F.col(text)))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from, by the places of its marks alone.

    No mark stands in a text, and none can arise where a part meets a mark.
    """
    prefix, suffix, middle = MARKS
    before = F.substring_index(output, middle, 1)
    after = F.substring_index(output, middle, -1)
    psm = (F.substring_index(before, prefix, -1), F.substring_index(before, suffix, -1))
    of_psm = F.concat(F.substring_index(psm[0], suffix, 1), after, psm[1])
    of_spm = F.concat(psm[0], after, F.substring_index(psm[1], prefix, 1))
    return F.when(form == PSM, of_psm).when(form == SPM, of_spm).otherwise(output)
