"""Document fingerprints by spot signatures (SpotSigs).

Where a common word is followed by a content word, a chain begins: the common word (the anchor) and the
next CHAIN content words, common words in between left out. Chains of running text survive edits
elsewhere in the document, and lists, menus and boilerplate without common words give few. A
document's fingerprint is the set of its chains' hashes; likeness is the Jaccard similarity of sets.
The anchors are the collection's own most frequent words.

`similar_pairs` finds all pairs of different fingerprints at a threshold: sets are partitioned by
length so that only partitions whose lengths allow the threshold meet, each set is indexed by its
rarest chains only, as many as are needed for two similar sets to share one, and pairs are pruned by
their lengths before the exact comparison. Only DataFrame functions are used.

Defined results
* Null text counts as empty. A text without a word has no chain; if it is not empty, the hash of the
  whole text is its only entry, and so for one of common words only. The empty text's set is empty.
* The start of a text counts as an anchor. A chain that the text's end cuts off is kept as it is.
* Likeness of two empty sets is 1, of an empty and another one 0.
* A fingerprint is the sorted hashes in decimal, joined by blanks; equal texts have equal ones.
* Texts of any length are read whole. Repeated rows are one document in the order of ids and share its
  result; each is returned. Null ids come last in the order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.operators.numbering import number_rows
from rosterlake.session import written

ANCHORS, CHAIN = 64, 2
#: Rows of (id, place) of at most so many are sent to all executors; more are joined by shuffling texts.
BROADCAST_ROWS = 500_000
#: The sign for a text's start among the anchors; no word is like it.
START = "^"


def normalised(text: Column) -> Column:
    """The start sign and the lower-cased words, joined by single blanks.

    Signs that touch a word are left out. Signs that stand alone, such as the bars of a list, are words:
    where they are frequent they serve as anchors in texts that have few others.
    """
    words = F.regexp_replace(F.lower(text), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?=[\p{L}\p{N}])", " ")
    return F.concat(F.lit(START), F.regexp_replace(F.concat(F.lit(" "), words), r"\s+", " "))


def common_words(df: DataFrame, text: str = "text", *, size: int = ANCHORS) -> list[str]:
    """The most frequent words of all texts; `size` of them reach the driver. Ties: by code point."""
    words = df.select(F.explode(F.split(normalised(F.col(text)), " ")).alias("word"))
    counts = words.filter(~F.col("word").isin("", START)).groupBy("word").count()
    return [r.word for r in counts.orderBy(F.desc("count"), "word").limit(size).collect()]


def _sections(text: Column, anchors: list[str]) -> Column:
    """Each anchor with the content words up to the next one; anchors directly before others go."""
    cut = rf"(?= (?:{'|'.join(map(re.escape, anchors))})(?: |$))" if anchors else "(?!)"
    parts = F.transform(F.split(F.rtrim(normalised(text)), cut), lambda s: F.ltrim(s))
    return F.filter(parts, lambda s: F.instr(s, " ") > 0)


def with_spots(df: DataFrame, text: Column, anchors: list[str], name: str, *, chain: int = CHAIN) -> DataFrame:
    """df with the sorted, distinct hashes of the chains of a text."""
    at = f"_sections_{name}"
    df = df.withColumn(at, _sections(text, anchors))
    content = lambda s: F.substring(s, F.instr(s, " ") + 1, F.length(s))
    near = lambda s: F.substring_index(s, " ", chain + 1)

    def spot(section: Column, i: Column) -> Column:
        after = [F.coalesce(content(near(F.get(F.col(at), i + j))), F.lit("")) for j in range(1, chain)]
        return F.hash(F.substring_index(F.rtrim(F.concat_ws(" ", near(section), *after)), " ", chain + 1))

    whole = F.when(F.length(text) > 0, F.array(F.hash(text))).otherwise(F.array().cast("array<int>"))
    spots = F.when(F.size(at) > 0, F.sort_array(F.array_distinct(F.transform(F.col(at), spot)))).otherwise(whole)
    return df.withColumn(name, spots).drop(at)


def fingerprint(spots: Column) -> Column:
    return F.array_join(spots.cast("array<string>"), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity; pruned where one set is empty, so that nothing can be shared."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    sizes = F.size(a) + F.size(b)
    return F.when(sizes == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (sizes - common))


def successors(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, same, next_id, next_same, quarter): each different row's next in order of ids, the first after the last.

    `same` is a hash of the text; quarter is the number of code points that an edit replaces.
    """
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("same"), F.floor(F.char_length(F.coalesce(F.col(text), F.lit(""))) / 4).alias("quarter")).distinct()
    placed = number_rows(rows, [F.col("id").asc_nulls_last(), F.col("same")], "place", 0, costly=True)
    placed = written(placed, "places")
    total = max(1, placed.count())
    after = placed.select(F.col("id").alias("next_id"), F.col("same").alias("next_same"), F.pmod(F.col("place") - 1, F.lit(total)).alias("place"))
    return written(placed.join(after, "place").select("id", "same", "quarter", "next_id", "next_same", "place"), "successors")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, anchors: list[str] | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text is the own one with its last quarter replaced by the beginning of the next document.
    A document's own chains are worked out where its text is read; then its text goes to one place, and
    to the place of its predecessor only the beginning that is needed there and the chains.
    """
    anchors = common_words(df, text) if anchors is None else anchors
    after = successors(df, id_col, text)
    few = after.count() <= BROADCAST_ROWS
    after = F.broadcast(after) if few else after
    base = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("same"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    same_row = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    own = base.join(after.select(F.col("id").alias("_id"), F.col("same").alias("_same"), "place", "quarter"), same_row("id", "_id") & same_row("same", "_same"))
    own = own.select("id", "place", "text", "quarter")
    following = after.select(F.col("next_id").alias("_id"), F.col("next_same").alias("_same"), F.col("place"), F.col("quarter"))
    first = base.join(following, same_row("id", "_id") & same_row("same", "_same"))
    first = with_spots(first.select("place", "quarter", "text"), F.col("text"), anchors, "next_spots")
    first = first.select("place", F.substring("text", F.lit(1), F.col("quarter").cast("int")).alias("begin"), "next_spots")
    if df.count() > after.count():  # equal rows count once as a successor
        first = first.dropDuplicates(["place"])
    joined = own.join(first, "place")
    n = F.char_length("text")
    joined = joined.withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - F.col("quarter")).cast("int")), F.col("begin")))
    joined = with_spots(joined, F.col("text"), anchors, "spots")
    joined = with_spots(joined, F.col("edited"), anchors, "edited_spots")
    return joined.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness("spots", "edited_spots").alias("near_edited"),
        likeness("spots", "next_spots").alias("near_next"),
    )


def similar_pairs(spotted: DataFrame, threshold: float = 0.8, *, id_col: str = "id", spots: str = "spots") -> DataFrame:
    """(a, b, likeness) of different non-empty sets at the threshold; a and b are the smallest ids of their sets."""
    sets = spotted.filter(F.size(spots) > 0).groupBy(F.col(spots).alias("own")).agg(F.min(id_col).alias("id"))
    sets = written(sets.withColumn("n", F.size("own")), "spot-sets")
    rarity = sets.select(F.explode("own").alias("spot")).groupBy("spot").count()
    ranked = sets.select("id", "n", F.explode("own").alias("spot")).join(rarity, "spot")
    order = Window.partitionBy("id").orderBy("count", "spot")  # a set's own chains, as many as its text has
    needed = F.col("n") - F.ceil(F.col("n") * threshold) + 1
    index = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= needed)
    # Lengths in steps of 1/threshold: similar sets are in one partition or in neighbouring ones.
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)))
    index = written(index.select("id", "n", "spot", level.alias("level")), "spot-index")
    lower = index.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "spot", "level")
    upper = index.select(
        F.col("id").alias("b"), F.col("n").alias("n_b"), "spot", F.explode(F.array(F.col("level"), F.col("level") - 1)).alias("level")
    )
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    pairs = lower.join(upper, ["spot", "level"]).filter(ordered & (F.col("n_a") >= F.col("n_b") * threshold)).select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("own").alias("_b")), "b"
    )
    return both.withColumn("likeness", likeness("_a", "_b")).filter(F.col("likeness") >= threshold).select("a", "b", "likeness")
