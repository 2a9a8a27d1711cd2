"""Mixing sources to target weights, from fixed-length blocks of words.

Every source's documents form one stream, in an order given by a hash; the stream is cut into blocks of
BLOCK_WORDS words. The mix consists of output shards with SLOTS_PER_SHARD slots. For each shard the
numbers of slots per source are drawn from a multinomial distribution whose chances are the target
weights. A source's slots, numbered over all shards, are mapped to its blocks by a pseudorandom
permutation of block numbers, a new one for every pass through the source, and slots and blocks meet in
an equi-join on (source, block). The draws scatter around the targets, so slots that a source has drawn
beyond its quota go to the sources that have drawn too few; the last slot of a source is cut to the
words still missing.

Draws and permutations come from hashes of numbers and names: reruns and retried tasks agree. Sums
along a stream are taken in two steps (a hash slice's own, and the slices before it), so that no task
holds a source. Only DataFrame functions are used.

Weights: sources in code point order, null last, weigh 5, 2, 1, repeating, and share `share` of all
words; a target stops at `most` times its source, the excess being shared anew by weight.

Defined results
* Null or empty text, or one of white space: size 0, takes nothing, and is not in the mixed texts.
* A null source is a source of its own. Null and repeated ids do not matter; repeated rows are
  documents of their own.
* An empty table gives an empty mix. Texts of any length count whole; a long one covers many blocks.
* A document is taken at most `most` times (rounded up), since each pass takes each block once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.common import WORD
from rosterlake.operators.numbering import number_lookup
from rosterlake.operators.skew import lookup_join
from rosterlake.session import written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK_WORDS, SLOTS_PER_SHARD = 512, 4096
#: Multipliers of the permutations: primes, of which the first that does not divide the number of
#: blocks is taken, starting at a place that depends on the source. Small enough that a product with
#: 2^41 block numbers fits a long.
PRIMES = (2_097_143, 2_097_133, 2_097_131, 2_097_097, 2_097_091, 2_097_083, 2_097_047, 2_097_041)
#: Bins in which the sources' shares of the draws are looked up.
BINS = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, source, rows, total, target) of each source, written. sized: (key, source, size)."""
    sums = sized.groupBy("key", "source").agg(F.count("*").alias("rows"), F.sum("size").alias("total"))
    numbered = number_lookup(written(sums, "sources"), [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = written(numbered.withColumn("weight", weight).withColumn("cap", (F.col("total") * most).cast("double")), "sources")
    # The level at which weight * level, cut at the caps, adds up to the share. Capping only raises it.
    level = -1.0
    while True:
        capped = F.col("cap") < F.col("weight") * level
        whole, held, open_ = sources.agg(
            F.coalesce(F.sum("total"), F.lit(0)) * share,
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)),
        ).first()
        higher = (float(whole) - held) / open_ if open_ else level
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(F.col("weight") * max(level, 0.0), F.col("cap"))).drop("place", "weight", "cap")


def _with_blocks(sources: DataFrame, most: int, block_words: int) -> DataFrame:
    """Adds blocks, slots (the quota), and the permutation's multiplier and shift."""
    blocks = F.ceil(F.col("total") / block_words)
    quota = F.least(blocks * most, F.ceil(F.col("target") * blocks / F.greatest("total", F.lit(1))))
    turn = F.pmod(F.xxhash64("key"), F.lit(len(PRIMES))).cast("int")
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES])
    turned = F.concat(F.slice(primes, turn + 1, F.lit(len(PRIMES))), F.slice(primes, F.lit(1), turn))
    free = lambda p: F.pmod(F.col("blocks"), p) != 0
    return (
        sources.withColumn("blocks", blocks.cast("long"))
        .withColumn("quota", quota.cast("long"))
        .withColumn("multiplier", F.coalesce(F.get(F.filter(turned, free), F.lit(0)), F.lit(1).cast("long")))
    )


def block_of(slot: Column) -> Column:
    """The block of a source's slot: an affine permutation of 0 … blocks - 1, shifted anew in each pass."""
    n = F.greatest(F.col("blocks"), F.lit(1))
    in_pass, turn = F.pmod(slot, n), F.floor(slot / n)
    return F.pmod(F.col("multiplier") * in_pass + F.pmod(F.xxhash64("key", turn), n), n)


def shard_plan(sources: DataFrame, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """(shard, key, slot): a multinomial draw for each shard, evened out to the quotas."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    before = Window.orderBy(F.col("key")).rowsBetween(Window.unboundedPreceding, -1)
    placed = written(sources.select("key", "quota", F.coalesce(F.sum("quota").over(before), F.lit(0)).alias("low")), "shares")
    width = max(1, -(-total // BINS))
    last = F.floor((F.col("low") + F.col("quota") - 1) / width)
    bins = placed.filter("quota > 0").withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), last)))
    drawn = spark.range(total).select(
        F.floor(F.col("id") / slots_per_shard).alias("shard"), F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(max(total, 1))).alias("draw")
    )
    drawn = lookup_join(drawn.withColumn("bin", F.floor(F.col("draw") / width)), bins, ["bin"])
    drawn = drawn.filter((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("low") + F.col("quota")))
    counts = written(drawn.groupBy("shard", "key").count(), "draws")  # multinomial counts of every shard
    earlier = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("count").over(earlier), F.lit(0))
    slots = counts.withColumn("first", first).select(
        "shard", "key", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot")
    )
    # Numbers of slots drawn beyond the quota and short of it; both add up to the same.
    sums = counts.groupBy("key").agg(F.sum("count").alias("got"))
    apart = placed.join(sums, "key", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    apart = apart.withColumn("over", F.greatest(F.col("got") - F.col("quota"), F.lit(0))).withColumn(
        "short", F.greatest(F.col("quota") - F.col("got"), F.lit(0))
    )
    for c in ("over", "short"):
        apart = apart.withColumn(f"{c}_low", F.coalesce(F.sum(c).over(before), F.lit(0)))
    apart = written(apart, "apart")
    judged = lookup_join(slots, apart.select("key", "quota", "over_low"), ["key"])
    kept = judged.filter("slot < quota").select("shard", "key", "slot")
    given = judged.filter("slot >= quota").select("shard", (F.col("over_low") + F.col("slot") - F.col("quota")).alias("turn"))
    wanted = apart.filter("short > 0").select(
        "key", "got", "short_low", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("slot")
    )
    wanted = wanted.select("key", "slot", (F.col("short_low") + F.col("slot") - F.col("got")).alias("turn"))
    return kept.unionByName(given.join(wanted, "turn").select("shard", "key", "slot"))


def placed_documents(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sized with start, the words before the document in its source's stream.

    A source has about as many slices as a slice has rows, so neither list grows with the source.
    """
    rows = lookup_join(sized, sources.select("key", F.ceil(F.sqrt("rows")).alias("slices")), ["key"], spread_by=["order"])
    rows = rows.withColumn("slice", F.pmod("order", "slices")).drop("slices")
    sums = rows.groupBy("key", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("key", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("key", "slice").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return own.join(firsts, ["key", "slice"]).withColumn("start", F.col("first") + F.col("own")).drop("own", "first", "slice")


def mix(df: DataFrame, *, text: str = "text", source: str = "source", id_col: str = "doc_id", row: str | None = None,
        share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, parts).

    documents: (row, doc_id, size, source_size, target, start, key), one for each row of df.
    parts: (key, start, low, high, uses, kept): the words low to high of a document (high exclusive), each
    in one block that the mix uses `uses` times, the last time only its first `kept` words.
    """
    text_hash = F.xxhash64(text)
    sized = written(
        df.select(
            (F.col(row) if row else F.lit(0)).alias("row"),
            F.col(id_col).alias("doc_id"),
            F.col(source).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")).alias("key"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.col(id_col), text_hash).alias("order"),
        ),
        "sized",
    )
    sources = written(_with_blocks(source_targets(sized, share, most), most, block_words), "targets")
    documents = written(placed_documents(sized, sources), "placed")
    plan = lookup_join(shard_plan(sources), sources.select("key", "blocks", "multiplier"), ["key"])
    uses = plan.select("key", block_of(F.col("slot")).alias("block"))
    uses = written(uses.groupBy("key", "block").agg(F.count("*").alias("uses")), "uses")
    # Words used beyond the target are cut from the block of the last slot.
    length = lambda: F.least(F.lit(block_words), F.col("total") - F.col("block") * block_words)
    used = lookup_join(uses, sources.select("key", "total"), ["key"]).groupBy("key").agg(F.sum(F.col("uses") * length()).alias("used"))
    ends = sources.join(used, "key").withColumn("block", block_of(F.col("quota") - 1))
    ends = ends.select("key", "block", F.greatest(F.lit(0), F.least(length(), F.col("used") - F.round("target").cast("long"))).alias("cut"), length().alias("length"))
    uses = uses.join(ends, ["key", "block"], "left").select(
        "key", "block", "uses", F.coalesce(F.col("length") - F.col("cut"), F.lit(block_words)).alias("kept")
    )
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = (
        documents.filter("size > 0")
        .select("row", "doc_id", "key", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        .join(uses, ["key", "block"])
    )
    begin = F.greatest(F.col("block") * block_words, F.col("start")) - F.col("start")
    end = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size")) - F.col("start")
    kept = F.greatest(F.lit(0), F.least(end, F.col("block") * block_words + F.col("kept") - F.col("start")) - begin)
    parts = parts.select("row", "key", "start", begin.alias("low"), end.alias("high"), "uses", kept.alias("kept"))
    documents = lookup_join(documents, sources.select("key", F.col("total").alias("source_size"), "target"), ["key"], spread_by=["order"])
    return documents, parts


def taken_words(df: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of df."""
    documents, parts = mix(df, **options)
    taken = parts.groupBy("key", "start").agg(
        F.sum((F.col("uses") - 1) * (F.col("high") - F.col("low")) + F.col("kept")).alias("taken")
    )
    columns = ("doc_id", "size", "source_size", "target")
    # Documents without words may share a start with others, so only the others are joined.
    some = documents.filter("size > 0").join(taken, ["key", "start"], "left").select(*columns, F.coalesce("taken", F.lit(0)).alias("taken"))
    return some.unionByName(documents.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))


def mixed_texts(df: DataFrame, *, text: str = "text", id_col: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix as rows of df's columns: one row for each time that words of a document are taken.

    A row's text is the document's own if it is taken whole, else the taken words joined by blanks.
    Columns beside text, id and source are carried in one struct, so their names can clash with nothing.
    """
    columns = df.columns
    beside = [c for c in columns if c not in (text, id_col, source)]
    carried = F.struct(*[F.col(f"`{c}`") for c in beside], F.lit(0).alias("_last")).alias("_carried")
    packed = df.select(text, id_col, source, carried)
    numbered = written(packed.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    _, parts = mix(numbered, text=text, id_col=id_col, source=source, row="_row", **options)
    last = F.sequence(F.lit(1).cast("long"), F.col("uses"))
    each = parts.withColumn("pass", F.explode(last))
    high = F.when(F.col("pass") == F.col("uses"), F.col("low") + F.col("kept")).otherwise(F.col("high"))
    each = each.select("row", "pass", "low", high.alias("high")).filter("high > low")
    ranges = each.groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges"), F.sum(F.col("high") - F.col("low")).alias("taken"))
    # One row with all passes for each document: its text is shuffled once, whatever is taken of it.
    passes = ranges.groupBy("row").agg(F.collect_list(F.struct("pass", "ranges", "taken")).alias("passes"))
    joined = numbered.join(passes.withColumnRenamed("row", "_row"), "_row")
    joined = joined.withColumn("_pass", F.explode("passes")).withColumn("_words", F.when(F.col("_pass.taken") < word_count(F.col(text)), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))))
    cut = F.flatten(F.transform(F.col("_pass.ranges"), lambda r: F.slice(F.col("_words"), (r["low"] + 1).cast("int"), (r["high"] - r["low"]).cast("int"))))
    joined = joined.withColumn(text, F.when(F.col("_words").isNull(), F.col(text)).otherwise(F.array_join(cut, " ")))
    return joined.select(*[F.col("_carried").getField(c).alias(c) if c in beside else c for c in columns])
