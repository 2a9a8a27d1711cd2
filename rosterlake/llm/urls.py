"""URL filters: rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table: one row for each block of 512 bits, as eight longs. A listed URL sets eight
bits, all in one block, so a lookup is one probe of one row: a broadcast hash join by block number and
eight bit tests, in generated code. Rows that pass are possible hits; only these are joined with the
list itself, by URL, which removes the false positives. The filter never has more than MOST_BLOCKS
blocks (about 8 MB), so the broadcast is bounded; a longer list only lets more false positives through
to the exact join.

Defined results
* Null url, or one without `://`: host and path are empty, no rule fits, the canonical form is null,
  and the verdict is allow.
* A rule fits its host and all subdomains if the path starts with the rule's path; the rule with the
  longest text wins. A url without a path fits no rule, since every rule's path begins with a slash.
* Null entries of the list are left out; repeated ones count once. An empty list blocks nothing.
* `repeated` lists the canonical urls that more than one row carries, whatever the scheme, query or
  fragment of each; rows without a canonical url make no entry.
* Repeated rows repeat. Columns host, path, rule and verdict of the input are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
BITS_PER_URL = 16
MOST_BLOCKS = 1 << 16


def _after_scheme(url: Column) -> Column:
    """What stands after the first ://, null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., and path without index page or closing slash; scheme, query and fragment go."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    return F.when(host != "", F.concat(host, path))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) for columns host and path; nulls where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _hashes(url: Column) -> list[Column]:
    """WORDS bit masks, one for each long of a block."""
    return [F.expr("shiftleft(1L, cast(pmod(_h2 >> %d, 64) as int))" % (7 * i)) for i in range(WORDS)]


def _hashed(df: DataFrame, url: str, blocks: int) -> DataFrame:
    return df.withColumn("_block", F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")).withColumn("_h2", F.xxhash64(url, F.lit(1)))


def bloom_filter(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(_block, w0 … w7): at most `blocks` rows."""
    masks = [F.bit_or(m).alias(f"w{i}") for i, m in enumerate(_hashes(F.col(url)))]
    return _hashed(listed, url, blocks).groupBy("_block").agg(*masks)


def in_list(df: DataFrame, listed: DataFrame, url: str = "canonical") -> DataFrame:
    """df with a boolean column `listed`: whether its canonical url stands in the list's only column."""
    name = listed.columns[0]
    entries = listed.select(F.col(name).alias("_entry")).filter(F.col("_entry").isNotNull()).distinct()
    wanted = -(-entries.count() * BITS_PER_URL // (64 * WORDS))
    blocks = min(MOST_BLOCKS, max(1, wanted))
    table = bloom_filter(entries, "_entry", blocks)
    # At most MOST_BLOCKS rows of 68 bytes, whatever the list.
    probed = _hashed(df, url, blocks).join(F.broadcast(table), "_block", "left")
    bits = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_hashes(F.col(url)))])
    probed = probed.select(*df.columns, F.coalesce(bits, F.lit(False)).alias("_possible"))
    exact = entries.withColumn("listed", F.lit(True))
    hits = probed.filter("_possible").join(exact, F.col(url) == F.col("_entry"), "left")
    hits = hits.select(*df.columns, F.coalesce("listed", F.lit(False)).alias("listed"))
    return hits.unionByName(probed.filter("not _possible").select(*df.columns, F.lit(False).alias("listed")))


def repeated(df: DataFrame, url: str = "url") -> DataFrame:
    """(entry): canonical urls that several rows carry; counted with partial sums, one shuffle of urls."""
    entries = df.select(canonical(F.col(url)).alias("entry")).filter("entry is not null")
    return entries.groupBy("entry").agg(F.count("*").alias("_rows")).filter("_rows > 1").select("entry")


def judge(df: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """df with host, path, rule and verdict: the rule's verdict, else block for listed urls."""
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    own = df.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("_canonical"))
    rule, says = rule_columns(rules)
    own = own.withColumn("rule", rule).withColumn("_says", says)
    found = in_list(own, listed, "_canonical")
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select(*kept, "host", "path", "rule", F.coalesce("_says", by_list).alias("verdict"))
