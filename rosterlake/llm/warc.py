"""WARC archives: writing page captures, reading them back, and assembling transactions.

Writing gives each page a request, a response (or revisit) and a metadata record; request and
metadata name the response in WARC-Concurrent-To. A record is a string that the text sink ends with
two line breaks, which is just how a WARC file frames its records, so Spark's own writer, compression
and commit protocol make the archives, in any store that Spark can write to.

Reading splits the text at version lines and checks each part against its Content-Length. A payload
that happens to contain such a line makes parts too short; only files with such parts are read once
more, whole, by length alone. (A separator that began with line breaks would be ambiguous, since blocks
end with line breaks too, and Hadoop's reader misses some of those where its buffer ends.)

Assembly brings request, response and metadata together by the identifier they share and gives one
nested row for each capture.

Defined results
* Null payload: empty. Null url: no target line. Null page id: an empty page id, null again when read.
* Of payloads that are equal and have at least `revisit_bytes` bytes, the one with the largest page id
  is the response and the others revisit it; if rows repeat that page id, each of them is a response.
* Repeated rows are captures of their own, for each record has its own identifier.
* A request or metadata record without its response still gives a row, whose response columns are null.
* Line breaks in a url or page id would break the header; they are written percent-encoded.
* An empty table gives an archive without records, and reading that gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import workers_import

VERSION = "WARC/1.1"
BREAK = "\r\n"
END = BREAK * 2
#: What every record begins with.
BEGIN = VERSION + BREAK
REVISIT_BYTES = 1000
#: Records of an archive file, at most: a file with a version line in a payload is read whole, by one task.
FILE_RECORDS = 3_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(BREAK)), F.lit(""))


def _record(kind: Column | str, record_id: Column, date: str, block: Column, *lines: Column) -> Column:
    """The record up to its block's end; the sink adds END."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit(VERSION + BREAK),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", record_id),
        _line("WARC-Date", F.lit(date)),
        *lines,
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(BREAK),
        block,
    )


def _safe(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def with_revisits(pages: DataFrame, *, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page, url, payload, bytes, digest, refers_to): refers_to is the page that holds the same payload.

    The largest page id of each payload is found with partial aggregation. Small payloads, which never
    refer to one another, are dealt by a hash in the join, so that neither empty pages nor one common
    page gather in a task; a very common payload is a skewed join key that Spark splits.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("string").alias("page"),
        F.col("page_id").alias("_number"),
        _safe(F.col("url")).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha1(F.encode(payload, "UTF-8")).alias("digest"),
    )
    large = F.col("bytes") >= revisit_bytes
    holders = (
        rows.filter(large)
        .groupBy("digest")
        .agg(F.count("*").alias("copies"), F.max("_number").alias("holder"))
        .filter("copies > 1")
        .select(F.col("digest").alias("match"), "holder")
    )
    spread = F.concat(F.lit("small:"), F.xxhash64("page", "url", "digest").cast("string"))
    joined = rows.withColumn("match", F.when(large, F.col("digest")).otherwise(spread)).join(holders, "match", "left")
    refers = F.when(~F.col("_number").eqNullSafe(F.col("holder")), F.col("holder").cast("string"))
    return joined.select("page", "url", "payload", "bytes", "digest", refers.alias("refers_to"))


def write_archive(captures: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Write three records for each row of with_revisits to WARC files below path."""
    name = lambda: F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    # Identifiers are drawn once, before the records use them: all records of a row come from one task attempt.
    rows = captures.select("*", name().alias("main"), name().alias("asked"), name().alias("about"))
    is_response = F.col("refers_to").isNull()
    target, page = _line("WARC-Target-URI", F.col("url")), _line("Page-ID", F.col("page"))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    records = F.array(
        _record(
            "request", F.col("asked"), date,
            F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{END}")),
            _line("WARC-Concurrent-To", F.col("main")), target, F.lit(f"Content-Type: application/http;msgtype=request{BREAK}"),
        ),
        _record(
            F.when(is_response, F.lit("response")).otherwise(F.lit("revisit")), F.col("main"), date,
            F.concat(head, F.when(is_response, F.col("payload")).otherwise(F.lit(""))),
            target, page, digest, _line("WARC-Profile", F.when(~is_response, F.lit(PROFILE))),
            _line("Refers-To-Page-ID", F.col("refers_to")), F.lit(f"Content-Type: application/http;msgtype=response{BREAK}"),
        ),
        _record(
            "metadata", F.col("about"), date, F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit(BREAK)),
            _line("WARC-Concurrent-To", F.col("main")), target, page, F.lit(f"Content-Type: application/warc-fields{BREAK}"),
        ),
    )
    texts = rows.select(F.explode(records).alias("value"))
    texts.write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", compression).text(path)


def _whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, block) of each record of whole files, found by Content-Length alone."""
    import gzip

    for batch in batches:
        for content in batch.column(0):
            raw = content.as_py()
            raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            at = 0
            while at < len(raw):
                middle = raw.index(END.encode(), at)
                head = raw[at:middle].decode()
                length = next(int(x.partition(":")[2]) for x in head.split(BREAK) if x.lower().startswith("content-length:"))
                begin = middle + len(END)
                block = raw[begin : begin + length].decode()
                yield pa.RecordBatch.from_pydict({"head": [head.partition(BREAK)[2]], "block": [block]})
                at = begin + length + len(END)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(head, block) of every record: the header lines after the version line, and the block's text."""
    workers_import(spark)
    parts = spark.read.option("lineSep", BEGIN).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    cut = F.instr("value", END)
    split = parts.filter("value <> ''").select(  # what stands before the first record
        "file",
        F.when(cut > 0, F.substring("value", 1, cut - 1)).otherwise(F.lit("")).alias("head"),
        F.when(cut > 0, F.substring("value", cut + len(END), F.lit(1 << 30))).alias("block"),
    )
    length = F.regexp_extract("head", r"(?i)(?:^|\n)content-length:[ \t]*(\d+)", 1)
    over = F.octet_length("block") - F.when(length != "", length.cast("long"))
    whole = F.coalesce((over == len(END)) & F.endswith("block", F.lit(END)), F.lit(False))
    cut_block = F.expr(f"left(block, char_length(block) - {len(END)})")
    broken = split.filter(~whole).select("file").distinct()
    if broken.isEmpty():
        return split.select("head", cut_block.alias("block"))
    good = split.join(broken, "file", "left_anti").select("head", cut_block.alias("block"))
    files = spark.read.format("binaryFile").load(path).join(broken, F.col("path") == F.col("file"), "left_semi")
    return good.unionByName(files.select("content").mapInArrow(_whole_files, "head string, block string"))


def field(name: str) -> Column:
    """The header line of this name, or null."""
    found = F.regexp_extract("head", rf"(?i)(?:^|\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: record_id, target_uri, and structs response, request, metadata.

    Records meet by one identifier: a response's own, and what the others are concurrent to. Several
    requests or metadata records of a capture are lists; one shuffle by identifier joins all three.
    """
    kind = field("WARC-Type")
    is_main = F.col("kind").isin("response", "revisit")
    length = F.octet_length("block").cast("long")
    read = records.select(
        kind.alias("kind"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Concurrent-To").alias("concurrent_to"),
        field("WARC-Target-URI").alias("target_uri"),
        field("Page-ID").alias("page_id"),
        field("Refers-To-Page-ID").alias("refers_to"),
        F.regexp_extract("head", r"(?i)warc-payload-digest:[ \t]*sha1:([0-9a-f]+)", 1).alias("digest"),
        F.instr("block", END).alias("http"),
        "block",
        length.alias("block_bytes"),
    ).select(
        "*",
        F.when(is_main & (F.col("http") > 0), F.substring("block", F.col("http") + len(END), F.lit(1 << 30))).alias("payload"),
        F.when(is_main, F.regexp_extract("block", r"(?i)content-length:[ \t]*(\d+)", 1).cast("long")).alias("stated_bytes"),
    )
    # What a response holds is measured here, before the shuffle, so that a payload nobody asks for stays out of it.
    is_response = F.col("kind") == "response"
    read = read.select(
        "*",
        F.when(is_response, F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("bytes"),
        F.when(is_response, F.sha1(F.encode("payload", "UTF-8"))).otherwise(F.col("digest")).alias("payload_digest"),
    )
    key = F.when(is_main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    main = lambda c: F.max(F.when(is_main, F.col(c)))
    side = lambda k: F.collect_list(F.when(F.col("kind") == k, F.struct("record_id", "target_uri", "block")))
    names = ("kind", "page_id", "refers_to", "bytes", "payload_digest", "payload")
    joined = read.groupBy(key.alias("record_id")).agg(
        F.max("target_uri").alias("target_uri"), *[main(c).alias(c) for c in names], side("request").alias("requests"), side("metadata").alias("metadata")
    )
    return joined.select("record_id", "target_uri", F.struct(*names).alias("response"), "requests", "metadata")


def described(captures: DataFrame) -> DataFrame:
    """A flat row for each capture that has a response: its digest, and what its request and metadata say.

    request_line and metadata_bytes come from the first request and metadata record; where a capture has
    none, they are null and n_requests or n_metadata is 0. A request or metadata record without its
    response gives no row here; assemble() keeps it.
    """
    of = lambda c: F.col(f"response.{c}")
    block = lambda side: F.get(side, F.lit(0))["block"]
    stated = F.regexp_extract(block("metadata"), r"(?i)(?:^|\n)payload-bytes:[ \t]*(\d+)", 1)
    return captures.filter(of("kind").isNotNull()).select(
        of("page_id").cast("long").alias("page_id"),
        of("bytes").alias("payload_bytes"),
        of("payload_digest").alias("payload_digest"),
        of("kind").alias("record_type"),
        of("refers_to").cast("long").alias("refers_to"),
        "target_uri",
        F.regexp_extract(block("requests"), r"^([^\r\n]*)", 1).alias("request_line"),
        F.when(stated != "", stated.cast("long")).alias("metadata_bytes"),
        F.size("requests").cast("long").alias("n_requests"),
        F.size("metadata").cast("long").alias("n_metadata"),
    )
