"""WARC archive with content-addressed payloads.

``write_archive`` stores two tables under one path: ``payloads`` (each different payload once, keyed
by its SHA-256) and ``headers`` (the exact header bytes of every record, with the digest it refers to).
``read_archive`` joins them and rebuilds the exact bytes of every record; ``parse_records`` reads those
bytes as any WARC reader would.

Payloads move once to be written (partial aggregation first, so a payload that a third of the pages share
is sent once per task) and once to be read; owners and headers come from a table of digests without
payloads.  A digest is verified to name one payload only: all of its rows must have the same length,
SHA-1 and 64-bit hash, and the payloads table must hold it once.  Equal payloads of at least
``REVISIT_BYTES``: the record with the largest page_id is the response, the others are revisits that
refer to it; smaller payloads are all responses.

Edge cases: null html is an empty payload; a null page_id counts as smaller than all others; rows
repeated with the same page_id and payload are all written under record ids of their own, those with the
largest page_id as responses; a null url becomes an empty target, line ends in one are percent-encoded;
payloads of any length are whole records (no segments); an empty table makes an empty archive; other
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.storage import discard, saved, scratch, written

REVISIT_BYTES = 1000
CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _urn(page_id: Column, row: Column) -> Column:
    """A record id for a page's row (a digest cut into the form of a UUID)."""
    h = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("null")), row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and its sha256."""
    url = F.coalesce("url", F.lit(""))
    for character, code in (("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(character), F.lit(code))
    return pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha256", F.sha2("payload", 256))


def digests(pages: DataFrame) -> DataFrame:
    """Everything about the records but their payloads."""
    about = [F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"), F.xxhash64("payload").alias("h")]
    return with_digest(pages).select("page_id", "url", "sha256", *about, F.monotonically_increasing_id().alias("row"))


def headers(rows: DataFrame, owners: DataFrame, date: Column) -> DataFrame:
    """(page_id, sha256, header) of every record."""
    revisit = (F.col("bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("owner.page_id"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"), F.col("row"))),
        _line("WARC-Date", date),
        _line("WARC-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        _line("WARC-Target-URI", F.col("url")),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("owner.page_id"), F.col("owner.row"))), _line("WARC-Refers-To-Page-ID", F.col("owner.page_id").cast("string")),
                                 _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.col("sha256"))),
        _line("Content-Length", F.col("bytes").cast("string")),
        F.lit(CRLF),
    ).cast("binary")
    return rows.join(owners.select("sha256", "owner"), "sha256").select("page_id", "sha256", head.alias("header"))


def write_archive(pages: DataFrame, path: str, date: str | None = None) -> None:
    """``date``: of all records, as WARC/1.1 writes it; the time of writing unless given."""
    stamp = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = written(digests(pages), "digests")
    kinds = F.struct("bytes", "sha1", "h")
    owners = written(rows.groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("owner"), F.min(kinds).alias("a"), F.max(kinds).alias("b")), "owners")
    if clash := owners.filter("a <> b").take(1):
        raise ValueError(f"two payloads have the digest {clash[0].sha256}")
    # a hash aggregate with payloads as keys: each goes over the network once per task
    stored = saved(with_digest(pages).groupBy("sha256", "payload").agg(F.octet_length("payload").cast("long").alias("bytes")).select("sha256", "bytes", "payload"), f"{path}/payloads", compression="zstd")
    if stored.count() != owners.count():
        raise ValueError("two payloads have the same digest")
    saved(headers(rows, owners, stamp), f"{path}/headers")
    discard(rows)
    discard(owners)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id and record (the exact bytes: header, payload, two line ends) of every record."""
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    headers = spark.read.parquet(f"{path}/headers")
    tail = F.lit(CRLF * 2).cast("binary")
    return headers.join(payloads, "sha256", "left").select("page_id", F.concat("header", "payload", tail).alias("record"))


def parse_records(archive: DataFrame) -> DataFrame:
    """Reads record bytes: the header up to the first empty line, then Content-Length payload bytes."""
    end = F.instr(F.decode("record", "ISO-8859-1"), CRLF * 2) + 3  # one character a byte
    rec = archive.withColumn("_end", end).withColumn("_head", F.decode(F.expr("substring(record, 1, _end)"), "UTF-8"))
    field = lambda name: F.regexp_extract("_head", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    rec = rec.withColumn("_n", field("Content-Length").cast("int")).withColumn("payload", F.expr("substring(record, _end + 1, _n)"))
    return rec.select(
        F.when(field("WARC-Page-ID") != "", field("WARC-Page-ID").cast("long")).alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        field("WARC-Payload-Digest").alias("stated_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(field("WARC-Refers-To-Page-ID") != "", field("WARC-Refers-To-Page-ID").cast("long")).alias("refers_to"),
        "payload",
    )


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archive, reads it back, and returns the parsed records."""
    spark = pages.sparkSession
    path = path or f"{scratch(spark)}/linkloom/{uuid.uuid4().hex}/warc"
    write_archive(pages, path)
    return parse_records(read_archive(spark, path))
