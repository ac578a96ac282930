"""A content-addressed archive of web records.

Method: payload bytes are stored once, under their SHA-256 and length; the exact header of every record is kept
apart and names the payload. Joining the two by that key gives the original records. A second digest guards
the key: payloads that share it must share their SHA-1 as well, and reading computes both anew.

Everything is a column expression. Equal payloads are reduced to one within each task before they are
shuffled, so a payload that a third of all pages have costs one copy per task.

A null text is an empty payload; a null url gives a record without target. Rows that repeat an id are records
of their own. Rows without an id are responses only where no row with an id has their payload.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.session import new_path

#: Time of capture that headers carry: a parameter of the run, not of the pages.
CAPTURED = "2024-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest."""
    digits = F.sha1(data)

    def four(i: Column) -> Column:  # five hex digits are twenty bits: four base32 digits
        bits = F.conv(F.substring(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        letters = [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*letters)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def record_id(page_id: Column) -> Column:
    """A stable identifier of a page's record."""
    d = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("none"))))
    part = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


@dataclass
class Archive:
    """Folders of an archive."""

    payloads: str
    headers: str


def write_archive(pages: DataFrame, least_bytes: int = 0, captured: str = CAPTURED) -> Archive:
    """Write a record for each page (``page_id, url, html``) to a new archive in the shared folder.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is a
    response and the others revisit it; all smaller payloads are responses.
    """
    spark = pages.sparkSession
    out = Archive(new_path(spark, "archive-payloads"), new_path(spark, "archive-headers"))
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    keyed = rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("bytes"), "payload")
    stored = keyed.groupBy("sha256", "bytes").agg(
        F.first("payload").alias("payload"),
        F.min("page_id").alias("first_page"),
        F.min(F.sha1("payload")).alias("low"),
        F.max(F.sha1("payload")).alias("high"),
    )
    clash = F.raise_error(F.lit("two payloads share a SHA-256 digest"))
    checked = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(clash.cast("binary"))
    stored.select("sha256", "bytes", "first_page", checked.alias("payload")).write.parquet(out.payloads)

    firsts = spark.read.parquet(out.payloads).select("sha256", "bytes", "first_page")
    named = keyed.select("page_id", "url", "sha256", "bytes", base32_sha1(F.col("payload")).alias("digest"))
    joined = named.join(firsts, ["sha256", "bytes"])
    revisit = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    lines = F.concat_ws(
        _END,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {captured}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first_page")))),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("bytes")).cast("string")),
    )
    header = F.concat(lines, F.lit(_END + _END))
    refers = F.when(revisit, F.col("first_page"))
    joined.select("page_id", refers.alias("refers_to"), "sha256", "bytes", header.alias("header")).write.parquet(out.headers)
    return out


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row per record, from its header and the digests of its stored payload, computed anew.

    ``page_id, record_type, refers_to, target, payload_bytes, payload_digest``. Raises where a payload or a
    header disagrees with the digests that name it.
    """
    wrong = F.raise_error(F.lit("a payload does not match its digest"))
    right = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("bytes"))
    payloads = spark.read.parquet(archive.payloads).select(
        "sha256", "bytes", F.when(right, base32_sha1(F.col("payload"))).otherwise(wrong.cast("string")).alias("payload_digest")
    )
    headers = spark.read.parquet(archive.headers)
    named = F.expr("substring(`named`, 6)")
    rows = headers.withColumn("named", _field("WARC-Payload-Digest")).join(payloads, ["sha256", "bytes"])
    agreed = F.when(named == F.col("payload_digest"), F.col("payload_digest")).otherwise(wrong.cast("string"))
    return rows.select(
        "page_id",
        _field("WARC-Type").alias("record_type"),
        "refers_to",
        _field("WARC-Target-URI").alias("target"),
        F.col("bytes").alias("payload_bytes"),
        agreed.alias("payload_digest"),
    )


def original_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """``page_id, record, payload``: the bytes of each record as a WARC file holds them, and its full payload.

    A revisit's record has no block of its own; its payload is that of the record it refers to.
    """
    payloads = spark.read.parquet(archive.payloads).select("sha256", "bytes", "payload")
    rows = spark.read.parquet(archive.headers).join(payloads, ["sha256", "bytes"])
    block = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("header", "utf-8"), block, F.lit(b"\r\n\r\n"))
    return rows.select("page_id", record.alias("record"), "payload")
