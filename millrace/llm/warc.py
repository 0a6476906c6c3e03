"""Web archives: deduplicated WARC records, written and read back as files.

``resolve`` shuffles record headers and payloads by payload digest and joins each repeated payload to
its original response. ``write_archives`` writes one file per task: a response holds the HTTP
head and the payload, a revisit only the head and a reference. ``read_archives`` parses the
files again and checks every length and digest.

Records of one write share a ``WARC-Warcinfo-ID`` that starts each record. It is random, so no
payload can hold it, and the reader cuts archives at it as a stream: no file is held in memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.common import text_or_empty, unused

# The names and line ends of the archive format.
END = "\r\n"
GAP = "\r\n\r\n"
VERSION = "WARC/1.1"
INFO = "WARC-Warcinfo-ID"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Payloads shorter than this many bytes are never replaced by a revisit.
MIN_REVISIT_BYTES = 1000


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One response record per row: ``record_key, target, payload, payload_bytes, payload_digest``.

    A null payload is empty; a null address becomes an empty one. Other columns are left out.
    """
    body = text_or_empty(payload)
    return pages.select(
        F.col(f"`{key}`").cast("bigint").alias("record_key"),
        text_or_empty(url).alias("target"),
        body.alias("payload"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
        F.sha1(body.cast("binary")).alias("payload_digest"),
    )


def resolve(found: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``min_bytes``, the one with the largest key is the response and
    the others revisit it. Rows that repeat that key are responses as well; a null key
    ranks below all others. Originals are counted per task before the shuffle, and a digest that a third of all
    rows share is split by the adaptive join.
    """
    originals = (
        found.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("record_key").alias("original"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    joined = found.join(originals, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("record_key").eqNullSafe(F.col("original"))
    return joined.select(
        *found.columns,
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def _one_line(value: Column) -> Column:
    """A header value without control characters; ``%`` is escaped too, so that it can be undone."""
    for code in (0x25, 0x0D, 0x0A):
        value = F.replace(value, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return value


def _many_lines(value: Column) -> Column:
    for code in (0x0A, 0x0D, 0x25):
        value = F.replace(value, F.lit(f"%{code:02X}"), F.lit(chr(code)))
    return value


def record_text(archive: str) -> Column:
    """A whole record without its closing gap, from the columns of ``resolve``."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(GAP),
    )
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    length = F.octet_length(http) + F.when(revisit, F.lit(0).cast("bigint")).otherwise(F.col("payload_bytes"))
    name = F.coalesce(F.col("record_key").cast("string"), F.lit("none"))
    return F.concat(
        F.lit(f"{VERSION}{END}{INFO}: <urn:uuid:{archive}>{END}WARC-Type: "),
        F.col("record_type"),
        F.lit(f"{END}WARC-Record-ID: <urn:page:"),
        name,
        F.lit(f">{END}WARC-Target-URI: "),
        _one_line(F.col("target")),
        F.lit(f"{END}WARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"{END}WARC-Profile: {PROFILE}{END}WARC-Refers-To: <urn:page:"),
                F.col("refers_to").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(F.lit("")),
        F.lit(f"{END}Content-Type: application/http;msgtype=response{END}Content-Length: "),
        length.cast("string"),
        F.lit(GAP),
        block,
    )


def write_archives(resolved: DataFrame, path: str) -> str:
    """Write compressed archives, one per task; returns the name that all their records carry."""
    archive = str(uuid.uuid4())
    text = resolved.select(record_text(archive).alias("value"))
    text.write.option("lineSep", GAP).option("compression", "gzip").text(path)
    return archive


def _header(head: Column, name: str) -> Column:
    """The value of a header line; null if it is absent."""
    found = F.regexp_extract(head, rf"(?:^|\r\n)\Q{name}\E: ([^\r\n]*)", 1)
    return F.when(F.contains(head, F.lit(f"{name}: ")), found)


def read_archives(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Records of a folder of archives: key, target, type, reference, digest, length and payload.

    ``payload`` is null for a revisit and ``payload_bytes`` is the length of the full payload. A
    record whose length or digest does not fit its header ends the job with an error.
    """
    opening = f"{VERSION}{END}{INFO}: <urn:uuid:{archive}>{END}"
    raw = spark.read.option("lineSep", opening).text(path).where(F.octet_length("value") > 0)
    cut = F.instr(F.col("value"), GAP)
    head = F.substr(F.col("value"), F.lit(1), cut - 1)
    # Without the gap that closes the record.
    block = F.substr(F.col("value"), cut + len(GAP), F.length("value") - cut - 2 * len(GAP) + 1)
    parts = raw.select(head.alias("head"), block.alias("block"))
    body_at = F.instr(F.col("block"), GAP)
    kind = _header(F.col("head"), "WARC-Type")
    fields = parts.select(
        F.nullif(F.regexp_extract("head", r"WARC-Record-ID: <urn:page:([^>]*)>", 1), F.lit("none")).cast("bigint").alias("record_key"),
        _many_lines(_header(F.col("head"), "WARC-Target-URI")).alias("target"),
        kind.alias("record_type"),
        F.nullif(F.regexp_extract("head", r"WARC-Refers-To: <urn:page:([^>]*)>", 1), F.lit("")).cast("bigint").alias("refers_to"),
        F.regexp_extract("head", r"WARC-Payload-Digest: sha1:([0-9a-f]*)", 1).alias("payload_digest"),
        F.regexp_extract("block", r"\r\nContent-Length: ([0-9]+)", 1).cast("bigint").alias("payload_bytes"),
        _header(F.col("head"), "Content-Length").cast("bigint").alias("block_bytes"),
        F.octet_length("block").cast("bigint").alias("found_bytes"),
        F.when(kind == "response", F.substr(F.col("block"), body_at + len(GAP))).alias("payload"),
    )
    sound = (F.col("block_bytes") == F.col("found_bytes")) & (
        F.col("payload").isNull() | (F.sha1(F.col("payload").cast("binary")) == F.col("payload_digest"))
    )
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("damaged record "), F.coalesce(F.col("record_key").cast("string"), F.lit("none"))))
    )
    return fields.withColumn("payload_digest", checked).drop("block_bytes", "found_bytes")


def deduplicated_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as deduplicated archives and return the records read back from them."""
    archive = write_archives(resolve(records(pages), min_bytes), path)
    return read_archives(pages.sparkSession, path, archive)


def full_payloads(read: DataFrame) -> DataFrame:
    """Records with ``full_payload``: a revisit takes the payload of the response it refers to."""
    sources = (
        read.where("record_type = 'response' AND record_key IS NOT NULL")
        .groupBy(F.col("record_key").alias("refers_to"), "payload_digest")
        .agg(F.first("payload").alias("original_payload"))
    )
    spare = unused("full", read)
    joined = read.join(sources, ["refers_to", "payload_digest"], "left")
    joined = joined.withColumn(spare, F.coalesce("payload", "original_payload"))
    return joined.select(*read.columns, F.col(spare).alias("full_payload"))
