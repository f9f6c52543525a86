"""A content-addressed WARC archive: payloads once by strong digest, exact record headers apart.

``<path>/payloads`` has a row (sha256, payload) for each payload that responses carry, ``<path>/records`` a
row for each WARC/1.1 record with its exact header bytes. ``read_records`` joins them again. Both are
Parquet that Spark writes and commits, so any store that Spark reaches will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import new_path, written

#: Fixed by the WARC/1.1 format: how a revisit of an identical payload names its profile.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = -(1 << 63)  #: stands for a null page_id
#: What stands before the payload in a response's block; pages have no head of their own.
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in base 32: five hex digits make four digits to base 32, whose names are then exchanged."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    """A version 8 UUID whose free digits hold the number."""
    n = F.lpad(F.hex(page_id), 16, "0")
    part = lambda start, size: F.substring(n, start, size)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(16, 1), F.lit("00-000000000000>"))


def _page_id(header: Column, field: str) -> Column:
    """The number in a record id of a header, or null where the field is missing or stands for null."""
    pattern = rf"\r\n{field}: <urn:uuid:([0-9A-F]{{8}})-([0-9A-F]{{4}})-8([0-9A-F]{{3}})-8([0-9A-F])00-"
    digits = F.concat(*(F.regexp_extract(header, pattern, k) for k in range(1, 5)))
    number = F.when(digits != "", F.conv(digits, 16, -10).cast("long"))
    return F.when(number != _NO_ID, number)


def _header(date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("kind") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n").cast("string"), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("keeper"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes") + len(_HTTP)).cast("string")), F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html).

    Of records with equal payloads of ``min_bytes`` or more, that with the largest page_id is the response
    and the others revisit it; smaller payloads are all responses. Payloads are stored once either way. A
    null html is an empty payload, a null url an empty target (line breaks in one become %0D and %0A), and a null page_id sorts first. Rows equal in
    page_id and payload are equal records. ``date`` is every record's date, as pages have none. An empty
    table makes an empty archive. Other columns are left out.
    """
    page = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(_NO_ID)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    page = page.select("*", F.sha2("payload", 256).alias("sha256"))
    named = page.select("page_id", "url", "sha256", sha1_base32(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    #: A table, so that both sides of the joins are shuffled for them alone: Spark then splits a payload that very many share.
    chosen = written(named.groupBy("sha256").agg(F.max("page_id").alias("keeper")), "keepers")
    records = named.join(chosen, "sha256")
    response = (F.col("bytes") < min_bytes) | (F.col("page_id") == F.col("keeper"))
    records = records.withColumn("kind", F.when(response, "response").otherwise("revisit"))
    records.select("sha256", F.encode(_header(date), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")
    kept = page.select("page_id", "sha256", "payload").join(chosen.withColumnRenamed("keeper", "page_id"), ["page_id", "sha256"], "left_semi")
    kept.dropDuplicates(["page_id", "sha256"]).select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _records(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("sha256 string, header binary").parquet(f"{path}/records")
    text = F.decode("header", "UTF-8")
    return rows.select(
        "sha256", "header", _page_id(text, "WARC-Record-ID").alias("page_id"), _page_id(text, "WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(text, r"\r\nWARC-Type: (\w+)", 1).alias("record_type"),
        F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha1:(\w+)", 1).alias("payload_digest"))


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    held = F.sha2("payload", 256) == F.col("sha256")
    checked = F.when(held, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("sha256"))).cast("binary"))
    return rows.select("sha256", checked.alias("payload"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: page_id, payload_bytes, payload_digest, record_type, refers_to, header, payload and
    record (the WARC record's bytes). A payload that its SHA-256 or the header's digest doesn't match, and a
    block that is not as long as the header says, stop the read."""
    held = _payloads(spark, path).select("sha256", "payload", sha1_base32(F.col("payload")).alias("sha1"))
    both = _records(spark, path).join(held, "sha256", "left")
    block = F.when(F.col("record_type") == "response", F.concat(F.lit(_HTTP.encode()), F.col("payload"))).otherwise(F.lit(b""))
    said = F.regexp_extract(F.decode("header", "UTF-8"), r"\r\nContent-Length: (\d+)", 1).cast("long")
    wrong = (
        F.when(~F.col("payload_digest").eqNullSafe(F.col("sha1")), F.concat(F.lit("no payload with the digest "), F.col("payload_digest")))
        .when(~said.eqNullSafe(F.octet_length(block).cast("long")), F.concat(F.lit("block of another length than "), F.coalesce(said.cast("string"), F.lit("none"))))
    )
    digest = F.when(wrong.isNull(), F.col("sha1")).otherwise(F.raise_error(wrong).cast("string"))
    return both.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to",
        "header", "payload", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``read_records`` up to refers_to, of records rebuilt and checked."""
    return read_records(spark, path).drop("header", "payload", "record")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder, rebuild its records and return what they say."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_bytes)
    return read_index(pages.sparkSession, path)
