"""A content-addressed WARC archive: payload bytes once, record headers apart, records by joins.

Writing gives two Parquet tables in one folder. ``payloads`` holds each distinct payload once under
its SHA-256 and length. ``headers`` holds, for each record, its exact header bytes (version line and
named fields, CRLF line ends) and the digest of its payload. A record is its headers, an empty line,
its payload and two line ends; joining the tables by digest gives every record back byte for byte,
revisits with the full payload they refer to.

Reading verifies: a stored payload whose bytes do not give the digest it is stored under, or a header
without stored payload, raises an error. Of records with equal payloads of at least ``least`` bytes,
that with the smallest id is the response and the others revisit it; smaller ones are all responses.
A null payload is empty. Null ids come after all others; rows that repeat an id and payload are alike.
A null url is an empty one. Empty tables give empty archives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_EOL = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hex digits (four base32 digits) at a time."""
    digest = F.sha1(payload)
    four = lambda i: F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[four(i) for i in range(8)]), _DIGITS, _BASE32)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z", most: int = 1_000_000) -> None:
    """Writes one record a row of ``pages`` to ``folder``.

    Digests that occur more than once are broadcast while there are at most ``most`` of them.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("string").alias("id_text"), F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    facts = rows.select("id", "id_text", "url", F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    facts.write.parquet(f"{folder}/facts")
    facts = pages.sparkSession.read.parquet(f"{folder}/facts")
    first = facts.groupBy("digest").agg(F.min("id").alias("first"))
    # only payloads that occur again are brought together to keep one; the others are written as they are read
    again = cut(facts.groupBy("digest").count().where("count > 1").select(F.col("digest").alias("again")))
    again = F.broadcast(again) if small(again, most) else again
    told = rows.select(F.sha2("payload", 256).alias("digest"), "payload")
    told.join(again, F.col("digest") == F.col("again"), "left_anti").write.parquet(f"{folder}/payloads")
    told.join(again, F.col("digest") == F.col("again"), "left_semi").dropDuplicates(["digest"]).write.mode("append").parquet(f"{folder}/payloads")
    told = facts.join(first, "digest")
    again = (F.col("n") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    field = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(_EOL))
    head = F.concat(
        F.lit(f"WARC/1.1{_EOL}"),
        field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", name(F.col("id"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(again, field("WARC-Refers-To", name(F.col("first")))).otherwise(""),
        F.when(again, field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.col("n").cast("string")),
    )
    told.select("id", "digest", head.cast("binary").alias("header")).write.parquet(f"{folder}/headers")


def payloads(spark: SparkSession, folder: str) -> DataFrame:
    """``digest`` and ``payload`` of each stored payload; raises where the bytes do not give the digest."""
    stored = spark.read.parquet(f"{folder}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    return stored.select("digest", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), "digest"))).alias("payload"))


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """``id``, ``digest`` and ``header`` of each record, and what its named fields say."""
    text = F.decode("header", "UTF-8")
    value = lambda k: F.nullif(F.regexp_extract(text, rf"(?:^|\n){k}: ([^\r\n]*)\r\n", 1), F.lit(""))
    told = spark.read.parquet(f"{folder}/headers")
    return told.select("id", "digest", "header", value("WARC-Type").alias("record_type"), value("WARC-Target-URI").alias("url"), F.substring_index(value("WARC-Payload-Digest"), ":", -1).alias("payload_digest"), F.regexp_extract(value("WARC-Refers-To"), "<urn:page:(.*)>", 1).alias("refers_to"), value("Content-Length").cast("long").alias("content_length"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``headers`` with ``record``: the record's exact bytes, its payload joined by digest and verified."""
    joined = headers(spark, folder).join(payloads(spark, folder), "digest", "left")
    payload = F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload is stored for "), "digest")).cast("binary"))
    eol = F.lit(_EOL).cast("binary")
    return joined.select("*", F.concat(F.col("header"), eol, payload, eol, eol).alias("record")).drop("payload")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Each record rebuilt by ``records`` and taken apart again: what its header says, and ``payload_bytes`` and ``payload_digest`` measured on the record's payload; a header that says otherwise raises."""
    rebuilt = records(spark, folder)
    payload = F.substring(F.col("record"), F.octet_length("header") + len(_EOL) + 1, F.octet_length("record") - F.octet_length("header") - 3 * len(_EOL))
    measured = rebuilt.select("id", "record_type", "refers_to", "url", "payload_digest", "content_length", F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("sha1"))
    agrees = (F.col("payload_digest") == F.col("sha1")) & (F.col("content_length") == F.col("payload_bytes"))
    digest = F.when(agrees, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("a record and its payload differ: "), "sha1")))
    return measured.select("id", "payload_bytes", digest.alias("payload_digest"), "record_type", F.nullif(F.col("refers_to"), F.lit("")).alias("refers_to"), "url")
