"""Content-addressed WARC archive: payload bytes once by SHA-256, exact record headers apart, records rebuilt by joins.

An archive is two tables in one folder: payloads (digest, payload, first_id), one row per different payload, and headers
(header), one header block per record, byte for byte: the WARC/1.1 header and, in a response, the HTTP header that opens its
block. Payloads are reduced to one row per digest and map task before they move (a window's group limit), so a payload that a
third of all records share moves once per task, not per record; in the joins on digest, which have an exchange on either side,
adaptive execution splits such a key. Reading parses the header blocks, recomputes each stored payload's digest once, and joins
on the digest; a stored payload that doesn't hash to its key makes `verified` false.

Records with equal payloads of at least MIN_REVISIT bytes: the one with the smallest id is the response, others are revisits
that refer to it; shorter payloads are responses all. Null payloads are empty, null ids sort after all others (a payload that
only null ids have is a response), null addresses are written empty. White space, control and line-separating characters of
an address are percent-encoded, so no address can end a line or pose as a field. Repeated rows give repeated records: those with
the smallest id are responses; a record's name holds id, digests of payload and address and a number, so names are unique. Extra
columns are not archived. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values.
MIN_REVISIT, PROFILE, DATE = 100, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "1970-01-01T00:00:00Z"
#: Characters that an address may not hold as they are: a header's lines end at CR LF, but readers differ about the others.
UNSAFE = [*map(chr, range(33)), "\x7f", "\x85", "\xa0", "\u2028", "\u2029"]


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    return pages.select(F.col(key).cast("long").alias("id"), _uri(F.col(url)).alias("uri"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))


def _uri(url: Column) -> Column:
    out = F.coalesce(url, F.lit(""))
    for ch in UNSAFE:
        out = F.replace(out, F.lit(ch), F.lit("".join(f"%{b:02X}" for b in ch.encode())))
    return F.when(url.rlike("[\\x00-\\x20\\x7f\\x85\\xa0\\u2028\\u2029]"), out).otherwise(F.coalesce(url, F.lit("")))


def _urn(id_: Column, digest: Column, uri: Column, number: Column) -> Column:
    name = F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.substring(digest, 1, 16), F.substring(F.md5(F.encode(uri, "utf-8")), 1, 16), number.cast("string"))
    return F.concat(F.lit("<urn:lorekeep:record:"), name, F.lit(">"))


def header_block(date: str = DATE) -> Column:
    """All of the record before its payload, from id, uri, number, digest, bytes, first_id, first_uri."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    again = (F.col("bytes") >= MIN_REVISIT) & ~F.col("id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    http = F.when(again, F.lit("")).otherwise(http)
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("id"), F.col("digest"), F.col("uri"), F.col("number"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("first_id"), F.col("digest"), F.col("first_uri"), F.lit(0))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )


def write_archive(pages: DataFrame, path: str, **names: str) -> None:
    rec = records(pages, **names)
    first = Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last(), "uri")
    once = rec.withColumn("r", F.row_number().over(first)).where("r = 1")
    once.select("digest", "payload", F.col("id").alias("first_id"), F.col("uri").alias("first_uri")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    known = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_id", "first_uri")
    alike = Window.partitionBy("id", "digest", "uri").orderBy("id")
    head = rec.drop("payload").join(known, "digest").withColumn("number", F.row_number().over(alike) - 1)
    head.select(F.encode(header_block(), "utf-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, record_type, refers_to, digest, header, payload, payload_bytes, payload_digest, verified) of each record."""
    h = spark.read.schema("header binary").parquet(f"{path}/headers").withColumn("_h", F.decode("header", "utf-8"))
    value = lambda k, rx: F.regexp_extract("_h", rf"(?:^|\r\n){k}: {rx}", 1)
    number = lambda k: F.nullif(value(k, "<urn:lorekeep:record:([^>:]*)"), F.lit("")).try_cast("bigint")
    h = h.select(
        number("WARC-Record-ID").alias("id"), value("WARC-Target-URI", r"([^\r]*)").alias("url"), value("WARC-Type", r"([^\r]*)").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        value("WARC-Payload-Digest", "sha256:([0-9a-f]*)").alias("digest"), "header",
    )
    p = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    p = p.select(F.col("digest").alias("key"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    return h.join(p, h["digest"] == p["key"], "left").drop("key").withColumn("verified", F.col("digest").eqNullSafe(F.col("payload_digest")))


def record_bytes(df: DataFrame) -> DataFrame:
    """df of read_archive with `record`: header, block and the two line ends, byte for byte as in a WARC file."""
    rest = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return df.withColumn("record", F.concat(F.col("header"), rest, F.lit(b"\r\n\r\n")))


def rebuilt(df: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) taken from rebuilt records: a response's payload is what stands
    in the record between header and end. A record whose payload is missing or damaged raises an error."""
    d = record_bytes(df)
    size = F.octet_length("record") - F.octet_length("header") - 4
    block = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.substring("record", F.octet_length("header") + 1, size))
    d = d.withColumn("_block", block).withColumn("_sha", F.sha2("_block", 256))
    sound = F.when(F.col("_sha").eqNullSafe(F.col("digest")), F.col("_sha")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest: "), F.coalesce("digest", F.lit("none")))))
    return d.select("id", F.octet_length("_block").cast("long").alias("payload_bytes"), sound.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, min(page_id) AS first_id FROM p GROUP BY d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN octet_length(b) >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(b) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN m ON p.d = m.d
"""
