"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records rebuilt by a join.

Payloads are the bulk, so they are moved once: the shuffle that reduces them to one a digest also fills the buckets of the files, and
the join that rebuilds records reads those as they lie. Only payloads that several records share are shuffled again, as there a hot one must be split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm.common import col, numbered, query, read, stage
from weftwork.session import fresh_path, shuffle_partitions

MIN_REVISIT = 1000
BUCKET_BYTES = 64 << 20  # payload bytes of a bucket, which one task reads
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _printable(value: Column) -> Column:
    """A header value without bytes that would end the line: control characters and blanks as %hex."""
    safe = value
    for code in (13, 10, 9, 32):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return safe


def record_id(page_id: Column, row: Column) -> Column:
    """A URI that names a capture: its page id ('null' without one) and its row number in the archive."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, page_id="page_id", url="url", body="html", min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """Write ``path/payloads`` (address, bytes) and ``path/records`` (row, address, WARC header, HTTP header).

    One record a row of ``pages``; the payload is the body in UTF-8 (NULL: empty). The address is the SHA-256 of the
    payload; the files of payloads are bucketed by it, and their schema says into how many. Among records with equal payloads of ``min_revisit`` bytes or more the one with the largest
    page id (NULL smallest; then the last row) is a response and the others revisits; shorter ones are all
    responses. Equal payloads are reduced to one inside each task before they are shuffled. Headers are
    text of ASCII names, so line breaks in URLs are escaped; a NULL URL has no Target-URI field.
    """
    payload = F.encode(F.coalesce(col(body), F.lit("")), "utf-8")
    narrow = numbered(pages.select(col(page_id).cast("bigint").alias("page_id"), col(url).cast("string").alias("url"), F.sha2(payload, 256).alias("address"),
                                   F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("bigint").alias("bytes")), "row", "captures")
    shared = (narrow.groupBy("address")
              .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row")).alias("holder"), F.max("bytes").alias("size"),
                   (F.min("sha1") == F.max("sha1")).alias("one_sha1"), (F.min("bytes") == F.max("bytes")).alias("one_size")).where("n > 1"))
    holds = lambda value: F.when(F.col("size") >= min_revisit, value)
    shared = stage(shared.select("address", holds(F.col("holder.row")).alias("holder_row"), holds(record_id(F.col("holder.page_id"), F.col("holder.row"))).alias("holder_id"),
                                 F.assert_true(F.col("one_sha1") & F.col("one_size"), "two payloads share a SHA-256").alias("verified"), F.lit(True).alias("shared")), "holders")
    records = narrow.join(shared, "address", "left")
    revisit = F.col("holder_row").isNotNull() & (F.col("holder_row") != F.col("row"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    uri = _printable(F.col("url"))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")), field("WARC-Record-ID", record_id(F.col("page_id"), F.col("row"))),
        field("WARC-Date", F.lit(date)), field("WARC-Target-URI", uri), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, field("WARC-Refers-To", F.col("holder_id"))).otherwise(F.lit("")),
        F.when(revisit, F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}")).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"), field("Content-Length", length.cast("string")), F.lit(CRLF))
    records.select("row", "address", F.coalesce("shared", F.lit(False)).alias("shared"), F.encode(header, "utf-8").alias("header"),
                   F.encode(http, "utf-8").alias("http_header")).write.parquet(f"{path}/records")
    payloads = (pages.select(F.sha2(payload, 256).alias("address"), payload.alias("payload")).groupBy("address")
                .agg(F.first("payload").alias("payload"), (F.count("*") > 1).alias("shared")))
    total = narrow.agg(F.sum("bytes")).first()[0]
    if total is None:  # an empty table would have no file to tell its columns
        payloads.write.parquet(f"{path}/payloads")
        return
    # A multiple of the shuffle's partitions, so each bucket is written by one task.
    partitions = shuffle_partitions(pages.sparkSession)
    buckets = partitions * max(1, -(-total // (partitions * BUCKET_BYTES)))
    table = f"weftwork_{uuid.uuid4().hex}"
    payloads.withMetadata("payload", {"buckets": buckets}).write.bucketBy(buckets, "address").option("path", f"{path}/payloads").option("compression", "zstd").saveAsTable(table)
    pages.sparkSession.sql(f"DROP TABLE {table}")  # the name only; the files stay


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """Files that `write_archive` left in ``path``, read as the buckets they are."""
    table = f"weftwork_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} (address STRING, payload BINARY, shared BOOLEAN) USING parquet CLUSTERED BY (address) INTO {buckets} BUCKETS LOCATION '{path}'")
    files = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return files


def header_field(header: Column, name: str) -> Column:
    """Value of a field of a header block, NULL where it is missing."""
    value = F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records: ``row``, ``header``, ``http_header``, ``payload``, ``payload_bytes``, ``payload_digest``, ``record``, ``page_id``, ``record_type``, ``refers_to``.

    Each payload is hashed when it is read; an address that does not match its bytes is an error. ``record`` is the exact
    WARC record: header, HTTP header, for a response the payload, and the two line ends that close it. Only columns that are used are built.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    records = spark.read.parquet(f"{path}/records")

    def joined_with(some: DataFrame, payloads: DataFrame) -> DataFrame:
        checked = payloads.select("address", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
                                  F.assert_true(F.sha2("payload", 256) == F.col("address"), "payload differs from its address").alias("verified"))
        return some.select("row", "address", "header", "http_header").join(checked, "address", "left")

    buckets = payloads.schema["payload"].metadata.get("buckets")
    if buckets is None:  # files from elsewhere
        joined = joined_with(records, payloads)
    else:
        alone = joined_with(records.where("NOT shared"), _bucketed(spark, f"{path}/payloads", buckets).where("NOT shared"))
        joined = alone.unionByName(joined_with(records.where("shared"), payloads.where("shared")))
    lost = F.assert_true(F.col("payload_digest").isNotNull() & (header_field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))), "a record without its payload")
    page = lambda name: F.regexp_extract(header_field(F.col("header"), name), r"^<urn:page:(-?\d+):", 1).try_cast("bigint")
    kind = header_field(F.col("header"), "WARC-Type")
    record = F.concat("header", "http_header", F.when(kind == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit(CRLF * 2).cast("binary"))
    return joined.where(F.col("verified").isNull() & lost.isNull()).select(
        "row", "header", "http_header", "payload", "payload_bytes", "payload_digest", record.alias("record"), page("WARC-Record-ID").alias("page_id"), kind.alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"))


def captures(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), all read from the bytes of the rebuilt ``record`` of `read_archive`.

    The record is split at the ends of its two headers. The payload of a response is what stands behind them; that of a revisit is the one its digest refers to.
    """
    parts = F.split(F.col("record").cast("string"), CRLF * 2, 3)
    split = records.select("payload", F.concat(parts[0], F.lit(CRLF)).cast("binary").alias("head"), parts[2].cast("binary").alias("rest"))
    split = split.select("payload", "rest", *[header_field(F.col("head"), name).alias(to) for name, to in (("WARC-Type", "record_type"), ("WARC-Record-ID", "id"), ("WARC-Refers-To", "other"))])
    body = F.when(F.col("record_type") == "response", F.expr("substring(rest, 1, length(rest) - 4)")).otherwise(F.col("payload"))
    page = lambda name: F.regexp_extract(name, r"^<urn:page:(-?\d+):", 1).try_cast("bigint")
    whole = split.select(page("id").alias("page_id"), body.alias("body"), "record_type", page("other").alias("refers_to"))
    return whole.select("page_id", F.octet_length("body").cast("bigint").alias("payload_bytes"), F.sha1("body").alias("payload_digest"), "record_type", "refers_to")


def export_warc(records: DataFrame, path: str) -> None:
    """Plain ``.warc`` text files of the records of ``read_archive``, written by Spark; payloads must be UTF-8 as pages are."""
    records.select(F.decode(F.expr("substring(record, 1, length(record) - 4)"), "utf-8").alias("value")).write.option("lineSep", CRLF * 2).text(path)


_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
h AS (SELECT b, max(page_id) AS holder FROM p WHERE n >= 1000 GROUP BY b)
SELECT page_id, n AS payload_bytes, sha1(b) AS payload_digest, CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN holder <> page_id THEN holder END AS refers_to FROM p LEFT JOIN h USING (b)
"""


@query("op3_warc_archive", _SQL)
def op3(spark, root):
    path = fresh_path(spark, "archive")
    write_archive(read(spark, root, "pages"), path)
    return captures(read_archive(spark, path))
