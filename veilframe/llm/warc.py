"""A web archive that stores every payload once, under its digest.

``write_archive`` keeps two tables in a folder: ``payloads`` (SHA-256 and bytes,
one row per different payload) and ``headers`` (one row per record: the exact
header bytes and the digest of the payload they belong to).  ``reconstruct`` joins both
to the original records, ``read_records`` parses these again and checks them.  Spark
reads and writes all of it, so any store that the cluster shares will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.scratch import written

#: Digits of base 32 as numbers are written, and as digests are (RFC 4648).
BASE32_NUMBER = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGEST = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records of pages without one; fixed, so reruns agree.
DATE = "1970-01-01T00:00:00Z"
#: The length of a revisited payload; a revisit's own block is empty.
PAYLOAD_LENGTH = "X-Payload-Length"
_BREAK = "\r\n\r\n"


def base32(sha1_hex: Column) -> Column:
    """The base32 form of 40 hex digits: five of these are four of those."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_NUMBER, BASE32_DIGEST)


def _header(*fields: tuple[str, Column]) -> Column:
    """Header lines; a field whose value is NULL is left out, line breaks in values become blanks."""
    lines = [F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\\r\\n]+", " ")) for name, value in fields]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"))


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _records(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.unhex(F.sha2(payload, 256)).alias("sha256"), payload.alias("payload"))


def write_archive(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html",
                  least_revisit_bytes: int = 0, date: str = DATE) -> None:
    """Write the archive of ``pages`` into ``folder``: each payload once, then the headers.

    Of pages with equal payloads of at least ``least_revisit_bytes``, the one with
    the largest id is the response and the others revisit it.  A NULL payload is
    empty.  Rows that repeat the largest id are responses as well; a page without
    an id revisits whenever one with an id has its payload.  Other columns are not
    read, empty tables give empty archives.

    Payloads move once, by digest, and copies are dropped before they move, so a
    payload that a third of all pages share is one row per task.  Headers are put in
    order by digest and id, over ranges of rows; a digest's largest id is its first, and
    ranges tell each other by one row per digest and range.  So no digest is one task.
    """
    spark = pages.sparkSession
    rows = _records(pages, page_id, url, html)
    (rows.groupBy("sha256").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads"))
    narrow = written(rows.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes")),
                     "records")
    by = [F.col("sha256"), F.col("page_id").desc_nulls_last()]
    placed = written(narrow.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id()), "ordered-records")
    first = F.first("keeper").over(Window.partitionBy("sha256").orderBy("range"))
    keepers = placed.groupBy("sha256", "range").agg(F.max("page_id").alias("keeper")).select("sha256", "range", first.alias("keeper"))
    kept = placed.join(keepers, ["sha256", "range"])
    revisit = (F.col("payload_bytes") >= least_revisit_bytes) & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    header = _header(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", page_urn(F.col("page_id"))),
        ("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("WARC-Refers-To", F.when(revisit, page_urn(F.col("keeper")))),
        (PAYLOAD_LENGTH, F.when(revisit, F.col("payload_bytes"))), ("Content-Type", F.when(~revisit, "text/html")),
        ("Content-Length", F.when(revisit, 0).otherwise(F.col("payload_bytes"))))
    kept.select("page_id", "sha256", revisit.alias("is_revisit"), F.encode(header, "UTF-8").alias("header")).write.parquet(f"{folder}/headers")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Stored payloads, each checked against its digest; a damaged one ends the job."""
    true = F.unhex(F.sha2("payload", 256))
    checked = F.when(true == F.col("sha256"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.hex("sha256"))).cast("binary"))
    return spark.read.parquet(f"{folder}/payloads").select("sha256", checked.alias("payload"))


def field(header: Column, name: str) -> Column:
    """A header field's value, NULL without it."""
    value = F.regexp_extract(header.cast("string"), f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)
    return F.when(value != "", value)


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """The original records, byte for byte: page_id, sha256 and record (header, payload and the closing line breaks).

    A response meets its payload by a join on the digest; revisits have an empty block
    and meet none, however many there are of one payload.
    """
    headers, end = spark.read.parquet(f"{folder}/headers"), F.lit(_BREAK).cast("binary")
    responses = headers.where("NOT is_revisit").join(read_payloads(spark, folder), "sha256").withColumn("record", F.concat("header", "payload", end))
    revisits = headers.where("is_revisit").withColumn("record", F.concat("header", end))
    return responses.select("page_id", "sha256", "record").unionByName(revisits.select("page_id", "sha256", "record"))


def read_records(records: DataFrame) -> DataFrame:
    """Rebuilt records as rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    All columns come from the record's bytes.  A response whose block is not as long as its
    header says, or has another digest, ends the job; so does a revisit of a payload that no
    response has by this digest and length.
    """
    record = F.col("record")
    # The header ends at the first empty line; the cast keeps the bytes as they are.
    head = F.substring_index(record.cast("string"), _BREAK, 1)
    split = records.select(F.concat(head, F.lit("\r\n")).alias("header"), F.expr(
        "substring(record, octet_length(substring_index(CAST(record AS STRING), '\\r\\n\\r\\n', 1)) + 5)").alias("rest"))
    block = F.substring(F.col("rest"), F.lit(1), F.octet_length("rest") - 4)
    fields = split.select(
        "header", block.alias("block"), *(field(F.col("header"), n).alias(a) for n, a in (
            ("WARC-Type", "record_type"), ("WARC-Record-ID", "id"), ("WARC-Refers-To", "target"), ("WARC-Target-URI", "url"), ("WARC-Payload-Digest", "digest"),
            ("Content-Length", "size"), (PAYLOAD_LENGTH, "revisited"))))
    response = F.col("record_type") == "response"
    sound = (F.octet_length("block") == F.col("size").cast("long")) & (~response | (F.col("digest") == F.concat(F.lit("sha1:"), base32(F.sha1("block")))))

    def number(urn: str) -> Column:
        found = F.regexp_extract(urn, "<urn:page:(-?[0-9]+)>", 1)
        return F.when(found != "", found.cast("long"))

    rows = written(fields.select(
        F.when(F.coalesce(sound, F.lit(False)), number("id")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "id")).cast("long")).alias("page_id"),
        F.when(response, F.col("size")).otherwise(F.col("revisited")).cast("long").alias("payload_bytes"),
        F.substring("digest", 6, 32).alias("payload_digest"), "record_type", number("target").alias("refers_to"), "url"), "warc-rows")
    known = ["payload_digest", "payload_bytes"]
    lost = rows.where("record_type = 'revisit'").select(*known).distinct().join(rows.where("record_type = 'response'").select(*known).distinct(), known, "left_anti").first()
    if lost:
        raise ValueError(f"revisit of a payload that is not there: {lost.payload_digest}")
    return rows
