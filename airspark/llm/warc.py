"""WARC archives with revisit records.

The payload digests of all records are shuffled as narrow rows; the record with the
largest id of each repeated payload stays a response, the others become revisits that
refer to it. Records are then written to archives of bounded size through Spark's
writer (a mean number of records each), whose commit keeps a repeated task from leaving half a file, and read back by
their Content-Length. Reading resolves revisits by joining them to their responses.

Defined cases: a null html is an empty payload, a null url an empty one; control
characters in a url are percent-encoded, so that no url can end a header; a null
page_id has a record of its own and never stands for others; rows that repeat a page_id
each get a record; payloads below ``least`` bytes are all responses; an empty table
gives no archive and an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airspark.llm.common import arrow_schema
from airspark.session import scratch_path, written

LEAST = 1000
#: Payload bytes that an archive holds on average.
ARCHIVE_BYTES = 32 << 20
EOL = "\r\n"
DATE = "1970-01-01T00:00:00Z"


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest and payload_bytes of every row."""
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.sha1(_payload().cast("binary")).alias("payload_digest"),
        F.octet_length(_payload()).cast("long").alias("payload_bytes"),
    )


def originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """For each payload of several pages the page that keeps it; counted before the shuffle."""
    return (
        headers(pages)
        .where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("original"), F.min("page_id").alias("_least"))
        .where(F.col("original") != F.col("_least"))
        .drop("_least")
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Write deduplicated archives below ``path`` and return the decisions (page_id, original)."""
    sums = headers(pages).agg(F.coalesce(F.avg("payload_bytes"), F.lit(0)).alias("mean")).first()
    records_each = max(1, int(archive_bytes / (sums["mean"] + 600)))  # 600 bytes of headers
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        _payload().alias("html"),
        F.sha1(_payload().cast("binary")).alias("payload_digest"),
        F.octet_length(_payload()).cast("long").alias("payload_bytes"),
    )
    # Only revisits: pages whose payload another page keeps. Narrow rows, so a payload
    # of many pages makes a long but thin join that Spark may split.
    revisits = written(
        headers(pages)
        .join(originals(pages, least), ["payload_digest", "payload_bytes"])
        .where(F.col("page_id") != F.col("original"))
        .select("page_id", "payload_digest", "original")
        .distinct(),
        "revisits",
    )
    # Its size is known: a small table of revisits goes to all tasks and payloads are not
    # shuffled; for a large one Spark joins by page.
    records = source.join(revisits, ["page_id", "payload_digest"], "left")
    plain = F.col("url")
    for code in [*range(32), 127]:
        plain = F.replace(plain, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    uri = F.when(F.col("url").rlike("[\\x00-\\x1f\\x7f]"), plain).otherwise(F.col("url"))
    http = F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}{EOL}")
    first = F.col("original").isNull()
    block = F.when(first, F.concat(http, F.col("html"))).otherwise(http)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(EOL))
    record = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.when(first, "response").otherwise("revisit")),
        line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(first, F.lit("")).otherwise(
            F.concat(
                line("WARC-Refers-To", name(F.col("original"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            )
        ),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(EOL),
        block,
    )
    records.select(record.alias("value")).write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_each).text(path)
    return revisits


RECORDS = "record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, html string"
_RECORD_ARROW = arrow_schema(
    record_type=pa.string(), page_id=pa.int64(), url=pa.string(), payload_digest=pa.string(),
    payload_bytes=pa.int64(), refers_to=pa.int64(), html=pa.large_string(),
)


def parse_archive(data: bytes) -> Iterator[tuple]:
    """Records of an unpacked archive by their Content-Length; digests are computed anew."""
    from hashlib import sha1

    number = lambda s: None if (x := s[10:-1]) == "none" else int(x)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(EOL)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        at = end + 4 + len(block) + 4
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        stated, page = head["WARC-Payload-Digest"].removeprefix("sha1:"), number(head["WARC-Record-ID"])
        if head["WARC-Type"] == "revisit":
            yield "revisit", page, head["WARC-Target-URI"], stated, None, number(head["WARC-Refers-To"]), None
            continue
        if (digest := sha1(payload).hexdigest()) != stated:
            raise ValueError(f"payload of page {page} does not match its digest")
        yield "response", page, head["WARC-Target-URI"], digest, len(payload), None, payload.decode()


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """All records as written; the payload only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for value in batch.column("content"):
                data = zlib.decompress(value.as_buffer(), wbits=31)
                rows = list(parse_archive(data))
                for i in range(0, len(rows), 2000):
                    some = [r if payloads else (*r[:6], None) for r in rows[i : i + 2000]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*some), _RECORD_ARROW)], schema=_RECORD_ARROW
                    )

    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile")
    # A task holds one archive at a time.
    return files.load(path).where("length > 0").select("content").mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Give every revisit the size of the response it refers to, found by page and digest."""
    revisit = F.col("record_type") == "revisit"
    kept = (
        records.where(~revisit)
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("payload_bytes").alias("_bytes"))
    )
    back = records.where(revisit).drop("payload_bytes").join(kept, ["refers_to", "payload_digest"], "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where(~revisit).select(*names).unionByName(back.withColumnRenamed("_bytes", "payload_bytes").select(*names))


def archive_pages(pages: DataFrame, least: int = LEAST, path: str | None = None) -> DataFrame:
    """Write all pages as archives and return what reading them back gives, one row per page."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, least)
    return resolved(read_records(spark, path))
