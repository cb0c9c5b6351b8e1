"""WARC archives in which repeated payloads are revisit records.

1. Capture: every page gets its payload's length and digest; the headers, without payloads, are
   written.
2. Resolve: headers are grouped by digest; the record with the largest page_id is the response, and
   every other one joins it and becomes a revisit of it.
3. Write: pages join the decisions on their own (page_id, digest), and the records go as text through
   Spark's own file writer, compressed, so a lost task is written again and no half archive stays. A
   response holds an HTTP response with the payload; a revisit holds the HTTP headers, and refers to
   the response by record id, URL and date.
4. Read: archives are parsed by Content-Length, so a payload may hold anything, record marks too.

Scale: payloads are shuffled once, to archives of about `archive_bytes` before compression. A digest
that a third of all pages share is one row after partial aggregation; the join back to headers is
between two written tables, where adaptive execution splits hot keys. An archive is read at a time.

Defined results: null html is an empty payload; a null URL is written as an empty target; a null
page_id is below all others and is read back as null; of rows with equal payload and page_id one
(with the last URL) is the response; payloads below `min_bytes` are all responses; an empty table
gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from seriesmill.llm.common import named, new_path, written

ARCHIVE_BYTES = 16 << 20
RECORDS_PER_FILE = 50_000
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "payload_bytes long, refers_to string, page_id long, refers_to_page long, payload string"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@F.pandas_udf(StringType())
def payload_digest(payloads: pd.Series) -> pd.Series:
    """Base32 SHA-1 of texts in UTF-8."""
    return payloads.map(lambda x: digest_of(x.encode()))


def captures(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, row_key (page and payload)."""
    rows = pages.select(
        named(id_col).cast("long").alias("page_id"),
        # a line break would end the header that the URL stands in
        F.regexp_replace(F.coalesce(named(url_col), F.lit("")), "[\\r\\n]", " ").alias("url"),
        F.coalesce(named(payload_col), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("payload_digest", payload_digest("payload"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return rows.withColumn("row_key", F.concat_ws(":", page, "payload_digest"))


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """A written table: row_key, and key, page and URL of the response to its payload."""
    headers = headers.where(F.col("payload_bytes") >= min_bytes)
    best = F.max(F.struct("page_id", "url", "row_key")).alias("response")
    responses = written(headers.groupBy("payload_digest").agg(best), "warc-responses")
    pages = headers.select("row_key", "payload_digest").distinct()
    decided = pages.join(responses, "payload_digest").select(
        "row_key",
        F.col("response.row_key").alias("original_key"),
        F.col("response.page_id").alias("original_page"),
        F.col("response.url").alias("original_url"),
    )
    return written(decided, "warc-decided")


def record_id(row_key: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row_key}:{place}')}>"


def record_text(row) -> str:
    """A record but for the last line end, which the file writer adds.

    The first row of its key (place 1) is the response if the key is the original's.
    """
    revisit = row.original_key is not None and (row.original_key != row.row_key or row.place > 1)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n"
    block = http if revisit else http + row.payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(row.row_key, row.place)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {row.url}",
        f"WARC-Payload-Digest: sha1:{row.payload_digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block.encode())}",
        f"X-Page-ID: {row.page_id or ''}",
    ]
    if revisit:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(row.original_key, 1)}",
            f"WARC-Refers-To-Target-URI: {row.original_url}",
            f"WARC-Refers-To-Date: {DATE}",
            f"X-Refers-To-Page-ID: {row.original_page or ''}",
        ]
    return "\r\n".join(head) + "\r\n\r\n" + block + "\r\n"


def record_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"value": [record_text(x) for x in rows.itertuples(index=False)]}, dtype=object)


def write_archives(captured: DataFrame, path: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes a record per captured row to a new folder of archives."""
    headers = written(captured.drop("payload"), "warc-headers")
    total = headers.agg(F.sum(F.col("payload_bytes") + 800)).first()[0] or 0
    if not total:
        return
    dealt = captured.repartition(int(-(-total // archive_bytes)), "row_key")
    decided = dealt.join(resolve(headers, min_bytes), "row_key", "left")
    place = F.row_number().over(Window.partitionBy("row_key").orderBy(F.desc("url")))
    records = decided.withColumn("place", place)
    # as text, since pandas has no nulls among integers
    records = records.withColumns({x: F.col(x).cast("string") for x in ("page_id", "original_page")})
    texts = records.mapInPandas(record_texts, "value string")
    texts.write.options(lineSep="\r\n", compression="gzip", maxRecordsPerFile=RECORDS_PER_FILE).text(path)


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, each by its Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        length = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut")
        http, _, payload = block.partition(b"\r\n\r\n")
        kept = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and digest_of(payload) != digest:
            raise ValueError(f"payload of the record at byte {at} does not fit its digest")
        number = lambda name: int(head[name]) if head.get(name) else None
        yield {
            "record_id": head["WARC-Record-ID"],
            "record_type": head["WARC-Type"],
            "target_uri": head["WARC-Target-URI"],
            "date": head["WARC-Date"],
            "payload_digest": digest,
            "payload_bytes": int(kept.split(": ")[1]),
            "refers_to": head.get("WARC-Refers-To"),
            "page_id": number("X-Page-ID"),
            "refers_to_page": number("X-Refers-To-Page-ID"),
            "payload": payload.decode() if head["WARC-Type"] == "response" else None,
        }
        at = end + 8 + length


def parse_archives(batches):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in RECORDS.split(", "))])
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for record in parse_archive(gzip.decompress(content.as_py())):
                rows.append(record)
                held += len(record["payload"] or "")
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record; see RECORDS."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    return files.mapInArrow(parse_archives, RECORDS)


def archived(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes pages to archives and reads the records back."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    if pages.isEmpty():
        return spark.createDataFrame([], RECORDS)
    captured = captures(pages)
    write_archives(captured, path, min_bytes)
    return read_archives(spark, path)
