"""WARC archives with revisit resolution.

Headers (id, payload digests and length) are shuffled by digest, partly summed up before; of equal payloads
one record becomes the response and the others revisits of it, written without their payload under fresh
headers. Payloads count as equal by their SHA-256, as SHA-1, which the format names, can be forged. Reading joins
each revisit to its response again. Archives are written and read by Spark itself, so they can lie in any
store; their records are parsed by their Content-Length, never by looking for separators in payloads.
"""

from __future__ import annotations

import hashlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm.common import BROADCAST_BYTES, held_bytes, join_by_hot_key, materialize, sized_join, unique_columns
from kinsift.plans.lineage import shared_path

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_OF_CONV = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 as 32 upper-case base32 digits: five hex digits make four of them."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_OF_CONV, BASE32_DIGITS)


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0) -> DataFrame:
    """(record): the bytes of a WARC record a page, without the two line ends that close it.

    Null payloads are empty. Of equal payloads of min_bytes at least, the page with the largest id (a null
    id is below all) is the response and the others its revisits; rows that repeat that id are responses
    each. A null url has no header line; line ends in a url are escaped. Extra columns play no part.
    """
    payload = F.coalesce(F.col("_payload").cast("binary"), F.lit("").cast("binary"))
    rows = unique_columns(pages, [id_col, url_col, payload_col])
    rows = rows.select(rows[id_col].alias("id"), F.regexp_replace(rows[url_col].cast("string"), "[\r\n]", "%0A").alias("url"), rows[payload_col].alias("_payload"))
    rows = rows.select("id", "url", payload.alias("payload")).withColumn("digest", sha1_base32(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("sha", F.sha2("payload", 256))
    headers = rows.select("id", "url", "sha", "bytes").filter(F.col("bytes") >= min_bytes)
    groups = headers.groupBy("sha").agg(F.max(F.struct("id", "url")).alias("first"), F.count(F.lit(1)).alias("records"), F.first("bytes").alias("size")).filter("records > 1")
    groups = materialize(groups.select("sha", "records", F.col("first.id").alias("_id"), F.col("first.url").alias("_url"), F.lit(True).alias("_shared")), "payloads")
    total = groups.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    # beyond the bound only very common payloads' headers are broadcast, and their rows stay where they are
    joined = rows.join(F.broadcast(groups), "sha", "left") if held_bytes(groups) <= BROADCAST_BYTES else join_by_hot_key(rows, groups, "sha", "records", max(1, total))
    revisit = F.coalesce(F.col("_shared") & ~F.col("id").eqNullSafe(F.col("_id")), F.lit(False))
    http = F.concat(F.lit(HTTP_HEAD), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    head = F.concat(
        F.lit(VERSION + CRLF),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.when(revisit, F.uuid()).otherwise(record_id(F.col("id"), F.col("url"), F.col("sha"))), F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("X-Page-Id", F.col("id").cast("string")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            _header("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), record_id(F.col("_id"), F.col("_url"), F.col("sha")), F.lit(">"))),
            _header("WARC-Refers-To-Target-URI", F.col("_url")),
            _header("WARC-Refers-To-Date", F.lit(date)),
            _header("WARC-Profile", F.lit(REVISIT_PROFILE)),
        )).otherwise(F.lit("")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(CRLF), http,
    )
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return joined.select(F.concat(head.cast("binary"), body).alias("record"))


#: Records of up to so many bytes, and how many of them a file gets: 128 MiB at most, or a record.
FILES = ((64 << 10, 2048), (1 << 20, 128), (16 << 20, 8), (None, 1))


def write_warc(records: DataFrame, path: str, files: tuple[tuple[int | None, int], ...] = FILES) -> None:
    """Writes records to WARC files below path, by size; each ends with two line ends, as the format says."""
    size = F.octet_length("record")
    kind = F.coalesce(*[F.when(F.lit(most is None) | (size <= (most or 0)), i) for i, (most, _) in enumerate(files)])
    found = [x[0] for x in records.select(kind.alias("kind")).distinct().collect()]  # a few numbers
    for i in sorted(found):
        # the text writer puts bytes out as they are
        own = records.filter(kind == i).select(F.col("record").cast("string").alias("value"))
        own.write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", files[i][1]).text(f"{path}/{i}")
    if not found:
        records.select(F.col("record").cast("string").alias("value")).write.text(f"{path}/0")


def parse_warc(content: bytes) -> Iterator[dict]:
    """The records of an archive: their headers, in lower case, and their block under '' ; ValueError if it is broken."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = content[at:end].decode("utf-8", "replace").split(CRLF)
        fields: dict = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        length = int(fields["content-length"])
        fields[""] = content[end + 4 : end + 4 + length]
        if len(fields[""]) != length or content[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield fields
        at = end + 8 + length


RECORDS = "page_id string, url string, record_type string, record_id string, refers_to_record string, payload_digest string, payload_bytes bigint, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row a record: RECORDS. Digest and length of responses are those of the payload read; a revisit has its header's digest and null length and payload."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for r in parse_warc(content.as_buffer().to_pybytes()):
                    response = r["warc-type"] == "response"
                    payload = r[""].partition(b"\r\n\r\n")[2] if response else None
                    digest = b32encode(hashlib.sha1(payload).digest()).decode() if response else r["warc-payload-digest"].partition(":")[2]
                    rows.append((r.get("x-page-id"), r.get("warc-target-uri"), r["warc-type"], r["warc-record-id"], r.get("warc-refers-to"), digest, len(payload) if response else None, payload if with_payload else None))
                for first in range(0, len(rows), 1000):
                    columns = list(zip(*rows[first : first + 1000], strict=True))
                    types = [pa.string()] * 6 + [pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Joins each revisit to its response: page_id, payload_bytes, payload_digest, record_type, refers_to (its page_id).

    A response that very many revisits refer to is broadcast to them; the others meet by record id. A
    revisit whose response is missing keeps null length and refers_to.
    """
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", F.col("refers_to_record").alias("key"))
    asked = materialize(revisits.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "asked")
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    originals = responses.select(F.col("record_id").alias("key"), F.col("page_id").alias("refers_to"), "payload_bytes").dropDuplicates(["key"])
    originals = materialize(sized_join(originals, asked, "key", "inner"), "originals")
    found = join_by_hot_key(revisits, originals, "key", "n", max(1, total))
    found = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return found.unionByName(responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to")))


def archive_and_resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes the deduplicated archives of pages to the shared folder and reads them back: a row a page as resolve_revisits gives it."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    path = shared_path(spark, "warc")
    write_warc(warc_records(pages, id_col, url_col, payload_col, min_bytes=min_bytes), path)
    records = materialize(read_warc(spark, path, with_payload=False).drop("payload"), "records")
    back = resolve_revisits(records)
    return back.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
