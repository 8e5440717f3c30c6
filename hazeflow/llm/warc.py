"""WARC archives: write a transaction per page, read the archives back, and assemble one row per capture.

A page becomes a request, a response (or a revisit of the response with an equal payload) and a metadata
record; the request and the metadata name the response in WARC-Concurrent-To. Archives are gzip files that Spark's
text writer makes where the pages are; reading parses whole files of bounded size in Arrow batches. The records of
a transaction are then joined on the response's identifier: as all three sides come from one scan and share
that key, the join is one grouping, with one shuffle of the columns that are asked for. Identifiers are unique, so
no key is hot.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hazeflow.llm.frames import col
from hazeflow.scratch import materialize

MIN_PAYLOAD = 0  # payloads of at least so many bytes are revisited
PAGES_PER_FILE = 5_000
BROADCAST_DIGESTS = 500_000  # repeated payloads are sent to all tasks up to this count (30 MB)
DATE = "2024-01-01T00:00:00Z"
BREAK = "\r\n\r\n"
_SPACE = uuid.UUID("8d3c9a52-6a0e-5d0c-9c0b-6f0c5f1f7a10")
RECORD = (
    "capture string, record_id string, type string, refers_to string, target_uri string, payload_digest string, "
    "payload binary, page_id string, payload_bytes bigint, block string"
)


def _name(kind: str, page, url, digest: str, copy: int = 0) -> str:
    """Identifier of a record; `copy` tells equal pages apart."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, repr((kind, page, url, digest, *([copy] if copy else []))))}>"


def _record(fields: list[tuple[str, str | None]], block: str) -> str:
    head = [f"{name}: {value}" for name, value in fields if value is not None]
    size = len(block.encode("utf-8", "surrogatepass"))
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {size}"]) + BREAK + block


def _transaction(page, url, html, keeper: dict | None, copy: int = 0) -> str:
    payload = html or ""
    data = payload.encode()
    digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
    visited = keeper is not None and len(data) >= MIN_PAYLOAD and (page, url, copy) != (keeper["page"], keeper["url"], 0)
    uri = None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=-._~|^`{}\\\"<>")
    ids = {kind: _name(kind, page, url, digest, copy) for kind in ("response", "request", "metadata")}
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}{BREAK}"
    response = [("WARC-Type", "revisit" if visited else "response"), ("WARC-Record-ID", ids["response"]), *shared]
    response += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if visited:
        response += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        response += [("WARC-Refers-To", _name("response", keeper["page"], keeper["url"], digest))]
    target = "/" if uri is None else "/" + uri.partition("://")[2].partition("/")[2]
    request = [("WARC-Type", "request"), ("WARC-Record-ID", ids["request"]), *shared, ("WARC-Concurrent-To", ids["response"]), ("Content-Type", "application/http; msgtype=request")]
    metadata = [("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), *shared, ("WARC-Concurrent-To", ids["response"]), ("Content-Type", "application/warc-fields")]
    host = "" if uri is None else uri.partition("://")[2].partition("/")[0]
    about = ([] if page is None else [f"page-id: {page}"]) + [f"payload-length: {len(data)}"]
    return BREAK.join(
        [
            _record(request, f"GET {target} HTTP/1.1\r\nHost: {host}{BREAK}"),
            _record(response, http if visited else http + payload),
            _record(metadata, "\r\n".join(about) + "\r\n"),
        ]
    )


def _transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            rows = batch.slice(begin, 1000).to_pylist()
            made = [_transaction(r["page"], r["url"], r["html"], r["keeper"], r["copy"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pages_per_file: int = PAGES_PER_FILE) -> None:
    """Write a transaction per page as gzip archives under `path`.

    Of pages with equal payloads the one with the largest id (ties: the largest url) is the response, the
    others revisit it. A null html is an empty payload. Payloads are compared by SHA-1, counted map-side. Equal
    pages are a transaction each; the first is written where its copies meet, the others are numbered.
    """
    slim = pages.select(col(id_col).alias("page"), col(url_col).alias("url"), F.coalesce(col(html_col), F.lit("")).alias("html"))
    keyed = slim.withColumn("digest", F.sha1("html"))
    rows = keyed.groupBy(F.col("page").alias("p"), F.col("url").alias("u"), F.col("digest").alias("again")).agg(F.count(F.lit(1)).alias("n"))
    repeated = rows.groupBy("again").agg(F.max(F.struct(F.col("p").alias("page"), F.col("u").alias("url"))).alias("keeper"), F.sum("n").alias("all"), F.max("n").alias("equal"))
    repeated = materialize(repeated.filter("all > 1"), "repeated-payloads")
    keyed = keyed.withColumn("copy", F.lit(0).cast("long"))
    if repeated.filter("equal > 1").limit(1).count():  # equal pages: one of each, gathered map-side, stands for its copies
        equal = materialize(rows.filter("n > 1"), "equal-pages")
        same = F.col("page").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("digest") == F.col("again"))
        one = keyed.join(equal, same, "left_semi").dropDuplicates(["page", "url", "digest"]).drop("copy").join(equal, same)
        one = one.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        keyed = keyed.join(equal, same, "left_anti").unionByName(one.select(*keyed.columns))
    repeated = repeated.select("again", "keeper")
    if repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    joined = keyed.join(repeated, F.col("digest") == F.col("again"), "left").select("page", "url", "html", "keeper", "copy")
    # the separator ends each transaction's last record
    lines = joined.mapInArrow(_transactions, "value string").write.option("lineSep", BREAK).option("compression", "gzip")
    lines.option("maxRecordsPerFile", pages_per_file).text(path)


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at, gap = 0, BREAK.encode()
    while at < len(data):
        end = data.index(gap, at)
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = dict(line.split(": ", 1) for line in lines)
        begin = end + len(gap)
        at = begin + int(fields["Content-Length"])
        yield fields, data[begin:at]
        at += len(gap)


def _parsed(fields: dict[str, str], block: bytes) -> dict:
    kind, own = fields["WARC-Type"], fields.get("WARC-Record-ID")
    row = {"capture": fields.get("WARC-Concurrent-To", own), "record_id": own, "type": kind, "target_uri": fields.get("WARC-Target-URI")}
    if kind in ("response", "revisit"):
        row |= {"payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": fields.get("WARC-Refers-To")}
        head, _, payload = block.partition(BREAK.encode())
        row["block"] = head.decode()
        if kind == "response":
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != row["payload_digest"]:
                raise ValueError(f"{own}: payload and digest differ")
            row |= {"payload": payload, "payload_bytes": len(payload)}
    else:
        row["block"] = block.decode()
        if kind == "metadata":
            about = dict(line.split(": ", 1) for line in row["block"].split("\r\n") if line)
            row |= {"page_id": about.get("page-id"), "payload_bytes": int(about["payload-length"])}
    return row


_ROW = pa.schema(
    [(n, pa.string()) for n in ("capture", "record_id", "type", "refers_to", "target_uri", "payload_digest")]
    + [("payload", pa.binary()), ("page_id", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.string())]
)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows: list[dict] = []
            for fields, block in _records(gzip.decompress(content.as_py())):
                rows.append(_parsed(fields, block))
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ROW)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under `path`; payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse_files, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """(capture, request, response, metadata): one nested row per transaction; a record it lacks is null."""

    def of(kinds: list[str], *fields: str):
        return F.max(F.when(F.col("type").isin(kinds), F.struct(*fields)))

    return records.groupBy("capture").agg(
        of(["request"], "record_id", "target_uri", "block").alias("request"),
        of(["response", "revisit"], "type", "record_id", "target_uri", "payload_digest", "refers_to", "block", "payload").alias("response"),
        of(["metadata"], "record_id", "page_id", "payload_bytes", "block").alias("metadata"),
    )


def page_captures(found: DataFrame, page_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a row per capture.

    `refers_to` is the page whose response a revisit names, found by joining on the record identifier; a payload
    that a third of all pages share makes a skewed join with one row per key on its other side.
    """
    page = F.col("metadata.page_id").cast(page_type).alias("page_id")
    of = [F.col(f"response.{c}").alias(c) for c in ("record_id", "payload_digest", "refers_to", "type")]
    slim = materialize(found.select(page, F.col("metadata.payload_bytes").alias("payload_bytes"), *of), "captures")
    targets = slim.filter("type = 'response'").select(F.col("record_id").alias("named"), F.col("page_id").alias("response_page"))
    joined = slim.join(targets, F.col("refers_to") == F.col("named"), "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("response_page").alias("refers_to"))


def archived(pages: DataFrame, path: str, id_col: str = "page_id", **columns) -> DataFrame:
    """Write `pages` under `path`, read them back, and give `page_captures`.

    Null ids are kept (as captures without an id; they revisit where the payload has an id). Of equal pages with the
    largest id one is the response, its copies revisit it. An archive is held in memory while it is read: with very long
    payloads pass fewer `pages_per_file` to `write_archives`. An empty table gives none; other columns are ignored.
    """
    write_archives(pages, path, id_col, **columns)
    return page_captures(captures(read_records(pages.sparkSession, path)), pages.schema[id_col].dataType.simpleString())
