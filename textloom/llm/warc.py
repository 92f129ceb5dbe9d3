"""WARC archives: writing captures with revisits, reading records, assembling transactions.

Each page is a request, a response or revisit, and a metadata record, tied by
WARC-Concurrent-To. Archives are written by Spark's own text sink (a row is one transaction,
the separator is the record's closing line pair), so they go to any file system that Spark
knows and a lost task writes its files anew. Reading splits files by Content-Length alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

CRLF = "\r\n"
CLOSE = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Transactions of one file, and the bytes of a payload up to which that many may share one; readers hold a file at a time.
FILE_RECORDS = 4000
SMALL = 1 << 16

RECORD = (
    "record_id string, type string, target_uri string, concurrent_to string, refers_to string, date string, "
    "payload_digest string, http_status int, payload_bytes long, stored_digest string, stored_bytes long, block string"
)


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a digest given in hexadecimal digits (a multiple of 40 bits)."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for at in range(1, 41, 5):
        twenty = F.conv(F.substring(hex_digest, at, 5), 16, 10).cast("int")
        parts += [F.substr(alphabet, F.shiftright(twenty, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def urn(*parts: Column | str) -> Column:
    """A record id made of the md5 of the parts."""
    h = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, first (the page that holds the payload; null for itself).

    Of the pages with one payload of at least ``least`` bytes the smallest page_id holds it. That
    is one aggregation over digests with partial sums; payloads are shuffled once, for the join.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", base32(F.sha1(F.col("payload")))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    firsts = rows.select("page_id", "digest").groupBy("digest").agg(F.min("page_id").alias("least_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "least_id")
    joined = rows.join(firsts, F.col("digest") == F.col("d"), "left")
    first = F.when((F.col("payload_bytes") >= least) & F.col("least_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least_id")), F.col("least_id"))
    return joined.select("page_id", "url", "payload", "digest", "payload_bytes", first.alias("first"))


def transactions(typed: DataFrame, date: str = DATE) -> DataFrame:
    """value: the three records of each page, without the last one's closing lines; serial, digest, payload_bytes."""

    def record(kind: Column | str, record_id: Column, fields: list[Column], content_type: str, block: Column) -> Column:
        head = [F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(CRLF + "WARC-Record-ID: "), record_id, F.lit(CRLF + f"WARC-Date: {date}" + CRLF), *fields]
        return F.concat(*head, F.lit(f"Content-Type: {content_type}" + CRLF + "Content-Length: "), F.octet_length(block).cast("string"), F.lit(CLOSE), block)

    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]+", "%20")
    rows = typed.withColumn("serial", F.monotonically_increasing_id()).withColumn("uri", uri)
    request_id = urn("request", F.col("page_id"), F.col("serial"))
    response_id = F.when(F.col("first").isNull(), urn("response", F.col("page_id"), F.col("digest"))).otherwise(urn("revisit", F.col("page_id"), F.col("serial")))
    host = F.regexp_extract("uri", r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_replace("uri", r"^[a-z]+://[^/?#]*|#.*$", "")
    request = F.concat(F.lit("GET "), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)), F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CLOSE))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CLOSE))
    revisit = F.col("first").isNotNull()
    shared = [field("WARC-Target-URI", F.col("uri"))]
    answer_fields = [
        *shared,
        field("WARC-Concurrent-To", F.col("request_id")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", urn("response", F.col("first"), F.col("digest"))))).otherwise(F.lit("")),
    ]
    about = F.to_json(F.struct("page_id", "url"), {"ignoreNullFields": "false"})
    rows = rows.withColumn("request_id", request_id).withColumn("response_id", response_id)
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    value = F.concat(
        record("request", F.col("request_id"), [*shared, field("WARC-Concurrent-To", F.col("response_id"))], "application/http;msgtype=request", request),
        F.lit(CLOSE),
        record(kind, F.col("response_id"), answer_fields, "application/http;msgtype=response", F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))),
        F.lit(CLOSE),
        record("metadata", urn("metadata", F.col("page_id"), F.col("serial")), [*shared, field("WARC-Concurrent-To", F.col("request_id"))], "application/json", about),
    )
    return rows.select(value.alias("value"), "serial", "digest", "payload_bytes")


def write(pages: DataFrame, path: str, least: int = 0, date: str = DATE, file_records: int = FILE_RECORDS, small: int = SMALL) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files under ``path``.

    A file holds ``file_records`` transactions with payloads of ``small`` bytes at most. Larger
    ones are dealt by hash into folders of their own, a few to each, the fewer the larger they
    are, so that a file stays at about as many bytes.
    """
    typed = with_types(pages, least)
    large = pages.select(F.octet_length("html").alias("b")).where(F.col("b") > small)
    weigh = F.greatest(F.lit(1.0), F.lit(float(file_records)) * F.lit(small) / F.col("b"))  # transactions of that size to a file
    parts = large.agg(F.ceil(F.sum(1 / weigh) * 2)).first()[0] or 0
    if parts:
        part = F.when(F.col("payload_bytes") > small, 1 + F.pmod(F.xxhash64("serial", "digest"), F.lit(parts))).otherwise(0)
        out = transactions(typed, date).withColumn("part", part).select("value", "part").write.partitionBy("part")
    else:
        out = transactions(typed, date).select("value").write
    out.option("lineSep", CLOSE).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)
    spark = pages.sparkSession
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = to_path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(folder, True)
    names = []
    while files.hasNext():  # names only; one for each file
        names.append(files.next().getPath().toString())
    for name in names:
        if name.endswith(".txt.gz"):
            fs.rename(to_path(name), to_path(name.removesuffix(".txt.gz") + ".warc.gz"))


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an open archive."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("the archive ends inside a record")
        yield headers, block


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under ``path`` in the columns of ``RECORD``.

    ``stored_digest`` and ``stored_bytes`` are computed from the payload as it was read.
    ``block`` is the payload of a response and the whole block of others; with ``payload``
    false it is left out for responses, which keeps later shuffles small.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path).select("content")
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("http_status", pa.int32()), ("payload_bytes", pa.int64()), ("stored_digest", pa.string()), ("stored_bytes", pa.int64()), ("block", pa.string())])

    def row(headers: dict[str, str], block: bytes) -> dict:
        kind = headers.get("warc-type")
        out = {"record_id": headers.get("warc-record-id"), "type": kind, "target_uri": headers.get("warc-target-uri"), "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"), "date": headers.get("warc-date")}
        if kind in ("response", "revisit"):
            head, _, body = block.partition(b"\r\n\r\n")
            lines = head.split(b"\r\n")
            http = {n.strip().lower(): v.strip() for n, _, v in (x.partition(b":") for x in lines[1:])}
            out["http_status"] = int(lines[0].split(b" ")[1]) if lines[0].startswith(b"HTTP/") else None
            out["payload_digest"] = headers.get("warc-payload-digest", "").rpartition(":")[2]
            out["payload_bytes"] = int(http.get(b"content-length", len(body)))
            if kind == "response":
                out["stored_digest"] = base64.b32encode(hashlib.sha1(body).digest()).decode()
                out["stored_bytes"] = len(body)
                block = body if payload else b""
        out["block"] = block.decode("utf-8", "replace")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                stream = pa.BufferReader(raw)
                opened = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if raw[:2].to_pybytes() == b"\x1f\x8b" else io.BufferedReader(stream)
                rows, size = [], 0
                for headers, block in parse(opened):
                    rows.append(row(headers, block))
                    size += len(rows[-1]["block"]) + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response (or revisit), metadata.

    Responses and metadata name their request in WARC-Concurrent-To; one shuffle by that id
    brings a transaction together. What a transaction lacks is null; of several records of a
    kind the one of the greatest id counts.
    """
    capture = F.when(F.col("type") == "request", F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    whole = F.struct(*[c for c in records.columns])
    pick = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), whole))
    held = records.where(F.col("type").isin("request", "response", "revisit", "metadata"))
    return held.groupBy(capture.alias("capture_id")).agg(pick("request").alias("request"), pick("response", "revisit").alias("response"), pick("metadata").alias("metadata"))


def captures(pages: DataFrame, path: str | None = None, least: int = 0, payload: bool = False) -> DataFrame:
    """Write ``pages`` as archives, read them back, and assemble: one row per page.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to (the page_id
    of the response that a revisit stands for), and the nested request, response, metadata.
    Null html is the empty payload; a null url is written as about:blank and comes back null.
    A null page_id comes back null and holds a payload only if no other page has it. Rows that
    repeat the smallest page_id of a payload are all responses. Extra columns are not archived.
    Long payloads go whole, in files of few transactions. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or common.new_path(spark, "warc")
    write(pages, path, least)
    rows = assemble(read_records(spark, path, payload))
    about = F.from_json(F.col("metadata.block"), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string")
    rows = common.materialise(rows.withColumn("about", about), "captures")
    holders = rows.where(F.col("response.type") == "response").select(F.col("response.record_id").alias("holder"), F.col("about.page_id").alias("refers_to")).dropDuplicates(["holder"])
    joined = rows.join(holders, F.col("response.refers_to") == F.col("holder"), "left")
    return joined.select(
        F.col("about.page_id").alias("page_id"),
        F.col("about.url").alias("url"),
        F.coalesce("response.stored_bytes", "response.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.stored_digest", "response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        "refers_to",
        "request",
        "response",
        "metadata",
    )
