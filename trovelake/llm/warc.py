"""WARC archives: write a transaction per page, read archives, assemble transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record;
request and metadata name the response in WARC-Concurrent-To.  Archives are gzip files
written and read by Spark, so they may lie in any store; a file holds a bounded number of
captures and of bytes (or one capture), and is unzipped as a stream and parsed by the lengths
in its records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovelake.llm.tables import stored, unique_keys

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Bounds of a file: captures, and bytes of their payloads and targets (or one capture alone).
FILE_CAPTURES = 1000
FILE_BYTES = 32 << 20
#: Captures of up to FILE_BYTES / FILE_CAPTURES bytes share files, and so do those of up to 8 times
#: as many, and so on.
_STEP = 8
_READ = 1 << 16
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = {
    "WARC-Type": "type", "WARC-Record-ID": "record_id", "WARC-Concurrent-To": "concurrent_to",
    "WARC-Refers-To": "refers_to", "WARC-Target-URI": "uri", "WARC-Date": "date", "WARC-Payload-Digest": "digest",
}
_RECORD = ", ".join(f"{c} string" for c in _HEADERS.values()) + ", http string, payload binary"


def _record_id(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), key.cast("string")).cast("binary"))
    parts = [F.substring(h, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: dict[str, Column | str | None], block: Column) -> Column:
    lines = [F.lit("WARC/1.1")]
    for name, value in headers.items():
        column = F.lit(value) if isinstance(value, str) else value
        lines.append(F.concat(F.lit(f"{name}: "), column))  # a null header is left out by concat_ws
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(_END, *lines), F.lit(2 * _END), block)


def write_archives(pages: DataFrame, path: str, *, date: str = "2025-01-01T00:00:00Z") -> None:
    """One transaction for each row of ``pages`` (page_id, url, html), the payload html in UTF-8.

    Null html is an empty payload.  Of rows with equal payloads (by SHA-256 and length) of at
    least 100 bytes the one with the smallest page_id is the response and the others are
    revisits of it, without a body.  Rows that share or lack a page_id count in the order of
    (page_id with nulls first, url, html).  White space and control characters in a url are
    percent-encoded; a null url gives no target.  Other columns are not read.
    """
    keyed = unique_keys(pages.select("page_id", "url", "html"), "page_id")
    payload = F.coalesce("html", F.lit(""))
    rows = keyed.select("key", F.col("page_id").cast("string").alias("page"), "url", payload.alias("html")).withColumns(
        {"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    firsts = (
        rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size")
        .agg(F.min("key").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "size", "first")
    )
    # A percent-encoded url is up to three times as long and is written four times.
    url = F.coalesce(F.octet_length("url"), F.lit(0)) * 12
    most = pages.select(F.max(_level(F.octet_length(payload) + url))).first()[0] or 0
    if most:
        firsts = stored(firsts)  # short rows; the pages are read once for each level
    rows = rows.join(firsts, ["digest", "size"], "left").withColumn("again", F.coalesce(F.col("first") < F.col("key"), F.lit(False)))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%", "%25"), "\r", "%0D"), "\n", "%0A")
    uri = F.regexp_replace(uri, r"[\x00-\x20\x7f]", "%20")
    main = F.when(F.col("again"), _record_id("revisit", F.col("key"))).otherwise(_record_id("response", F.col("key")))
    body = F.when(F.col("again"), "").otherwise(F.col("html"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(2 * _END))
    same = {"WARC-Date": date, "WARC-Target-URI": uri}
    request = _record(
        {"WARC-Type": "request", "WARC-Record-ID": _record_id("request", F.col("key")), **same,
         "WARC-Concurrent-To": main, "Content-Type": "application/http; msgtype=request"},
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + 2 * _END)))
    response = _record(
        {"WARC-Type": F.when(F.col("again"), "revisit").otherwise("response"), "WARC-Record-ID": main, **same,
         "WARC-Refers-To": F.when(F.col("again"), _record_id("response", F.col("first"))),
         "WARC-Profile": F.when(F.col("again"), _PROFILE),
         "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest")),
         "Content-Type": "application/http; msgtype=response"},
        F.concat(http, body))
    metadata = _record(
        {"WARC-Type": "metadata", "WARC-Record-ID": _record_id("metadata", F.col("key")), **same,
         "WARC-Concurrent-To": main, "Content-Type": "application/warc-fields"},
        F.concat(F.lit("page_id: "), F.coalesce("page", F.lit("")), F.lit(_END)))
    level = _level(F.when(F.col("again"), 0).otherwise(F.col("size")) + url)
    value = F.concat_ws(2 * _END, request, response, metadata).alias("value")
    for n in range(most + 1):
        captures = max(1, FILE_CAPTURES // _STEP**n)
        # The first condition holds wherever the second does, and keeps smaller pages out of the join.
        lines = rows.where((_level(F.col("size") + url) >= n) & (level == n)).select(value)
        lines.write.mode("append").option("lineSep", 2 * _END).option("compression", "gzip").option(
            "maxRecordsPerFile", captures).text(path)


def _level(size: Column) -> Column:
    """How many times a capture is ``_STEP`` times larger than those of which a file holds the most."""
    found, n = F.lit(0), 0
    while FILE_CAPTURES // _STEP**n > 1:
        found += (size > FILE_BYTES // FILE_CAPTURES * _STEP**n).cast("int")
        n += 1
    return found


def parse(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, whose bytes come in chunks of any size."""
    source, held = iter(chunks), bytearray()

    def more() -> bool:
        chunk = next(source, None)
        held.extend(chunk or b"")
        return chunk is not None

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[:-4]
            if not more():
                return
        del held[:at]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("an archive ends inside a record")
        lines = held[:end].decode("utf-8", "replace").split(_END)[1:]
        headers = {name: value.strip() for name, _, value in (line.partition(":") for line in lines)}
        past = end + 4 + int(headers["Content-Length"])
        while len(held) < past:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield headers, bytes(held[end + 4 : past])
        del held[:past]


def _unzipped(data: memoryview) -> Iterator[bytes]:
    at, zipped = 0, bytes(data[:2]) == b"\x1f\x8b"
    while zipped and bytes(data[at : at + 2]) == b"\x1f\x8b":  # members follow each other
        member = zlib.decompressobj(31)
        while not member.eof:
            part = data[at : at + _READ]
            if not part:
                raise ValueError("an archive ends inside a compressed member")
            yield member.decompress(part)
            at += len(part) - len(member.unused_data)
    for start in range(0, 0 if zipped else len(data), _READ):
        yield bytes(data[start : start + _READ])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``, gzipped or not: headers, HTTP head and payload.

    The payload of an application/http block is what follows its head, else the whole block.
    Missing headers are null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in [*_HEADERS.values(), "http"]] + [("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for headers, block in parse(_unzipped(memoryview(content.as_buffer()))):
                    head = None
                    if headers.get("Content-Type", "").startswith("application/http"):
                        head, _, block = block.partition(b"\r\n\r\n")
                        head = head.decode("utf-8", "replace")
                    rows.append((*(headers.get(h) for h in _HEADERS), head, block))
                    size += len(block)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``response`` (or revisit), ``requests`` and ``metadata``.

    Requests and metadata join the response that their concurrent-to names; where no record
    has that id, the capture has a null response.  Records that name none, other than
    responses and revisits, belong to no capture.
    """
    own = ["record_id", "type", "uri", "date", "digest", "refers_to", "http", "payload"]
    main = records.where(F.col("type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.struct(*own).alias("response"))
    others = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    part = F.struct("record_id", "uri", "date", "http", "payload")
    grouped = others.groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        *(F.sort_array(F.collect_list(F.when(F.col("type") == kind, part))).alias(name)
          for kind, name in (("request", "requests"), ("metadata", "metadata"))))
    return main.join(grouped, "capture_id", "full")
