"""Web archives with an index: one gzip member per record, found again by file, offset and length.

Writing: a task streams its rows into a file of its own and returns one index row per record, which Spark commits as a
table. A file of an attempt that is lost is never named by the index, so retried tasks do no harm. Reading starts from rows
of the index: sorted by file and offset, neighbours are fetched by one range read.

Pages are rows (page_id, url, html). A null html is an empty payload. Of equal payloads of at least ``revisit_bytes`` bytes
the record with the largest page_id is the response and the others revisit it; rows that share that largest id are all
responses, and so are rows of which no copy has an id. A null id is below all others. A null url is left out of the record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import table, written
from vulnlake.session import ensure_checkpoint_dir

INDEX = ("page_id bigint, url string, digest string, payload_bytes bigint, record_type string, refers_to bigint, "
         "file string, offset bigint, length bigint")
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload string"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                    ("length", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.string())])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, record_type, refers_to).

    Copies are found on digests alone: groups are aggregated with map-side reduction, and only rows that revisit another are
    joined back to the payloads.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    keys = rows.filter(F.col("payload_bytes") >= revisit_bytes).select("page_id", "digest")
    first = (keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
             .filter("n > 1 AND refers_to IS NOT NULL").drop("n"))
    again = (keys.distinct().join(first, "digest").filter("page_id IS NULL OR page_id < refers_to")
             .select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to"))
    return (rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
            .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")).drop("_id", "_digest"))


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 1000, file_bytes: int = 256 << 20,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the records below ``folder`` (any file system that pyarrow opens) and returns their index, itself a table."""
    names = ["page_id", "url", "payload", "digest", "payload_bytes", "record_type", "refers_to"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open_store(folder)
        store.create_dir(top, recursive=True)
        out, name, place = None, None, 0
        try:
            for batch in batches:
                found = []
                for values in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True):
                    row = dict(zip(names, values, strict=True))
                    member = gzip.compress(_record(row, date), compresslevel=6, mtime=0)
                    if out is None or place >= file_bytes:
                        if out is not None:
                            out.close()
                        name, place = f"{top}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(name, compression=None)  # members are compressed one by one
                    out.write(member)
                    row |= {"file": name.rsplit("/", 1)[1], "offset": place, "length": len(member)}
                    found.append(row)
                    place += len(member)
                yield pa.RecordBatch.from_pylist(found, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return written(with_revisits(pages, revisit_bytes).select(*names).mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, gap_bytes: int = 64 << 10, read_bytes: int = 8 << 20,
                 payloads: bool = True) -> DataFrame:
    """The records that the index rows name, read from the archives.

    Rows are dealt out by file and stretch of the file and sorted, so a task's reads go forward. Neighbours at most
    ``gap_bytes`` apart share a read of at most ``read_bytes`` (or one record, if that is longer). Digest and size of a
    response are those of the bytes read; a revisit has those of its headers and no payload.
    """
    stretch = F.floor(F.col("offset") / read_bytes)
    dealt = index.select("file", "offset", "length").repartition("file", stretch).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open_store(folder)
        for name, start, spans in _ranges(batches, gap_bytes, read_bytes):
            with store.open_input_file(f"{top}/{name}") as source:
                source.seek(start)
                block = source.read(spans[-1][0] + spans[-1][1] - start)
            part, held = [], 0
            for at, length in spans:
                row = _parsed(gzip.decompress(block[at - start:at - start + length]))
                held += row["payload_bytes"]
                if not payloads:
                    row["payload"] = None
                part.append(row)
                if held > 4 * read_bytes:
                    yield pa.RecordBatch.from_pylist(part, schema=_RECORD)
                    part, held = [], 0
            if part:
                yield pa.RecordBatch.from_pylist(part, schema=_RECORD)

    return dealt.mapInArrow(read, RECORD)


def _open_store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "", 1))


def _ranges(batches: Iterator[pa.RecordBatch], gap: int, most: int):
    """(file, start, [(offset, length)]) of neighbours to be read at once."""
    name, spans, start, end = None, [], 0, 0
    for batch in batches:
        for file, at, length in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if spans and (file != name or at - end > gap or at + length - start > most):
                yield name, start, spans
                spans = []
            if not spans:
                name, start = file, at
            spans.append((at, length))
            end = at + length
    if spans:
        yield name, start, spans


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _record(row: dict, date: str) -> bytes:
    payload = row["payload"].encode("utf-8", "surrogatepass")
    block = _HTTP + (payload if row["record_type"] == "response" else b"")
    page = "" if row["page_id"] is None else str(row["page_id"])
    headers = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {row['digest']}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if row["url"] is None else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in row["url"])),
        ("WARC-Payload-Digest", f"sha1:{_base32(row['digest'])}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("X-Page-Id", page),
        ("X-Payload-Length", str(row["payload_bytes"])),
        ("WARC-Profile", _REVISIT if row["record_type"] == "revisit" else None),
        ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row['refers_to']} {row['digest']}')}>"
         if row["record_type"] == "revisit" else None),
        ("X-Refers-To-Page", None if row["refers_to"] is None else str(row["refers_to"])),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _parsed(record: bytes) -> dict:
    head, rest = record.split(b"\r\n\r\n", 1)
    headers = dict(x.decode("utf-8", "surrogatepass").split(": ", 1) if b": " in x else (x.decode().rstrip(":"), "")
                   for x in head.split(b"\r\n")[1:])
    block = io.BytesIO(rest).read(int(headers["Content-Length"]))
    payload = block.split(b"\r\n\r\n", 1)[1]
    number = lambda key: int(headers[key]) if headers.get(key) else None
    row = {"page_id": number("X-Page-Id"), "url": headers.get("WARC-Target-URI"), "record_type": headers["WARC-Type"],
           "refers_to": number("X-Refers-To-Page")}
    if row["record_type"] == "revisit":
        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        return row | {"payload_digest": digest, "payload_bytes": number("X-Payload-Length"), "payload": None}
    return row | {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload),
                  "payload": payload.decode("utf-8", "surrogatepass")}


def op5_warc_round_trip(spark, folder):
    archives = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(table(spark, folder, "pages"), archives)
    return read_records(index, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < newest THEN newest END AS refers_to
FROM g
"""
