"""WARC archives, index first.

Writing yields, besides the archives, an index row per record: file, offset, length, URL and digest.
Reading starts from selected index rows: they are sorted by file and offset, neighbouring byte ranges
are coalesced into few reads, and the records are parsed from these.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm._store import cut, new_folder

# fixed values of the WARC 1.1 format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed once it has reached this size.
ROLL_BYTES = 256 << 20
#: Ranges at most this far apart are read at once, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Index rows of so many bytes of one archive are read by one task.
SPLIT_BYTES = 32 << 20

INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("record_type", pa.string())])
RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _field(value: str) -> str:
    """A header value: what would end its line is percent-encoded."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; a revisit (``refers_to`` given) carries no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_field(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response"]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"] if revisit else []
    head += [f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """The fields of RECORD from one gzip member; a stored payload is checked against its digest."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"), "payload": None if revisit else payload,
    }


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row into archives under ``folder`` (default: a new one in the shared folder); returns the index.

    The payload is the html in UTF-8, null is empty. Of equal payloads of at least ``min_bytes``, the row
    with the smallest id is a response and the others revisit it; smaller payloads are all responses. Rows
    that repeat the smallest id are responses, too; null ids come last. A null URL is left out; control
    characters in URLs are percent-encoded. An archive's name is its task attempt's own, and only the
    index of finished tasks names archives, so a repeated task does no harm. An empty table gives an empty index.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    first = rows.where(F.col("size") >= min_bytes).groupBy("key", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = rows.join(first, ["key", "size"], "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))

    def write(batches):
        files, out, name, at = None, None, None, 0
        for batch in batches:
            index = []
            for r in batch.to_pylist():
                if out is None:
                    files, path = fs.FileSystem.from_uri(folder)
                    files.create_dir(path, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                payload = r["html"].encode()
                data = record(r["page_id"], r["url"], payload, r["refers_to"], date)
                out.write(data)
                index.append((f"{folder}/{name}", at, len(data), r["url"], r["page_id"], payload_digest(payload), "response" if r["refers_to"] is None else "revisit"))
                at += len(data)
                if at >= ROLL_BYTES:
                    out.close()
                    out = None
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*index, strict=True), INDEX.types, strict=True)] if index else [pa.array([], t) for t in INDEX.types], schema=INDEX)
        if out is not None:
            out.close()

    index = dealt.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(write, "file string, offset long, length long, url string, page_id long, digest string, record_type string")
    return cut(index, "warc-index")


def read_warc(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that the ``index`` rows name: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Rows may be any selection of an index, repeats included; columns besides file, offset and length are
    ignored. An archive's rows are dealt by byte range, so a large archive is no single task.
    """

    def coalesced(batches):
        span: list = []
        for batch in batches:
            for f, o, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if span and (f != span[0][0] or o - (span[-1][1] + span[-1][2]) > GAP_BYTES or o + n - span[0][1] > READ_BYTES):
                    yield span
                    span = []
                span.append((f, o, n))
        if span:
            yield span

    def read(batches):
        opened, name = None, None
        for span in coalesced(batches):
            if name != span[0][0]:
                name = span[0][0]
                files, path = fs.FileSystem.from_uri(name)
                opened = files.open_input_file(path)
            start = span[0][1]
            data = opened.read_at(max(o + n for _, o, n in span) - start, start)
            found = [parse(data[o - start : o - start + n]) for _, o, n in span]
            if not payload:
                found = [r | {"payload": None} for r in found]
            yield pa.RecordBatch.from_pylist(found, schema=RECORD)

    part = (F.col("offset") / SPLIT_BYTES).cast("long")
    # a number of tasks of its own: index rows are small, so that Spark would read all archives in one task
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // SPLIT_BYTES))
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", part).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
