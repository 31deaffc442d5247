"""WARC archives: a writer with one gzip member per record, and a splittable reader.

Writer. A payload's SHA-1 groups the rows (map-side combine); of equal payloads
of at least ``min_revisit_bytes`` bytes the smallest page_id becomes a response,
the others become revisit records that carry no payload. Each task writes one
archive into the shared folder under a name of its own attempt and reports it, so
a task that runs again leaves nothing that is read.

Reader. A task gets a byte range of an archive, looks for the gzip magic, accepts a
candidate only if its first bytes decode to a WARC header, the whole member
decodes with its checksum and the archive ends or another member begins after
it, and owns every record that starts inside its range (it reads past the end to
finish the last one). After a member the next one is expected right behind it.

Defined cases: null html is an empty payload; a null url has no target header; a
row whose page_id is null is never referred to; rows equal in page_id and payload
are all responses if theirs is the smallest page_id; an empty table writes nothing
and reads nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, remove_at_end

MAGIC = b"\x1f\x8b\x08"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_bytes(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit if refers_to is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{refers_to}:{digest}')}>", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = _HTTP + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> dict:
    """Header fields and payload of one record; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:] if ": " in x)}
    block = rest[: int(h["content-length"])]
    if len(block) != int(h["content-length"]):
        raise ValueError("a record ends early")
    payload = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("a payload differs from its digest")
    from urllib.parse import unquote

    return {
        "page_id": int(h["x-page-id"]) if "x-page-id" in h else None,
        "url": unquote(h["warc-target-uri"]) if "warc-target-uri" in h else None,
        "record_type": h["warc-type"],
        "payload_bytes": int(h["x-payload-length"]) if "x-payload-length" in h else len(payload),
        "payload_digest": digest,
        "refers_to": int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None,
        "payload": payload,
    }


def _write_task(folder: str):
    def run(batches):
        t = TaskContext.get()
        fs, base = _filesystem(folder)
        name = f"part-{t.partitionId():06d}-{t.taskAttemptId()}.warc.gz"
        fs.create_dir(base, recursive=True)
        n = size = 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for b in batches:
                for page, url, html, refers in zip(b.column("page_id"), b.column("url"), b.column("html"), b.column("refers_to")):
                    x = gzip_member(record_bytes(page.as_py(), url.as_py(), html.as_py() or b"", refers.as_py()))
                    out.write(x)
                    n, size = n + 1, size + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size], "records": [n]}, pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return run


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> list[tuple[str, int]]:
    """Writes the archives and returns (file, bytes) of each: one per task, never more than tasks."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    keyed = p.select("page_id", F.octet_length("html").alias("n"), F.sha1("html").alias("sha"))
    same = keyed.where(F.col("n") >= min_revisit_bytes).groupBy("sha").agg(F.count("*").alias("rows"), F.min("page_id").alias("first")).where("rows > 1 and first is not null")
    again = keyed.where(F.col("n") >= min_revisit_bytes).join(same, "sha").where("page_id is null or page_id <> first")
    # by page, not by payload: a payload that many pages share meets no single task
    again = again.select(F.coalesce("page_id", F.lit(-1)).alias("k"), F.col("page_id").isNull().alias("none"), "sha", F.col("first").alias("refers_to")).distinct()
    p = p.withColumns({"k": F.coalesce("page_id", F.lit(-1)), "none": F.col("page_id").isNull(), "sha": F.sha1("html")})
    out = p.join(again, ["k", "none", "sha"], "left").select("page_id", "url", "html", "refers_to").mapInArrow(_write_task(folder), "file string, bytes long, records long")
    files = [(r["file"], r["bytes"]) for r in out.collect()]  # one row a task
    if files:
        remove_at_end(pages.sparkSession, folder)
    return files


def _members(read, size: int, start: int, end: int, window: int = 1 << 18):
    """(offset, bytes) of the decoded members that start in [start, end). read(at, n) gives bytes."""
    at = start
    while at < end:
        # the next magic at or after at
        found, pos = -1, at
        while pos < end and found < 0:
            piece = read(pos, min(window, end - pos) + 2)
            i = piece.find(MAGIC)
            if i >= 0 and pos + i < end:
                found = pos + i
            elif len(piece) <= 2:
                return
            else:
                pos += len(piece) - 2
        if found < 0:
            return
        got = _decode(read, size, found, window)
        if got is None:
            at = found + 1
        else:
            data, after = got
            yield found, data
            at = after


def _decode(read, size: int, at: int, window: int):
    """The member at ``at`` and the offset after it, or None if none starts there."""
    z, parts, pos = zlib.decompressobj(31), [], at
    try:
        first = z.decompress(read(pos, 4096))
        pos += 4096
        while len(first) < 7 and not z.eof and pos < size:
            first += z.decompress(read(pos, 4096))
            pos += 4096
        if not first.startswith(b"WARC/1."):
            return None
        parts.append(first)
        while not z.eof and pos < size:
            parts.append(z.decompress(read(pos, window)))
            pos += window
    except zlib.error:
        return None
    if not z.eof:
        return None
    after = min(pos, size) - len(z.unused_data)
    if after < size and read(after, 3) != MAGIC:
        return None
    return b"".join(parts), after


def _read_task(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for b in batches:
            for uri, size, start, end in zip(*(b.column(c).to_pylist() for c in ("file", "size", "start", "end"))):
                fs, path = _filesystem(uri)
                with fs.open_input_file(path) as f:

                    def read(at, n, f=f, size=size):
                        return f.read_at(min(n, max(0, size - at)), at)

                    rows, held = [], 0
                    for _, data in _members(read, size, start, end):
                        r = parse_record(data)
                        held += len(data)
                        if not with_payload:
                            r["payload"] = None
                        rows.append(r)
                        if len(rows) >= 2000 or with_payload and held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_warc(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = 4 << 20, with_payload: bool = True) -> DataFrame:
    """Records of archives of gzip members, each file cut into ranges of ``split_bytes``."""
    df = spark.createDataFrame(files, "file string, size long").where("size > 0")
    starts = F.explode(F.expr(f"sequence(0L, size - 1, {int(split_bytes)}L)"))
    df = df.repartition(max(1, min(len(files), 4096)), "file").select("file", "size", starts.alias("start"))
    df = df.repartition(max(1, min(sum(-(-n // split_bytes) for _, n in files), 100_000)), "file", "start")
    df = df.withColumn("end", F.least("size", F.col("start") + split_bytes)).select("file", "size", "start", "end")
    return df.mapInArrow(_read_task(with_payload), RECORDS)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, split_bytes: int = 4 << 20, with_payload: bool = False) -> DataFrame:
    """Writes archives of all pages and reads them back."""
    spark = pages.sparkSession
    files = write_warc(pages, fresh_path(spark, "warc"), min_revisit_bytes)
    return read_warc(spark, files, split_bytes, with_payload)
