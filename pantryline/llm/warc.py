"""WARC archives written from a table and read back as a chunked record table.

``write_archives`` writes one gzip member per record to files in the shared folder. Of rows with equal payloads of at
least ``least_bytes``, that with the largest page_id is the ``response``; the others become ``revisit`` records that
name its record and page and carry no payload. Rows are decided by digests: if the payloads that occur several times are few
(``FEW``), their digests are broadcast and payloads go from the scan to the archive; else rows meet them in a shuffle.
A payload is compressed from the Arrow batch's own memory, a chunk at a time.

``read_chunks`` streams archives, these or others: a payload comes as rows (record_id, chunk, ...) of at most
``chunk_bytes`` each, each with the SHA-1 of the payload up to its end, so the last chunk's is the payload's; it is compared with the
header's digest there (``verified``). Only responses and other records with an HTTP message lose its header; of records of
other types (warcinfo, resource, ...) the whole block is the payload. Header names count in any case. Neither side holds more
than a chunk of an archive beside the row as given; a record of any size takes bounded memory on reading.

A task writes to a file of its own attempt and renames it at the end, and only renamed files are listed by the rows
that it returns, so a lost executor leaves nothing that is read.

Nulls: a null payload or url is empty; a null page_id is below all others, and its record names no page. Rows that are
equal in page_id and payload are records of their own; if they hold the largest page_id of their payload, each is a
response. Other columns of the pages are neither read nor returned, so none can clash. An empty table gives no archive and no
chunk.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantryline.llm.common import written

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for URLs
CHUNK = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("is_last", T.BooleanType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("header_digest", T.StringType()),
        T.StructField("header_bytes", T.LongType()),
        T.StructField("bytes_so_far", T.LongType()),
        T.StructField("sha1_so_far", T.StringType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("data", T.BinaryType()),
    ]
)
#: Of so many digests at most a set is broadcast (some 8 MB).
FEW = 100_000
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])


def decide_records(pages: DataFrame, payload: str = "html", least_bytes: int = 1000) -> DataFrame:
    """``pages`` (page_id, url, payload) as page_id, url, payload (binary), sha1, n_bytes, winner (page_id or null)."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("n_bytes"))
    groups = rows.select("sha1", "n_bytes", "page_id").filter(F.col("n_bytes") >= least_bytes).groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    several = written(groups.filter("n > 1").drop("n"), "several")
    return rows.join(F.broadcast(several) if several.count() <= FEW else several, ["sha1", "n_bytes"], "left")


def _record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{sha1}')}>"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _pack(out: io.IOBase, header: list[str], body: list[bytes | memoryview], chunk_bytes: int) -> None:
    """One gzip member; the body goes through in chunks."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out.write(squeeze.compress(("\r\n".join(header) + "\r\n\r\n").encode()))
    for part in body:
        for i in range(0, len(part), chunk_bytes):
            out.write(squeeze.compress(memoryview(part)[i : i + chunk_bytes]))
    out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())


def _clean(text: str) -> str:
    """A header's value on one line."""
    return "".join(x if x.isprintable() else "%" + f"{ord(x):02X}" for x in text)


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = 1 << 20) -> DataFrame:
    """Writes what ``decide_records`` returns to ``path``; returns (path, records), a row for each archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, out = TaskContext.get(), 0, None
        store, folder = _filesystem(path)
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{name}.tmp", compression=None)
            thin = batch.select([x for x in batch.schema.names if x != "payload"]).to_pylist()
            for r, payload in zip(thin, batch.column("payload"), strict=True):
                revisit = r["winner"] is not None and r["winner"] != r["page_id"]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['n_bytes']}\r\n\r\n".encode()
                body = [http] if revisit else [http, memoryview(payload.as_buffer())]
                header = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(r['page_id'], r['sha1'])}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(r['sha1'])).decode()}"]
                header += ["Content-Type: application/http;msgtype=response", f"Content-Length: {sum(map(len, body))}", f"X-Payload-Length: {r['n_bytes']}"]
                header += [f"WARC-Target-URI: {_clean(r['url'] or '')}"] * bool(r["url"]) + [f"X-Page-Id: {r['page_id']}"] * (r["page_id"] is not None)
                if revisit:
                    header += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(r['winner'], r['sha1'])}", f"X-Refers-To-Page-Id: {r['winner']}"]
                _pack(out, header, body, chunk_bytes)
                n += 1
        if out is not None:
            out.close()
            store.move(f"{name}.tmp", name)
            yield pa.RecordBatch.from_pylist([{"path": name, "records": n}])

    return records.select("page_id", "url", "payload", "sha1", "n_bytes", "winner").mapInArrow(write, FILES)


def _hex(digest: str) -> str | None:
    """A header's SHA-1, which is in base 32 or base 16, as lower-case hex; null for another algorithm or none."""
    kind, _, value = digest.partition(":")
    if kind.lower() != "sha1" or len(value) not in (32, 40):
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _chunks(stream: io.BufferedReader, chunk_bytes: int, keep: bool) -> Iterator[dict]:
    """Rows of one archive, in order."""
    while version := stream.readline():
        if version == b"\r\n":
            continue
        head: dict[str, str] = {}
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.partition(b":")
            head[k.decode().strip().lower()] = v.decode().strip()
        left = int(head["content-length"])
        if head.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
            while left:  # the HTTP header
                line = stream.readline(left)
                if not line:
                    raise EOFError("an archive ends within a record")
                left -= len(line)
                if line in (b"\r\n", b"\n"):
                    break
        sha1, seen, chunk = hashlib.sha1(), 0, 0
        kind, digest = head.get("warc-type", ""), _hex(head.get("warc-payload-digest", ""))
        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
        row = {"record_id": head.get("warc-record-id"), "record_type": kind, "page_id": number("x-page-id"), "url": head.get("warc-target-uri", ""), "refers_to": number("x-refers-to-page-id"), "header_digest": digest, "header_bytes": number("x-payload-length")}
        while True:
            data = stream.read(min(chunk_bytes, left))
            if left and not data:
                raise EOFError("an archive ends within a record")
            left -= len(data)
            seen += len(data)
            sha1.update(data)
            so_far = sha1.hexdigest()
            verified = so_far == digest if digest and not left and kind != "revisit" else None
            yield row | {"chunk": chunk, "is_last": not left, "bytes_so_far": seen, "sha1_so_far": so_far, "verified": verified, "data": data if keep else None}
            chunk += 1
            if not left:
                break
        stream.read(4)


def read_chunks(files: DataFrame, path: str, chunk_bytes: int = 64 << 10, keep_data: bool = True) -> DataFrame:
    """The chunked record table of the archives that ``files`` (path, ...) lists; ``path``: the folder, for its scheme.

    A record without payload, as a revisit, has one chunk of no bytes. ``keep_data=False`` leaves the data null.
    ``verified``: of a last chunk, whether the payload's SHA-1 is that of its header; null elsewhere, of revisits and without such
    a header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(path)
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(x.name, kinds[x.dataType.typeName()]) for x in CHUNK])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as packed, io.BufferedReader(packed, 1 << 16) as stream:
                    for row in _chunks(stream, chunk_bytes, keep_data):
                        rows.append(row)
                        held += len(row["data"] or b"") + 300
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path").mapInArrow(read, CHUNK)


def page_records(files: DataFrame, path: str) -> DataFrame:
    """One row per record from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's bytes and digest are those counted over its chunks; a revisit's come from its header. A payload that is not what
    its header says is an error.
    """
    last = read_chunks(files, path, keep_data=False).filter("is_last")
    last = last.filter(F.when(F.coalesce("verified", F.lit(True)), True).otherwise(F.raise_error(F.concat(F.lit("damaged payload in "), "record_id"))))
    revisit = F.col("record_type") == "revisit"
    return last.select("page_id", F.when(revisit, F.col("header_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"), F.when(revisit, F.col("header_digest")).otherwise(F.col("sha1_so_far")).alias("payload_digest"), "record_type", "refers_to")
