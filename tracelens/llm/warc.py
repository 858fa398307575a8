"""WARC archives: one gzip member for each record, written by tasks and read back in sequence.

The reader inflates a file in small blocks with incremental zlib, frames each record by its Content-Length, and checks
block and payload digests; memory is bounded by one record.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path

VERSION = b"WARC/1.1"
READ_BYTES = 1 << 16
#: Longest header of a record.
HEADER_BYTES = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if uri.startswith("file:"):
        return LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return FileSystem.from_uri(uri)


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(value: str) -> str:
    """Bare hex of a ``sha1:BASE32`` header."""
    return base64.b32decode(value.removeprefix("sha1:")).hex()


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in {**headers, "Content-Length": str(len(block))}.items())
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + deflate.flush()


def page_record(page_id, url: str | None, payload: bytes, refers_to, digest_hex: str, size: int) -> bytes:
    """The record of a page: a response with its payload, or a revisit that names another page and has none."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": " ".join((url or "urn:none").split()) or "urn:none",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": sha1_base32(block),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode(),
    }
    if revisit:
        headers |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": REVISIT}
    return record(headers, block)


class Damaged(ValueError):
    """A record that is cut short, misframed, or fails a digest."""


def framed_size(head: bytes) -> int | None:
    """Bytes of the record whose beginning is given, by its Content-Length; None while its header is not complete."""
    header, gap, _ = head.partition(b"\r\n\r\n")
    if gap:
        return len(header) + 8 + content_length(header)
    if len(head) > HEADER_BYTES:
        raise Damaged("no end of the header")
    return None


def content_length(header: bytes) -> int:
    """Content-Length of a record's header; Damaged if there is none, or no number."""
    for line in header.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            if not value.strip().isdigit():
                raise Damaged("Content-Length is no number")
            return int(value)
    raise Damaged("no Content-Length")


def members(stream) -> Iterator[bytes]:
    """Inflated members of a gzip stream, in order; a record's bytes are held once, and never more than its Content-Length tells: what goes on beyond it is Damaged."""
    held = b""
    while True:
        inflate, parts, size, most = zlib.decompressobj(31), [], 0, None
        while not inflate.eof:
            if not held and not (held := stream.read(READ_BYTES)):
                if parts or inflate.unconsumed_tail:
                    raise Damaged("cut short")
                return
            try:
                part = inflate.decompress(held, READ_BYTES)
            except zlib.error as e:
                raise Damaged(str(e)) from e
            parts.append(part)
            size += len(part)
            if most is None:
                parts = [b"".join(parts)]
                most = framed_size(parts[0])
            if most is not None and size > most:
                raise Damaged("Content-Length does not frame the record")
            held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of a record, framed by Content-Length."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise Damaged("no record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    size = content_length(head)
    if rest[size:] != b"\r\n\r\n":
        raise Damaged("Content-Length does not frame the record")
    return headers, rest[:size]


def verify(headers: dict[str, str], block: bytes) -> bytes:
    """The payload; the digests of block and payload must hold (a revisit has no payload to check)."""
    if (want := headers.get("warc-block-digest")) and want != sha1_base32(block):
        raise Damaged("block digest")
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    if headers.get("warc-type") != "revisit" and (want := headers.get("warc-payload-digest")) and want != sha1_base32(payload):
        raise Damaged("payload digest")
    return payload


def http_length(block: bytes) -> int | None:
    """Content-Length of the HTTP header that a block begins with; None if there is none, or no number."""
    for line in block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
        if line.lower().startswith(b"content-length:"):
            value = line.partition(b":")[2].strip()
            return int(value) if value.isdigit() else None
    return None


def read_file(uri: str) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, payload, payload's size); the size of a revisit's is what its HTTP header tells."""
    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        for member in members(stream):
            headers, block = parse(member)
            payload = verify(headers, block)
            size = http_length(block) if headers.get("warc-type") == "revisit" else None
            yield headers, payload, len(payload) if size is None else size


def mark_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``pages`` rows (page_id, url, html) with size, digest (hex SHA-1 of the payload) and refers_to.

    Equal payloads of ``least_bytes`` or more: the largest page_id is the response and the others refer to it. Counts meet as
    one row for each digest and task before they are shuffled; the join back is one that AQE can split at a hot digest. Smaller payloads,
    the empty ones among them, are in no join.
    """
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    sized = pages.select("page_id", "url", "html", F.octet_length(raw).cast("long").alias("size"))
    small = sized.filter(F.col("size") < least_bytes).withColumns({"digest": F.sha1(raw), "refers_to": F.lit(None).cast(pages.schema["page_id"].dataType)})
    rows = sized.filter(F.col("size") >= least_bytes).withColumn("digest", F.sha1(raw))
    top = rows.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    joined = rows.join(top.filter("n > 1").drop("n"), "digest", "left")
    large = joined.withColumn("refers_to", F.when(F.col("top") != F.col("page_id"), F.col("top")).when(F.col("page_id").isNull(), F.col("top"))).drop("top")
    return large.unionByName(small)


def write(marked: DataFrame, folder: str, target_bytes: int = 64 << 20) -> DataFrame:
    """Write one record per row below ``folder``; returns a row (path, n_records, n_bytes) for each archive.

    A task begins a new archive beyond ``target_bytes``. An archive is written under a name of the attempt and moved into place
    when complete, so a lost or repeated task leaves no part of one behind.
    """

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        done, out, part = [], None, 0

        def close():
            nonlocal out
            if out:
                out[0].close()
                final = f"pages-{context.partitionId():05d}-{len(done):04d}-{context.taskAttemptId()}.warc.gz"
                fs.move(out[1], f"{base}/{final}")
                done.append((f"{folder}/{final}", out[2], out[3]))
                out = None

        for batch in batches:
            columns = {c: batch[c] for c in ("page_id", "url", "refers_to", "digest", "size")}
            columns = {k: v.to_pylist() for k, v in columns.items()}
            for i, html in enumerate(batch["html"].cast(pa.binary())):
                page, to = columns["page_id"][i], columns["refers_to"][i]
                data = page_record(page, columns["url"][i], b"" if to is not None else html.as_py() or b"", to, columns["digest"][i], columns["size"][i])
                if out is None:
                    part += 1
                    name = f"{base}/_open-{context.taskAttemptId()}-{part}-{os.getpid()}"
                    out = [fs.open_output_stream(name, compression=None), name, 0, 0]
                out[0].write(data)
                out[2] += 1
                out[3] += len(data)
                if out[3] >= target_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "n_records", "n_bytes"])

    order = ("page_id", "url", "html", "size", "digest", "refers_to")
    return materialize(marked.select(*order).mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-list")


RECORD = "path string, record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in column ``path``, each archive read in sequence by one task.

    payload_bytes of a revisit is the size of what it refers to. No archives, or archives without records, give no rows; a record without a
    payload digest gives a null one. A damaged record fails the job.
    """

    def run(batches):
        for batch in batches:
            for uri in batch["path"].to_pylist():
                rows, held = [], 0
                for headers, payload, size in read_file(uri):
                    rows.append((uri, headers.get("warc-record-id"), headers.get("warc-type"), headers.get("warc-target-uri"),
                                 size, hex_digest(headers["warc-payload-digest"]) if "warc-payload-digest" in headers else None,
                                 headers.get("warc-refers-to"), payload if with_payload else None))
                    held += len(payload) if with_payload else 200
                    if held > 8 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    paths = archives.select("path")  # a task for each: adaptive execution would gather such small rows in one
    return paths.repartition(max(1, paths.count())).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record for each row of ``pages`` to the shared folder and reads the archives back: the contract's columns.

    Null html is an empty payload, null url 'urn:none'. A null page_id is never the largest: it revisits any other copy of 1000 bytes or more.
    Rows that repeat a page_id and payload each give a record of the same type. Only page_id, url and html are read.
    """
    folder = new_path(pages.sparkSession, "warc")
    records = read(write(mark_revisits(pages), folder), with_payload=False)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))

