"""WARC archives: a writer, and a sequential reader.

Writing is one gzip member a record, in archives of bounded size in a shared folder; a task names its files by
partition and attempt, and only files of attempts that ended are listed, so a task that is run again leaves no
record twice. Reading goes through each archive once, a chunk at a time: zlib decompresses member by member, headers
give the content length that frames the block, and digests are checked before a record counts.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.plans.shared import cut, join_hot, remove, scratch

CHUNK = 1 << 18
VERSION = b"WARC/1.1"
_HEX, _B32 = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


class WarcError(ValueError):
    """A record that is cut short, badly framed, or whose digest differs."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(value: str) -> bytes:
    """A header's value on one line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value).encode("utf-8", "replace")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member with a response, or with a revisit of the record of page ``refers_to``."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id), b"WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _header(url))
    if revisit:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"WARC-Payload-Digest: sha1:" + digest(payload).encode(), b"WARC-Block-Digest: sha1:" + digest(block).encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(chunks: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """The decompressed pieces of each gzip member in turn; a member left unread is read to its end."""
    rest = b""

    def one(z: object, data: bytes) -> Iterator[bytes]:
        nonlocal rest
        while True:
            if out := z.decompress(data, CHUNK):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                rest = z.unused_data
                return
            if not data:
                if not (data := next(chunks, b"")):
                    if out := z.flush():
                        yield out
                    raise WarcError("archive ends within a member")

    while data := rest or next(chunks, b""):
        rest = b""
        member = one(zlib.decompressobj(31), data)
        yield member
        for _ in member:
            pass


def _fields(raw: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in raw.split(b"\r\n")[1:])}


def parse(member: Iterator[bytes]) -> tuple[dict[bytes, bytes], bytes]:
    """Headers and block of one record, its block digest checked."""
    data = bytearray()
    end = -1
    for piece in member:
        data += piece
        if (end := data.find(b"\r\n\r\n")) >= 0:
            break
    if end < 0 or not data.startswith(b"WARC/"):
        raise WarcError("no record header")
    head = _fields(bytes(data[:end]))
    del data[: end + 4]
    size = int(head.get(b"content-length", b"-1"))
    for piece in member:
        data += piece
    if size < 0 or bytes(data[size:]) != b"\r\n\r\n":
        raise WarcError("content length does not frame the record")
    block = bytes(data[:size])
    if head.get(b"warc-block-digest") != b"sha1:" + digest(block).encode():
        raise WarcError("block digest differs")
    return head, block


def read_records(chunks: Iterator[bytes]) -> Iterator[dict]:
    """page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to of each record."""
    number = lambda v: int(v[10:-1]) if v and v[10:-1] else None  # noqa: E731  <urn:page:N>
    for m in members(chunks):
        head, block = parse(m)
        http, _, payload = block.partition(b"\r\n\r\n")
        size, told = int(_fields(http)[b"content-length"]), head[b"warc-payload-digest"].decode().removeprefix("sha1:")
        kind = head[b"warc-type"].decode()
        if kind == "response" and (size != len(payload) or told != digest(payload)):
            raise WarcError("payload digest or length differs")
        url = head.get(b"warc-target-uri")
        yield {"page_id": number(head[b"warc-record-id"]), "url": url.decode() if url is not None else None, "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": told, "record_type": kind, "refers_to": number(head.get(b"warc-refers-to"))}


def _chunks(path: str) -> Iterator[bytes]:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at) as f:
        while data := f.read(CHUNK):
            yield data


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", at_least: int = 0, roll: int = 64 << 20) -> DataFrame:
    """Write a record for each row; (archive, records, bytes) of each archive of at most about ``roll`` bytes.

    Of rows with equal payloads of ``at_least`` bytes or more, that with the largest id is a response and the
    others revisit it; rows that share this largest id, or have none to refer to, are responses. A null payload is
    empty. Ids are integers; null ids and URLs are left out of the record. Other columns are not read.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.sha1(body).alias("sha"), F.octet_length(body).alias("size"))
    best = cut(rows.where(F.col("size") >= at_least).groupBy("sha", "size").agg(F.max("id").alias("best"), F.count("*").alias("n")).where("n > 1"))
    # a payload that many pages have comes to them by broadcast, so its pages stay where they are
    ready = join_hot(rows, best, ["sha", "size"], "n", pages.count(), "left").select("id", "url", "body", F.expr("if(id <=> best, null, best)").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = TaskContext.get()
        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        stem, made, buf, n, size, out = f"part-{c.partitionId():06d}-{c.taskAttemptId()}", 0, [], 0, 0, None
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out, n, size, made
            if out is not None:
                out.close()
                done.append((f"{folder}/{stem}-{made:04d}.warc.gz", n, size))
                out, n, size, made = None, 0, 0, made + 1

        for b in batches:
            for i, u, p, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                data = record(i, u, p.as_py(), r)
                if out is None:
                    out = system.open_output_stream(f"{at}/{stem}-{made:04d}.warc.gz")
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return cut(ready.mapInArrow(run, "archive string, records long, bytes long"))


FIELDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in column ``archive``; without ``payloads`` those are checked but not returned.

    A record that is cut short, badly framed or of another digest raises WarcError. An archive is read by one
    task in chunks; records are held one at a time.
    """
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], k) for x, k in zip(names, kinds, strict=True)], names=names)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for r in read_records(_chunks(path)):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    held += len(r["payload"] or b"") + 200
                    if held >= 8 << 20:
                        yield give(rows)
                        rows, held = [], 0
                yield give(rows)

    n = max(1, min(archives.count(), 10_000))
    return archives.select("archive").repartition(n, "archive").mapInArrow(run, FIELDS)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages and read the archives back, without payloads; the archives go unless a folder is named."""
    spark = pages.sparkSession
    at = folder or scratch(spark, "warc")
    out = cut(read_warc(write_warc(pages, at), payloads=False))
    if folder is None:
        remove(spark, at)
    return out
