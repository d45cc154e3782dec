"""WARC archives: writing, normalising monolithic gzip files, and reading by offset index (operator 1).

``normalise`` is the operator: an archive that was compressed as one gzip stream is inflated once, in pieces, and every
record is written as a gzip member of its own, with a sidecar index of offsets. Any record can then be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, written
from .files import read_from, write_to

# Fixed values of the WARC format.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PIECE = 1 << 20


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, told: str, refers_to: int | None = None) -> bytes:
    """One record. A response holds HTTP headers and the payload; a revisit only headers, and names the page that it repeats."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    clean = "".join(c for c in (url or "") if c > " " and c != "\x7f")
    head = [
        VERSION,
        b"WARC-Type: " + kind.encode(),
        b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{kind}:{told}")).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + clean.encode("utf-8", "replace"),
        b"WARC-Payload-Digest: sha1:" + told.encode(),
        b"X-Page-Id: " + (b"" if page_id is None else b"%d" % page_id),
    ]
    if kind == "revisit":
        head += [b"WARC-Profile: " + SAME_PAYLOAD.encode(), b"X-Refers-To-Page-Id: %d" % refers_to]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflated(source, piece: int = PIECE) -> Iterator[bytes]:
    """A gzip file inflated in pieces of at most ``piece`` bytes, one member or many."""
    unpack, raw = zlib.decompressobj(31), b""
    while True:
        raw = raw or source.read(piece)
        if not raw:
            if not unpack.eof and source.tell():
                raise ValueError("the gzip stream ends early")
            return
        if unpack.eof:
            unpack = zlib.decompressobj(31)
        out = unpack.decompress(raw, piece)
        raw = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
        if out:
            yield out


class Stream:
    """Bytes by count or up to a mark, from an iterator of pieces; holds what has been read and not yet taken."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the stream."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """Exactly ``size`` bytes, in pieces."""
        while size:
            if not self.held and not self.more():
                raise ValueError("the archive ends inside a record")
            part = bytes(self.held[:size])
            del self.held[: len(part)]
            size -= len(part)
            yield part


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """``(header text, pieces of the whole record)`` of each record of an inflated archive; a record's pieces must be used up."""
    stream = Stream(pieces)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should start")
        size = int(headers(head)["content-length"])

        def whole(head=head, size=size) -> Iterator[bytes]:
            yield head
            yield from stream.take(size + 4)

        yield head, whole()


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes archives of the rows ``page_id, url, payload (binary), told, kind, refers_to``, each one gzip stream.

    One file per task; returns the manifest ``file`` of those that hold. Records stand in the order of the rows.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, packer = f"mono-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, None
        for batch in batches:
            for page_id, url, payload, told, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, packer = write_to(f"{folder}/{name}"), zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(packer.compress(record(kind, page_id, url, payload, told, refers)))
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name]})

    rows = pages.select("page_id", "url", "payload", "told", "kind", "refers_to")
    rows.mapInArrow(save, "file string").write.parquet(f"{folder}/written")
    return pages.sparkSession.read.parquet(f"{folder}/written")


def normalise(files: DataFrame, source: str, target: str, level: int = 1) -> DataFrame:
    """Rewrites each archive named in ``files (file)`` below ``source`` with one gzip member per record below ``target``.

    A file is inflated once as a stream; memory holds one piece of it, not a record. Returns the sidecar index
    ``file, offset, length, kind``, also kept as the table ``index`` in ``target``. An empty archive gives no index rows; a cut-off
    one is an error.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["file"]:
                new, rows, offset = f"{name.removesuffix('.warc.gz')}-{uuid.uuid4().hex}.warc.gz", [], 0
                out = write_to(f"{target}/{new}")
                with read_from(f"{source}/{name}") as raw:
                    for head, pieces in split_records(inflated(raw)):
                        packer, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                        for part in pieces:
                            packed = packer.compress(part)
                            length += len(packed)
                            out.write(packed)
                        packed = packer.flush()
                        out.write(packed)
                        length += len(packed)
                        rows.append((new, offset, length, headers(head)["warc-type"]))
                        offset += length
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["file", "offset", "length", "kind"])
                            rows = []
                out.close()
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "offset", "length", "kind"])

    # a task for each file: left to itself, Spark joins so few rows into one task
    index = files.repartition(max(1, files.count()), "file").mapInPandas(rewrite, "file string, offset long, length long, kind string")
    index.write.parquet(f"{target}/index")
    return files.sparkSession.read.parquet(f"{target}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, kind, payload_bytes, payload_digest, refers_to, payload`` of the records that ``index`` names.

    Each is read alone, at its offset. A revisit has no payload of its own (NULL); size and digest are those of the payload
    it repeats. A response whose payload does not match its digest is an error.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "url", "kind", "payload_bytes", "payload_digest", "refers_to", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        at, raw, rows, held = None, None, [], 0
        for batch in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if name != at:
                    if raw is not None:
                        raw.close()
                    at, raw = name, read_from(f"{folder}/{name}")
                raw.seek(offset)
                plain = zlib.decompress(raw.read(length), 31)
                head, _, block = plain.partition(b"\r\n\r\n")
                own = headers(head)
                http, _, payload = block[: int(own["content-length"])].partition(b"\r\n\r\n")
                size, told = int(headers(http)["content-length"]), own["warc-payload-digest"].removeprefix("sha1:")
                kind = own["warc-type"]
                if kind == "response" and (len(payload) != size or digest(payload) != told):
                    raise ValueError(f"{name} at {offset}: the payload does not match its digest")
                number = lambda k: int(own[k]) if own.get(k) else None
                rows.append((number("x-page-id"), own["warc-target-uri"], kind, size, told, number("x-refers-to-page-id"), payload if kind == "response" else None))
                held += len(payload)
                if held > 1 << 22 or len(rows) >= 5000:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return index.select("file", "offset", "length").mapInArrow(load, "page_id long, url string, kind string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, level: int = 1) -> tuple[DataFrame, str]:
    """Writes ``pages (page_id, url, html)`` as archives, normalises them, and returns their index and folder.

    The payload is the html in UTF-8 (NULL: empty). Of records with equal payloads of at least ``least_bytes`` that with the
    largest page_id is the response and the others are revisits of it; smaller ones are all responses. Rows of equal page_id and
    payload are responses each if theirs is the largest. A NULL page_id is smaller than any other: alone it is a response. An empty table gives no records.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("told", _told("payload"))
    largest = rows.select("told", "page_id", F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes).groupBy("told").agg(F.max("page_id").alias("largest"))
    largest = written(largest, "largest")  # a table of its own, so that Spark can split the join of a payload with many copies
    known = rows.join(largest, "told", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    marked = known.select("page_id", "url", "payload", "told", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("largest")).alias("refers_to"))
    files = write_monolithic(marked, f"{folder}/mono", level)
    return normalise(files, f"{folder}/mono", f"{folder}/records", level), f"{folder}/records"


def _told(column: str):
    """SHA-1 in upper-case base32 by built-in functions: the 160 bits as 32 groups of five."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(column)
    # eight letters for each five bytes; a group of five bytes fits a long
    parts = []
    for k in range(4):
        number = F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(letters), (F.shiftright(number, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*parts)
