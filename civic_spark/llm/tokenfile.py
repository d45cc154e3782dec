"""Token files of independent zstandard frames with a trailing seek table (operator 10).

A file is a run of zstandard frames, each holding the little-endian unsigned 32-bit ids of whole documents; then a
skippable frame with the document index; then a skippable frame with the seek table of the public seekable format:
compressed size, decompressed size and checksum (low half of XXH64 of the content) of each frame, and a footer with the
number of frames, a descriptor byte and the magic number. A reader takes the table from the end of the file and
decompresses only the frames of the documents asked for. Any zstandard tool can inflate the whole file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_folder
from .files import read_from, write_to
from .tokens import Encoder

# Fixed values of the public seekable format.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

#: One document in the index: id, whether it has one, frame, first id in the frame, number of ids.
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("first", "<u8"), ("n", "<u8")])
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])


class Writer:
    """Writes one file. A frame ends with the document that brings it to ``frame_bytes``; none is split."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        self.out, self.frame_bytes = write_to(uri), frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.held: list[bytes] = []
        self.size = self.tokens = 0
        self.index: list[tuple] = []
        self.frames: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is not None, len(self.frames), self.size // 4, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids) // 4
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            plain = b"".join(self.held)
            packed = self.packer.compress(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = self.packer.compress(np.array(self.index, dtype=INDEX).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array(self.frames, dtype=ENTRY).tobytes() + struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()


class Reader:
    """Reads one file: the tables from its end, then single frames."""

    def __init__(self, uri: str):
        self.file = read_from(uri)
        size = self.file.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError(f"{uri}: no seek table with checksums at the end")
        self.frames = np.frombuffer(self._at(size - 9 - ENTRY.itemsize * frames, ENTRY.itemsize * frames), dtype=ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        kind, length = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError(f"{uri}: no document index behind the frames")
        self.unpacker = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.unpacker.decompress(self._at(int(self.starts[-1]) + 8, length)), dtype=INDEX)

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        row = self.frames[k]
        plain = self.unpacker.decompress(self._at(int(self.starts[k]), int(row["packed"])), max_output_size=int(row["plain"]))
        if len(plain) != row["plain"] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != row["check"]:
            raise ValueError(f"frame {k} does not match its checksum")
        return plain

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """``(doc_id, ids before it in the file, ids)``; only the frames of ``wanted`` documents are inflated."""
        before = np.concatenate([[0], np.cumsum(self.index["n"].astype(np.int64))])
        at, plain = -1, b""
        for i, row in enumerate(self.index):
            doc = int(row["doc_id"]) if row["known"] else None
            if wanted is not None and doc not in wanted:
                continue
            if row["frame"] != at:
                at, plain = int(row["frame"]), self.frame(int(row["frame"]))
            first = 4 * int(row["first"])
            yield doc, int(before[i]), plain[first : first + 4 * int(row["n"])]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, frame_bytes: int = 1 << 18, level: int = 1) -> str:
    """Writes the ids of all documents ``(doc_id, text)``, each with ``end_id`` behind, in ascending doc_id order.

    Returns the folder: ``tokens-*.zst`` files and a ``manifest`` table with one row per file. NULL text: no ids before the
    end id. NULL doc_ids come first; rows of equal doc_id stand in the order of their text's hash. Files are cut by ranges
    of doc_id, one task each; a task that runs again writes a file of another name, and only files in the manifest count.
    An empty table gives an empty manifest.
    """
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    end = np.array([end_id], dtype="<u4").tobytes()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        name, writer = f"tokens-{part:06d}-{uuid.uuid4().hex}.zst", None
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                writer = writer or Writer(f"{folder}/{name}", frame_bytes, level)
                writer.add(doc, raw + end)
        if writer:
            writer.close()
            row = {"part": [part], "file": [name], "docs": [len(writer.index)], "tokens": [writer.tokens]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = dealt.mapInArrow(save, "part long, file string, docs long, tokens long")
    manifest.write.parquet(f"{folder}/manifest")
    return folder


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, ids`` of all documents, or of ``doc_ids``; ``start`` counts the ids of all documents before, in all files."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a task for each file: left to itself, Spark joins so few rows into one task
    listed = manifest.select("part", "file", F.coalesce(before, F.lit(0)).alias("base")).repartition(max(1, manifest.count()), "file")
    wanted = None if doc_ids is None else set(doc_ids)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            a, b, c = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["doc_id", "start", "ids"])

        for batch in batches:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows, held = [], 0
                for doc, start, ids in Reader(f"{folder}/{name}").documents(wanted):
                    rows.append((doc, base + start, ids))
                    held += len(ids)
                    if held > 1 << 22:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return listed.mapInArrow(load, "doc_id long, start long, ids binary")


def token_digest(read: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of documents read back; Spark's own functions, so ids do not go to Python again."""
    return read.select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
