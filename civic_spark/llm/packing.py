"""Vector bin packing of token pieces into training sequences (operator 9).

Documents become pieces: runs of at most ``max_tokens`` ids. Pieces are dealt by hash into groups of bounded size, and
each group is packed by the dot-product heuristic: of the pieces that still fit a sequence, the one whose demand vector
(tokens, segments, loss-bearing tokens; each as a share of its limit) has the largest dot product with what is left of
the limits goes in next, until none fits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import Encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int) -> DataFrame:
    """Pieces of all documents ``(doc_id, text)``: the ids of the text (NULL: none), then ``end_id``.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens``. Every document has at least one piece, as its end id counts.
    A row that occurs twice gives its pieces twice; a NULL doc_id stays NULL.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                raw += end
                total = len(raw) // 4
                for start in range(0, total, max_tokens):
                    part = raw[4 * start : 4 * (start + max_tokens)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def fill(tokens: np.ndarray, segments: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item, and where its tokens start there. Ties go to the earlier item, so equal input packs equally."""
    cap = np.array(limits, dtype=np.int64)
    need = np.stack([tokens, segments, loss], axis=1).astype(np.int64)
    if (need > cap).any():
        raise ValueError("an item exceeds a limit by itself")
    share = need / np.maximum(cap, 1)
    bins, offsets = np.zeros(len(need), np.int64), np.zeros(len(need), np.int64)
    left, number = np.arange(len(need)), 0
    while len(left):
        free, used = cap.copy(), 0
        own, part = need[left], share[left]
        open_ = np.ones(len(left), bool)
        while True:
            fits = open_ & (own <= free).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, part @ (free / np.maximum(cap, 1)), -1.0)
            i = int(score.argmax())
            bins[left[i]], offsets[left[i]] = number, used
            free, used = free - own[i], used + int(own[i, 0])
            open_[i] = False
        left, number = left[open_], number + 1
    return bins, offsets


def pack(
    pieces: DataFrame,
    max_tokens: int = 4096,
    max_segments: int = 256,
    max_loss: int = 4096,
    tokens: str = "length",
    loss: str | None = None,
    group_items: int = 2048,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every row of ``pieces``; other columns stay; one called
    like a new one is replaced.

    Each row is one segment of ``tokens`` tokens, of which ``loss`` bear loss (all, if None; NULL: none). Within a sequence
    the offsets are gapless from 0 and no limit is exceeded. A row above a limit by itself is an error. Groups take about
    ``group_items`` rows each, so one sequence per group at most is left part-filled for want of pieces. Equal rows are
    dealt apart by their position in the input. No rows give no rows.
    """
    table = written(pieces, "pieces")
    groups = max(1, -(-table.count() // group_items))
    rows = table.select(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("row")).select(
        "row",
        F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(9)), F.lit(groups)).alias("grp"),
        F.monotonically_increasing_id().alias("pos"),
        F.col(f"row.`{tokens}`").cast("long").alias("tok"),
        (F.coalesce(F.col(f"row.`{loss}`"), F.lit(0)) if loss else F.col(f"row.`{tokens}`")).cast("long").alias("los"),
    )
    plain = written(rows, "packing")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        bins, offsets = fill(pdf["tok"].to_numpy(), np.ones(len(pdf), np.int64), pdf["los"].to_numpy(), (max_tokens, max_segments, max_loss))
        return pd.DataFrame({"pos": pdf["pos"].to_numpy(), "sequence_id": pdf["grp"].to_numpy() * (1 << 32) + bins, "offset": offsets})

    placed = plain.select("grp", "pos", "tok", "los").groupBy("grp").applyInPandas(place, "pos long, sequence_id long, offset long")
    stay = [F.col("row")[c].alias(c) for c in table.columns if c.lower() not in ("sequence_id", "offset")]
    return plain.join(placed, "pos").select(*stay, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, max_tokens: int = 4096, max_segments: int = 256) -> DataFrame:
    """All documents as pieces with their places: the columns of ``token_pieces`` plus ``sequence_id, offset``.

    Every id lies in exactly one piece. NULL and empty texts are one piece with the end id. All ids bear loss.
    """
    return pack(token_pieces(docs, tokenizer, end_id, max_tokens), max_tokens, max_segments, max_tokens)
