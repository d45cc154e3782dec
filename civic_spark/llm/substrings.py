"""Substring dedup by prefix-partitioned suffix trees (operator 4).

A window is ``size`` consecutive words. In every window the run of ``prefix`` words with the smallest hash is its anchor; equal
windows have equal anchors at equal places, so only the suffixes that start at anchors need to meet. Suffixes are
partitioned by their prefix, the anchor's words. A prefix that occurs once is dropped. The others are gathered in groups that
fit in memory, and each group's suffixes are sorted into the order of a suffix tree: its internal nodes are the intervals
of neighbours with long common prefixes. A node that reaches from an anchor to the end of a window, split by the words
to the left of the anchor, is a repeat; maximal repeats are what windows of such nodes cover together. A prefix with more
different surroundings than a group should hold is made longer, by half each time, until what shares it fits a group; one
as long as the window is a node by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder, written
from .files import place
from .shingles import mixed, numbers, runs, word_hashes

_U = np.uint64
#: Odd base of the sums that stand for word runs, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def anchors(words: list[bytes], size: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Of one text: for each anchor its prefix hash, content hash, first window, its place in that window, number of windows, and
    how often the same content follows at once.

    The content is the run of words that the anchor's windows cover. In a periodic stretch each word may be an anchor of one
    window with the same content; such a run is one entry.
    """
    n = len(words)
    if n < size:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    h = word_hashes(words)
    grams = runs(h, prefix, 1)
    width = size - prefix + 1
    # leftmost smallest gram of each window, by windows of doubling width
    best, at, reach = grams, np.arange(len(grams)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        at = np.where(take, at[step : step + len(take)], at[: len(take)])
        best = np.where(take, right, left)
        reach += step
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # the windows of an anchor follow each other
    wins = np.diff(np.append(starts, len(at)))
    off = at[starts] - starts
    total = np.concatenate([[_U(0)], np.cumsum(mixed(h) * _powers(n, BASE), dtype=_U)])
    ends = starts + wins - 1 + size
    content = mixed((total[ends] - total[starts]) * _powers(n + 1, _INVERSE)[starts] + (off * 64 + wins).astype(_U))
    key = grams[at[starts]]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (starts[1:] != starts[:-1] + 1)])
    fresh[:: 1 << 20] = True  # the number of repetitions has 21 bits
    first = np.flatnonzero(fresh)
    times = np.diff(np.append(first, len(key)))
    return key[first].view(np.int64), content[first].view(np.int64), starts[first], off[first], wins[first], times


def repeated_starts(groups: np.ndarray, content_n: np.ndarray, off: np.ndarray, wins: np.ndarray, words: list[list[bytes]], size: int) -> np.ndarray:
    """For each content a number whose bit ``o`` says that its window with the anchor ``o`` words behind the start is repeated.

    ``groups``: the prefix of each content, ``content_n``: how often it occurs, ``words``: its words. Windows are compared
    within a prefix only. This is the subtree of the prefix: contents in suffix order, nodes as runs of neighbours.
    """
    m, codes = len(words), {}
    right = np.full((m, size), -1, np.int32)
    left = np.full((m, size), -1, np.int32)
    for i, text in enumerate(words):
        row = [codes.setdefault(w, len(codes)) for w in text]
        o = int(off[i])
        right[i, : min(size, len(row) - o)] = row[o : o + size]
        if o:
            left[i, :o] = row[:o][::-1]
    _, groups = np.unique(groups, return_inverse=True)

    def order(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order within the groups, and the words that each shares with the one before it (-1: another group)."""
        by = np.lexsort([*side.T[::-1], groups])
        differs = side[by[1:]] != side[by[:-1]]
        shared = np.where(differs.any(1), differs.argmax(1), size)
        shared[groups[by[1:]] != groups[by[:-1]]] = -1
        return by, np.concatenate([[-1], shared])

    by_right, lcp = order(right)
    by_left, lcs = order(left)
    node, stem, out = np.empty(m, np.int64), np.empty(m, np.int64), np.zeros(m, np.int64)
    for o in range(int(off.max()) + 1):
        at = np.flatnonzero((off >= o) & (off - wins < o))
        if not len(at):
            continue
        node[by_right] = np.cumsum(lcp < size - o)
        stem[by_left] = np.cumsum(lcs < o)
        _, same = np.unique(node[at] * (m + 1) + stem[at], return_inverse=True)
        times = np.bincount(same, weights=content_n[at])
        out[at] |= np.where(times[same] > 1, 1 << o, 0)
    return out


def covered(n: int, starts: np.ndarray, off: np.ndarray, wins: np.ndarray, times: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` words lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for o in range(int(off.max(initial=-1)) + 1):
        hit = (off >= o) & (off - wins < o) & ((mask >> o) & 1 == 1)
        if hit.any():
            s = starts[hit] + off[hit] - o
            np.add.at(edge, s, 1)
            np.add.at(edge, s + (times[hit] - 1) + size, -1)
    return np.cumsum(edge[:n]) > 0


# Place of an anchor in one number: first window, place in it, windows, repetitions.
def _packed(start, off, wins, times):
    return (start << 33) | (off << 27) | (wins << 21) | times


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, ...]:
    return at >> 33, (at >> 27) & 63, (at >> 21) & 63, at & 0x1FFFFF


class Lists:
    """Rows of a table in the shared folder for one block of the input at a time, by row number. A row may hold lists of numbers
    and places that share its other columns."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.at, self.rows = path, columns, None, {}

    def of(self, loc: int, block: int) -> dict[int, tuple[int, int]]:
        """Row number to the bounds of its rows in ``self.table``; the rows of other blocks are let go."""
        if (loc, block) != self.at:
            system, path = place(f"{self.path}/loc={loc}/block={block}")
            self.at, self.rows, self.table = (loc, block), {}, [np.empty(0, np.int64) for _ in self.columns]
            if system.get_file_info(path).type.name == "Directory":
                found = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["rk", *self.columns])
                rows = {c: found[c].combine_chunks() for c in found.column_names}
                if pa.types.is_list(rows["rk"].type):  # rows packed by what they share
                    times = rows["rk"].value_lengths().to_numpy()
                    flat = {c: v.flatten() if pa.types.is_list(v.type) else None for c, v in rows.items()}
                    values = {c: flat[c].to_numpy() if flat[c] is not None else np.repeat(v.to_numpy(), times) for c, v in rows.items()}
                else:
                    values = {c: v.to_numpy() for c, v in rows.items()}
                key = values["rk"]
                order = np.argsort(key, kind="stable")
                key = key[order]
                self.table = [values[c][order] for c in self.columns]
                cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist() if len(key) else [0]
                self.rows = {int(key[a]): (a, b) for a, b in zip(cuts[:-1], cuts[1:])}
        return self.rows


def _from_files(docs: DataFrame) -> bool:
    """Whether every row comes straight from a file, so that its file and row number are known."""
    if "_metadata" in docs.columns:
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema
    except AnalysisException:
        return False
    return True


def _located(docs: DataFrame, block_rows: int) -> DataFrame:
    """``row`` (all columns), ``doc_id, text, loc, block, rk``: the file that a row is read from, its block there, its number.

    What is found out about a text later comes back to it through tables partitioned by file and block of ``block_rows`` rows,
    so the texts themselves are never shuffled and a reader holds the lists of one block. Rows that do not come straight
    from files are written to the shared folder first.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row) if _from_files(docs) else written(docs.select(row), "docs")
    at = F.col("_metadata.row_index")
    return rows.select(
        "row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"),
        F.xxhash64(F.col("_metadata.file_path")).alias("loc"), F.expr(f"_metadata.row_index div {block_rows}").alias("block"), at.alias("rk"),
    )


def _listed(rows: DataFrame, name: str) -> str:
    """Writes ``rk, loc, block, ...`` partitioned by file and block of the input, for ``Lists``; a task writes a block."""
    path = shared_folder(rows.sparkSession, name)
    dealt = rows.repartition("loc", "block").sortWithinPartitions("loc", "block")
    dealt.write.option("compression", "zstd").partitionBy("loc", "block").parquet(path)
    return path


def repeats(located: DataFrame, size: int = 35, prefix: int = 8, group_contents: int = 2048, bucket_contents: int = 8000) -> str:
    """Finds all repeated windows of the texts; returns the folder with, per file, block and row, the anchors that have any.

    ``size`` words make a window, ``prefix`` words an anchor. A prefix with more than ``group_contents`` different
    surroundings is lengthened; groups hold about ``bucket_contents`` contents together.
    """
    if not 0 < prefix <= size < 64:
        raise ValueError("prefix and size must satisfy 0 < prefix <= size < 64")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            rk, loc, block = (batch.column(i).to_numpy() for i in (1, 2, 3))
            for i, text in enumerate(batch.column(0).cast(pa.binary()).to_pylist()):
                key, content, start, off, wins, times = anchors((text or b"").split(), size, prefix)
                if len(key):
                    out.append((key, content, *(np.full(len(key), x[i]) for x in (rk, loc, block)), _packed(start, off, wins, times)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["key", "content", "rk", "loc", "block", "at"])

    places = "key long, content long, rk long, loc long, block long, at long"
    found = written(located.select("text", "rk", "loc", "block").mapInArrow(find, places), "anchors")
    times = F.col("at").bitwiseAND(F.lit(0x1FFFFF))
    live_keys = written(found.groupBy("key").agg(F.sum(times).alias("n")).where("n > 1").select("key"), "live-keys")
    live = written(found.join(live_keys, "key"), "live")
    contents = written(live.groupBy("key", "content").agg(F.sum(times).alias("n"), F.min(F.struct("loc", "block", "rk", "at")).alias("one")), "contents")
    widths = contents.groupBy("key").agg((F.count("*") > group_contents).cast("long").alias("heavy"))
    wanted = contents.join(widths, "key").select("key", "content", "n", "heavy", "one.loc", "one.block", "one.rk", "one.at")
    to_read = _listed(wanted, "to-read")
    windows = written(_surroundings(located, to_read, size), "windows")
    buckets = max(1, -(-windows.where("heavy = 0").count() // bucket_contents))
    fitting = _subtrees(windows.where("heavy = 0").withColumn("grp", F.col("key")), buckets, size)
    masks = written(fitting.union(_lengthened(windows.where("heavy = 1").drop("heavy"), size, prefix, group_contents, bucket_contents)), "masks")
    # the places of a content in one block share a row: a passage that very many documents hold moves few rows
    packed = written(live.groupBy("key", "content", "loc", "block").agg(F.collect_list(F.struct("rk", "at")).alias("places")), "places")
    answers = packed.join(masks, ["key", "content"]).select("loc", "block", F.col("places.rk").alias("rk"), F.col("places.at").alias("at"), "mask")
    return _listed(answers, "repeats")


def _outward(words: list[bytes], off: int) -> bytes:
    """A window read from its anchor: to its end, then from before the anchor back to its start."""
    return b" ".join([*words[off:], *words[:off][::-1]])


def _surroundings(located: DataFrame, path: str, size: int) -> DataFrame:
    """``key, content, n, heavy, off, wins, text``: the words of each content; of a prefix to be lengthened one row per window,
    read outward from the anchor."""
    schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("heavy", pa.int64()), ("off", pa.int64()), ("wins", pa.int64()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(path, ["key", "content", "n", "heavy", "at"])
        for batch in batches:
            rk, loc, block = (batch.column(i).to_pylist() for i in (1, 2, 3))
            texts, rows = batch.column(0).cast(pa.binary()), []
            for i in range(len(rk)):
                bounds = lists.of(loc[i], block[i]).get(rk[i])
                if bounds is None:
                    continue
                words = texts[i].as_py().split()
                part = slice(*bounds)
                key, content, n, heavy, at = (c[part] for c in lists.table)
                for k, c, m, wide, s, o, w in zip(key.tolist(), content.tolist(), n.tolist(), heavy.tolist(), *(x.tolist() for x in _unpacked(at)[:3])):
                    if wide:
                        rows += [(k, c, m, 1, o - j, 1, _outward(words[s + j : s + j + size], o - j)) for j in range(w)]
                    else:
                        rows.append((k, c, m, 0, o, w, b" ".join(words[s : s + w - 1 + size])))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if t.name == "text" else t.type).cast(t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if t.name == "text" else t.type).cast(t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return located.select("text", "rk", "loc", "block").mapInArrow(read, "key long, content long, n long, heavy long, off long, wins long, text string")


MASKS = "key long, content long, mask long"


def _subtrees(windows: DataFrame, buckets: int, size: int) -> DataFrame:
    """``key, content, mask`` from ``grp, key, content, n, off, wins, text``; each task builds the subtrees of one bucket of groups.

    Texts are compared within a group. A content may have several rows, with a window each; its bits come in several rows then.
    """

    def grow(table: pa.Table) -> pa.Table:
        group, key, content, n, off, wins = (table[c].to_numpy() for c in ("grp", "key", "content", "n", "off", "wins"))
        words = [t.split() for t in table["text"].cast(pa.binary()).to_pylist()]
        mask = repeated_starts(group, n, off, wins, words, size)
        some = np.flatnonzero(mask)
        return pa.table({"key": key[some], "content": content[some], "mask": mask[some]})

    bucket = F.pmod(F.xxhash64("grp"), F.lit(buckets)).alias("bucket")
    return windows.select(bucket, "grp", "key", "content", "n", "off", "wins", "text").groupBy("bucket").applyInArrow(grow, MASKS)


def _lengthened(windows: DataFrame, size: int, prefix: int, group_contents: int, bucket_contents: int) -> DataFrame:
    """``key, content, mask`` of prefixes whose surroundings do not fit a group, from their windows read outward.

    Windows with the anchor at the same place share a prefix of that reading. It grows by half each time; branches of at most
    ``group_contents`` rows become subtrees, the others go on. Windows that share all ``size`` words are one node,
    whose occurrences are added up without gathering them.
    """
    out, length = [], prefix
    windows = written(windows, "long")
    while length < size and not windows.isEmpty():
        length = min(size, length + (length + 1) // 2)
        branch = F.xxhash64("key", "off", F.substring_index("text", " ", length))
        rows = windows.withColumn("grp", branch)
        if length == size:
            nodes = rows.groupBy("grp").agg(F.sum("n").alias("times")).where("times > 1").select("grp")
            out.append(rows.join(nodes, "grp").select("key", "content", F.expr("1L << cast(off as int)").alias("mask")))
            break
        wide = rows.groupBy("grp").agg(F.count("*").alias("c")).where(F.col("c") > group_contents).select("grp", F.lit(1).alias("wide"))
        split = written(rows.join(wide, "grp", "left"), "long")
        fits = split.where("wide is null")
        buckets = max(1, -(-fits.count() // bucket_contents))
        natural = F.split("text", " ")
        ahead = F.slice(natural, 1, F.lit(size) - F.col("off").cast("int"))
        behind = F.reverse(F.slice(natural, F.lit(size + 1) - F.col("off").cast("int"), F.greatest(F.col("off").cast("int"), F.lit(0))))
        in_order = fits.withColumn("text", F.array_join(F.concat(behind, ahead), " "))
        out.append(written(_subtrees(in_order, buckets, size), "masks"))
        windows = split.where("wide = 1").drop("grp", "wide")
    found = windows.sparkSession.createDataFrame([], MASKS)
    for part in out:
        found = found.union(part)
    return found.groupBy("key", "content").agg(F.expr("bit_or(mask)").alias("mask"))


def without_repeats(docs: DataFrame, size: int = 35, prefix: int = 8, whole_row: bool = False, block_rows: int = 16_384, **settings) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row of ``docs (doc_id, text)``: the text without its repeated windows.

    Words are runs of bytes other than white space, unchanged. A word goes if it lies in a window of ``size`` words whose
    words also stand, in order, from another place on: in another document, in a repeated row, or elsewhere in the same one.
    Windows are judged on the input. ``kept`` joins the words left with single spaces (empty for NULL, empty and blank texts,
    which have no words). Texts shorter than a window keep every word. NULL doc_ids stay. An empty table gives no rows.
    ``whole_row`` adds all columns of the input as one struct ``row``. A block is ``block_rows`` rows of one file.
    """
    located = _located(docs, block_rows)
    path = repeats(located, size, prefix, **settings)
    inputs = located.select("text", "rk", "loc", "block", "doc_id", *(["row"] if whole_row else []))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(path, ["at", "mask"])
        for batch in batches:
            rk, loc, block = (batch.column(i).to_pylist() for i in (1, 2, 3))
            texts = batch.column(0).cast(pa.binary())
            total, gone, kept = [], [], []
            for i in range(len(rk)):
                words = (texts[i].as_py() or b"").split()
                bounds = lists.of(loc[i], block[i]).get(rk[i])
                total.append(len(words))
                if bounds is None:
                    gone.append(0)
                else:
                    at, mask = (c[slice(*bounds)] for c in lists.table)
                    out = covered(len(words), *_unpacked(at), mask, size)
                    words = [w for w, x in zip(words, out.tolist()) if not x]
                    gone.append(int(out.sum()))
                kept.append(b" ".join(words).decode("utf-8"))
            arrays = [batch.column(4), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), *batch.columns[5:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept", *(["row"] if whole_row else [])])

    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return inputs.mapInArrow(rewrite, T.StructType(shape.fields + [located.schema["row"]]) if whole_row else shape)


def cleaned(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with its repeated passages taken out of ``text``; ``n_chars``, where there is one, counts what is left.

    No row goes, not even one that loses every word. A text that loses nothing stays as it is, white space included.
    """
    rows = without_repeats(docs, whole_row=True, **settings)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row")["text"].cast("string"))
    new = {"text": text} | ({"n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
