"""Substring dedup: remove words covered by a window of words that an earlier document has.

Windows are WINDOW consecutive words. Consecutive windows that share their smallest
eight-word hash (their anchor) form a run; the anchor depends on the window's words
alone, so equal windows always have equal anchors.

First pass: each partition counts the anchors of its runs in a count-min sketch, and the
sketches are merged. A window's anchor is counted at least once for every document that
has the window, so the estimate never falls below the window's count: windows whose anchor
is estimated at one are certainly not repeated. The sketch has a fixed size
(ROWS * CELLS; a bit for each cell reaches the tasks). When the input outgrows it, it passes
more windows on; results don't change.

Second pass: only runs estimated repeated are grouped. Equal runs are grouped whole
(partial aggregation first, so a passage in a third of all documents is one row for each
partition). Where an anchor has several different runs, their windows are counted in a sketch
of their own, and those estimated repeated are grouped exactly.

Defined results: null or shorter texts have no window and lose nothing; rows with the
same doc_id never remove each other's words; rows with null doc_id are kept whole and remove
nothing; a window that is repeated only inside its own document stays; other columns,
whatever their names, pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import Multipliers, Words, rolling, signed, span_hashes, text_chunks, written
from cloakframe.schema import free

WINDOW, GRAM = 50, 8
ROWS, CELLS = 2, 1 << 24
SLICE = 1 << 16

_WORD, _RUN1, _RUN2 = Multipliers(41), Multipliers(42), Multipliers(43)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, by doubling."""
    n, size = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[:n], x[width - size : width - size + n])


class Runs:
    """Runs of windows in the texts of a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int) -> None:
        self.words = words = Words(data, offsets, _WORD, lower=False)
        gram = min(GRAM, window)
        self.window_hash = rolling(words.hash, window, 44)
        least = sliding_min(rolling(words.hash, gram, 45), window - gram + 1)
        n = len(self.window_hash)
        last = words.first[1:][words.doc[:n]] - window if n else np.empty(0, np.int64)
        self.valid = np.arange(n) <= last
        begins = self.valid.copy()
        begins[1:] &= ~self.valid[:-1] | (least[1:] != least[:-1])
        self.start = np.flatnonzero(begins)
        place = np.cumsum(self.valid)
        total = int(place[-1]) if n else 0
        self.offset = place[self.start] - 1
        self.size = np.diff(np.append(self.offset, total))
        self.anchor = least[self.start]

    def rows(self, chosen: np.ndarray) -> dict[str, np.ndarray]:
        """Of the chosen runs: text, first word in it, number of windows, two hashes, anchor, hashes of the windows."""
        flat = self.window_hash[self.valid]
        size, offset = self.size[chosen], self.offset[chosen]
        ends = np.cumsum(size)
        windows = flat[np.repeat(offset - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        start = self.start[chosen]
        doc = self.words.doc[start]
        return {"doc": doc, "start": start - self.words.first[doc], "n": size, "r1": span_hashes(windows, size, _RUN1), "r2": span_hashes(windows, size, _RUN2), "anchor": self.anchor[chosen], "windows": windows}


def _cells(anchor: np.ndarray, row: int) -> np.ndarray:
    return ((anchor >> np.uint64(24 * row + 7)) & np.uint64(CELLS - 1)).astype(np.int64)


def sketch(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> list[np.ndarray]:
    """For each row of the merged sketch of the hashes in `df`'s batches, a bit for each cell: counted twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS, CELLS), np.uint8)
        for batch in batches:
            for some in hashes(batch):
                for row in range(ROWS):
                    cell, times = np.unique(_cells(some, row), return_counts=True)
                    counts[row, cell] = np.minimum(2, counts[row, cell] + np.minimum(times, 2))
        slices = counts.reshape(-1, SLICE)
        full = np.flatnonzero(slices.any(1))
        for lo in range(0, len(full), 32):
            part = full[lo : lo + 32]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([zlib.compress(slices[k].tobytes(), 1) for k in part], pa.binary())], names=["slice", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
                sums[k] = np.minimum(2, sums[k] + more) if k in sums else more
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], names=["slice", "bits"])

    partial = df.mapInArrow(count, "slice int, counts binary")
    # Together ROWS * CELLS / 8 bytes at most, whatever the input.
    merged = partial.repartition("slice").mapInArrow(merge, "slice int, bits binary").collect()
    bits = np.zeros((ROWS * CELLS // SLICE, SLICE // 8), np.uint8)
    for r in merged:
        bits[r[0]] = np.frombuffer(r[1], np.uint8)
    return list(bits.reshape(ROWS, -1))


def twice(bits: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Which hashes are estimated to occur twice or more."""
    out = np.ones(len(hashes), bool)
    for row, some in enumerate(bits):
        cell = _cells(hashes, row)
        out &= (some[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
    return out


def repeated_runs(df: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, start, n, r1, r2, anchor, windows) of runs whose anchor is estimated repeated; key tells rows of one doc_id apart."""

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in text_chunks(batch.column(0)):
            yield Runs(data, offsets, window).anchor

    bits = df.sparkSession.sparkContext.broadcast(sketch(df.select("text"), anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in text_chunks(batch.column(2)):
                runs = Runs(data, offsets, window)
                found = runs.rows(np.flatnonzero(twice(bits.value, runs.anchor)))
                at = pa.array(found["doc"] + lo)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found["n"])]).astype(np.int32)), pa.array(signed(found["windows"])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(found["start"], pa.int32()), pa.array(found["n"], pa.int32()), *(pa.array(signed(found[k])) for k in ("r1", "r2", "anchor")), lists],
                    names=["doc_id", "key", "start", "n", "r1", "r2", "anchor", "windows"],
                )

    return df.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, start int, n int, r1 long, r2 long, anchor long, windows array<long>")


def repeated_windows(runs: DataFrame) -> DataFrame:
    """(doc_id, key, start, anchor, h): the windows of the runs that a second sketch, of windows, estimates repeated."""

    def windows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.array(batch.column(0).flatten()).view(np.uint64)

    bits = runs.sparkSession.sparkContext.broadcast(sketch(runs.select("windows"), windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(4)
            size = np.array(column.value_lengths())
            h = np.array(column.flatten())
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            keep = np.flatnonzero(twice(bits.value, h.view(np.uint64)))
            at = pa.array(row[keep])
            start = batch.column(2).to_numpy()[row[keep]] + place[keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), batch.column(3).take(at), pa.array(h[keep])], names=["doc_id", "key", "start", "anchor", "h"])

    return runs.select("doc_id", "key", "start", "anchor", "windows").mapInArrow(run, "doc_id long, key long, start int, anchor long, h long")


def covered(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, start, n): n windows from word `start` on that a document with a smaller doc_id has too."""
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    runs = written(repeated_runs(df, window))
    run = ["r1", "r2", "n", "anchor"]
    classes = written(runs.groupBy(*run).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")))
    # Equal runs: later documents lose the whole run.
    again = classes.where("first_doc < last_doc").select(*run, "first_doc")
    whole = runs.select("doc_id", "key", "start", *run).join(again, run).where("doc_id > first_doc").select("doc_id", "key", "start", "n")
    # Different runs with one anchor: the windows of each run's first document, against those of the others.
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    firsts = classes.join(mixed, "anchor", "left_semi").select(*run, F.col("first_doc").alias("doc_id"))
    several = written(runs.join(firsts, [*run, "doc_id"], "left_semi").select("doc_id", "key", "start", "anchor", "windows"))
    single = written(repeated_windows(several))
    least = single.groupBy("h", "anchor").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").select("h", "anchor", "first_doc")
    parts = single.join(least, ["h", "anchor"]).where("doc_id > first_doc").select("doc_id", "key", "start", F.lit(1).alias("n"))
    return whole.union(parts)


def remove_repeats(df: DataFrame, window: int = WINDOW, counts: tuple[str, str] | None = ("n_words", "n_removed")) -> DataFrame:
    """`df` with its text cut, and two columns (none without `counts`) of its number of words before and of those removed.

    White space around what stays is kept as it is; a removed stretch goes with the white
    space after it. Raises ValueError if a column named in `counts` is there already.
    """
    counted = list(counts or ())
    if free(df, *counted) != counted:
        raise ValueError(f"the table already has a column named in {counts}")
    doc, key, stretches = free(df, "_doc", "_key", "_spans")
    spans = covered(df, window).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias(stretches))  # no more than the document's windows
    spans = spans.select(F.col("doc_id").alias(doc), F.col("key").alias(key), stretches)
    joined = df.join(spans, (df["doc_id"].cast("long") == spans[doc]) & (F.xxhash64(df["text"]) == spans[key]), "left").drop(doc, key)
    at = df.columns.index("text")
    names = [*df.columns, *counted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1)
            for lo, hi, data, offsets in text_chunks(batch.column(at)):
                words = Words(data, offsets, _WORD, lower=False)
                size, removed = words.counts, np.zeros(hi - lo, np.int64)
                texts = batch.column(at).slice(lo, hi - lo)
                part = spans.slice(lo, hi - lo)
                changed = {}
                for i in np.flatnonzero(np.array(part.value_lengths().fill_null(0))):
                    rows = part[i].values
                    start, n = (rows.field(k).to_numpy() for k in (0, 1))
                    edge = np.zeros(size[i] + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed[i] = gone.sum()
                    first = words.start[words.first[i] : words.first[i + 1]]
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    kept, pos = [], int(offsets[i])
                    for a, b in zip(turn[::2], turn[1::2], strict=True):
                        kept.append(data[pos : first[a]].tobytes())
                        pos = int(first[b]) if b < len(first) else int(offsets[i + 1])
                    changed[int(i)] = b"".join([*kept, data[pos : offsets[i + 1]].tobytes()]).decode()
                if changed:
                    texts = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.string())
                columns = [batch.column(k).slice(lo, hi - lo) if k != at else texts for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(size, pa.int64()), pa.array(removed)][: len(counted)]], names=names)

    return joined.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in counted)]))


def digests(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: of the kept words joined by one space."""
    out = remove_repeats(df.select("doc_id", "text"), window)
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
