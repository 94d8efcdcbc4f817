"""What the training-data operators share: checkpoints, vectorised words and hashes, components.

Texts reach Python in Arrow batches. They are worked on in chunks of about a megabyte
(``text_chunks``), so that the temporaries stay bounded whatever the batch size; one
longer text is a chunk of its own.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- lineage


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; make one only for a local master without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cloakframe-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more.

    The cleaner acts when the driver collects garbage, which a quiet driver seldom does. Removing the files
    by plan, at its end, isn't safe: tasks that adaptive execution left behind still ask for them.
    """
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint()


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random uint64, the same on every machine."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLD)


class Multipliers:
    """Multipliers of a multilinear hash, grown to the longest span seen."""

    def __init__(self, seed: int) -> None:
        self.seed, self.table = seed, stream(seed, 256) | np.uint64(1)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = stream(self.seed, 2 * n) | np.uint64(1)
        return self.table


def span_hashes(values: np.ndarray, lens: np.ndarray, by: Multipliers) -> np.ndarray:
    """64-bit hash of each of the consecutive spans of `values` (all lens > 0)."""
    if not len(lens):
        return np.empty(0, np.uint64)
    offsets = np.cumsum(lens) - lens
    pos = np.arange(len(values)) - np.repeat(offsets, lens)
    table = by.upto(int(lens.max()))
    sums = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * table[pos], offsets)
    return mix(sums + lens.astype(np.uint64) * _GOLD)


# ---------------------------------------------------------------- texts


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, UTF-8 bytes, offsets of each text in them); nulls are empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: where they are, whose they are, their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, by: Multipliers, lower: bool) -> None:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data)
        self.hash = span_hashes(data[inside], self.end - self.start, by)
        #: index of the first word of each text, and one past the last word of all
        self.first = np.searchsorted(self.start, offsets, "left")
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)


def rolling(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each `width` consecutive values, by doubling; out[i] is of values[i:i+width]."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, done, out, bit = values, 1, 0, None, 0
    salts = stream(seed, 128) | np.uint64(1)
    while True:
        if width & size:
            out = power if out is None else mix(out[: len(power) - done] * salts[2 * bit] + power[done:]) if len(power) > done else np.empty(0, np.uint64)
            done += size
        if done == width:
            return out[:n]
        power = mix(power[:-size] * salts[2 * bit + 1] + power[size:]) if len(power) > size else np.empty(0, np.uint64)
        size, bit = size * 2, bit + 1


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every id in `edges` (columns a, b); component_id is the smallest id reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) as joins and
    aggregations. Both aggregations combine before the shuffle, and the joins on a hub
    are plain sort-merge joins that adaptive execution can split. Rounds are logarithmic
    in practice; each is checkpointed. They end when every id has one smaller neighbour, which has none
    itself, so edges that are (id, component_id) already take no round. An empty input gives an empty result.
    """
    work = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while _open(work):
        both = work.union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        work = cut(small)
    return work.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).union(work.select(F.col("v"), F.col("v")).distinct())


def _open(work: DataFrame) -> bool:
    """Is an id of the edges (u, v: the smaller one) below two others, or between two?"""
    sides = work.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(work.select("v", F.lit(0), F.lit(1)))
    ids = sides.groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return bool(ids.where("below > 1 or (below > 0 and above > 0)").take(1))


# ---------------------------------------------------------------- written tables


def written(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """`df` as a Parquet table in the checkpoint folder: unlike a checkpoint it is compressed and read by column.

    The folder lies inside this application's checkpoint folder and goes with it.
    """
    import uuid

    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    release(df.sparkSession)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the tables that `written` made for `df`, when all that reads them has been written itself."""
    sc = df.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(sc._jvm.java.net.URI(folder))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
