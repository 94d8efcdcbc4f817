"""Near-duplicate documents by b-bit MinHash.

Each document's five-word shingles give minima. Bands of whole minima make the candidates;
for documents that share a band, BITS bits of a hash of each of KEPT minima, packed into longs,
estimate a pair's similarity by bit counts, corrected for chance collisions; what may reach the
threshold is confirmed on the full shingle sets.

Documents with equal shingle sets are one class from the start, so copies cost one row.
Within a band bucket pairs are not all emitted: first each member is paired with a few
random others, and for each document the likeliest pairs are confirmed, twice over. Then,
only in buckets that still hold several components, documents outside the largest one are
tried with all of other components. A link inside one component can't change the
result, so no link between components is lost.

The chance that a pair at the threshold meets in no band is (1 - 0.75**5)**40, 2 in
100,000. The estimate's margin is four standard deviations.

Defined results: a document without words, or with null text, has no shingles and links
with nothing; one with fewer than five words has its whole sequence as its one shingle;
rows that share a doc_id are one document, the greatest of their texts being its text;
rows with null doc_id are kept and link with nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import Multipliers, Words, connected_components, cut, mix, rolling, signed, stream, text_chunks, written

WIDTH = 5
BANDS, ROWS = 40, 5
PERMUTATIONS = BANDS * ROWS
#: Minima of whose hashes BITS bits are kept, for documents that share a band.
KEPT, BITS = 1536, 1
LONGS = KEPT * BITS // 64
#: In hundredths: pairs with 100 * intersection >= THRESHOLD * union are linked.
THRESHOLD = 75
#: Pairs estimated below THRESHOLD by more than this are not confirmed: four standard deviations.
MARGIN = 0.07
#: In a bucket each document is first tried with so many others, in parts of so many members; so often.
BESIDE, PART, ROUNDS = 2, 1024, 2
#: Sets that a task compares come in blocks of about so many documents.
BLOCK = 128

_BY = Multipliers(5)
_A = (stream(21, KEPT) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (stream(22, KEPT) >> np.uint64(32)).astype(np.uint32)
_BAND = stream(23, PERMUTATIONS).reshape(BANDS, ROWS) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, sorted, one text after the other; offsets of the texts in them)."""
    words = Words(data, offsets, _BY, lower=True)
    n = len(offsets) - 1
    parts, counts = [], np.zeros(n, np.int64)
    five = rolling(words.hash, WIDTH, 31)
    for i in range(n):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= WIDTH:
            found = np.unique(five[a : b - WIDTH + 1])
        elif b > a:
            found = mix(rolling(words.hash[a:b], int(b - a), 31) + np.uint64(b - a))
        else:
            continue
        parts.append(found)
        counts[i] = len(found)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def minima(shingles: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The first n minima of each of the non-empty sets."""
    x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, n), np.uint32)
    for lo in range(0, len(out), 64):  # a few thousand shingles at a time stay in cache
        rows = offsets[lo : lo + 65]
        part = x[rows[0] : rows[-1]]
        for k in range(n):
            out[lo : lo + 64, k] = np.minimum.reduceat(part * _A[k] + _B[k], rows[:-1] - rows[0])
    return out


def band_keys(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    least = minima(shingles, offsets, PERMUTATIONS).reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((least * _BAND).sum(2, dtype=np.uint64) + _BAND[:, 0])


def packed(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One bit of a hash of each of KEPT minima, packed into longs.

    A minimum's own low bit won't do: as each of _A is odd, it is a fixed bit of the shingle in
    all permutations, and the errors of a small set would not average out.
    """
    x = minima(shingles, offsets, KEPT)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    bits = (x >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal bits, less those equal by chance."""
    differ = F.lit(0)
    for i in range(LONGS):
        differ = differ + F.bit_count(a[i].bitwiseXOR(b[i]))
    chance = 2.0**-BITS
    return ((1 - differ / KEPT) - chance) / (1 - chance)


def _list(values: np.ndarray, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(signed(values.ravel())))


def sign(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands): k1 and k2 identify the shingle set; null for an empty set."""
    names = ["doc_id", "n_shingles", "k1", "k2", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                shingles, at = shingle_sets(data, offsets)
                count = np.diff(at)
                full = np.flatnonzero(count)
                k1, k2, bands = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64), np.zeros((hi - lo, BANDS), np.uint64)
                if len(full):
                    starts = np.append(at[full], at[-1])
                    k1[full] = np.add.reduceat(mix(shingles), starts[:-1])
                    k2[full] = np.add.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), starts[:-1])
                    bands[full] = band_keys(shingles, starts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(signed(k1), mask=count == 0), pa.array(signed(k2), mask=count == 0), _list(bands, BANDS)], names=names)

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def sets(df: DataFrame) -> DataFrame:
    """(id, shingles, sig) of non-empty documents: the full set as packed hashes, and the b-bit signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                shingles, at = shingle_sets(data, offsets)
                full = np.flatnonzero(np.diff(at))
                starts = np.append(at[full], at[-1])
                packs = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((starts * 8).astype(np.int32)), pa.py_buffer(shingles.tobytes())])
                sig = packed(shingles, starts) if len(full) else np.empty((0, LONGS), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(full)), packs, _list(sig, LONGS)], names=["id", "shingles", "sig"])

    return df.mapInArrow(run, "id long, shingles binary, sig array<long>")


def confirm(pairs: DataFrame, full: DataFrame, group: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets (`full`: id, shingles) reach the threshold.

    A set isn't sent once for each of its pairs: the documents of a group (id, component_id)
    are cut into blocks of about BLOCK, and a task has the pairs between two blocks with
    the sets that these pairs name. Any grouping gives the same result.
    """
    sizes = group.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    placed = group.join(sizes, "component_id").select("id", F.col("component_id").alias("g"), F.pmod(F.xxhash64("id", F.lit(9)), "blocks").cast("int").alias("block"))
    placed = cut(ids.join(placed, "id", "left").select("id", F.coalesce("g", "id").alias("g"), F.coalesce("block", F.lit(0)).alias("block")))
    place = F.struct("g", "block")
    wanted = pairs.join(placed.select(F.col("id").alias("a"), place.alias("pa")), "a").join(placed.select(F.col("id").alias("b"), place.alias("pb")), "b")
    wanted = cut(wanted.select(F.least("pa", "pb").alias("x"), F.greatest("pa", "pb").alias("y"), "a", "b"))
    needed = wanted.select("x", "y", F.col("a").alias("id")).union(wanted.select("x", "y", "b")).distinct()
    sent = full.select("id", "shingles").join(needed, "id")
    sent = sent.select("x.g", "x.block", F.col("y.g").alias("h"), F.col("y.block").alias("other"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    asked = wanted.select("x.g", "x.block", F.col("y.g").alias("h"), F.col("y.block").alias("other"), "a", "b", F.lit(None).cast("binary").alias("shingles"))
    # Within a pair of blocks the sets come first.
    rows = sent.union(asked).repartition("g", "block", "h", "other").sortWithinPartitions("g", "block", "h", "other", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            found = ([], [])
            raw = batch.column(6)
            for i, (*key, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                if key != now:
                    now, held = key, {}
                if b is None:
                    held[a] = np.frombuffer(raw[i].as_py(), np.uint64)
                    continue
                s, t = held[a], held[b]
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                if 100 * common >= threshold * (len(s) + len(t) - common):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document of `doc_id, text`."""
    docs = _documents(df)
    signed_docs = cut(sign(docs))
    known = signed_docs.where("n_shingles > 0 and doc_id is not null")
    classes = cut(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    reps = cut(known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "bands"))
    found = connected_components(link(reps, docs.where("doc_id is not null"), threshold))
    out = signed_docs.join(classes, ["k1", "k2"], "left")
    out = out.join(found.select(F.col("id").alias("rep"), F.col("component_id").alias("_component")), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _documents(df: DataFrame) -> DataFrame:
    """doc_id, text with one row for each doc_id; rows without one stay."""
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = df.select("doc_id").where("doc_id is not null")
    if not ids.groupBy("doc_id").count().where("count > 1").take(1):
        return df
    return df.where("doc_id is null").union(df.where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text")))


def link(reps: DataFrame, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) that join all components that the bands can join, each confirmed or (id, component_id) of confirmed ones; reps has id, bands."""
    least = threshold / 100 - MARGIN
    members = reps.select("id", F.posexplode("bands").alias("t", "band"))
    buckets = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(members.join(buckets, "band"))
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    full = written(sets(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text")))
    sigs = full.select("id", "sig")
    # Neighbours in a random order of the bucket, in parts of about PART members.
    part = F.pmod(F.xxhash64("id", "band"), F.ceil(F.col("n") / PART))
    order = Window.partitionBy("band", "part").orderBy("mix", "id")
    shuffled = members.withColumn("part", part).withColumn("mix", F.xxhash64("band", "id", F.lit(1)))
    beside = shuffled.select("id", F.array(*(F.lag("id", k).over(order) for k in range(1, BESIDE + 1))).alias("others"))
    beside = beside.select("id", F.explode("others").alias("other")).where("other is not null")
    near = beside.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    near = near.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    near = cut(near.select("a", "b", estimate(F.col("sa"), F.col("sb")).alias("e")).where(F.col("e") >= least))
    component, tried, group = None, None, None
    for _ in range(ROUNDS):
        # For each document the likeliest of its pairs that would still join components.
        open_pairs = near if component is None else _between(near, component)
        own = open_pairs.select(F.col("a").alias("id"), "*").union(open_pairs.select(F.col("b").alias("id"), "*"))
        best = own.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("e"), "a", "b"))).where("k <= 2")
        chosen = best.select("a", "b").distinct()
        chosen = cut(chosen if tried is None else chosen.join(tried, ["a", "b"], "left_anti"))
        tried = chosen if tried is None else tried.union(chosen)
        group = connected_components(chosen) if group is None else group
        found = confirm(chosen, full, group, threshold)
        component = connected_components(found if component is None else component.select("id", "component_id").toDF("a", "b").union(found))
    # Buckets whose members are still in several components: those outside the bucket's largest one are tried with
    # all members of other components, each pair in the first band that it shares.
    placed = members.join(component, "id", "left").select("band", "t", "id", F.coalesce("component_id", "id").alias("c"))
    counts = placed.groupBy("band", "c").agg(F.count("*").alias("m"))
    main = counts.groupBy("band").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("k")).where("k > 1").select("band", "main")
    placed = placed.join(main, "band").join(sigs, "id").join(reps.select("id", "bands"), "id")
    placed = written(placed.select("band", "t", "id", "c", "main", "sig", "bands"))
    x, y = placed.alias("x"), placed.where("c <> main").alias("y")
    once = (F.col("x.c") == F.col("x.main")) | (F.col("x.id") < F.col("y.id"))
    first = F.size(F.array_intersect(F.slice("x.bands", F.lit(1), F.col("x.t")), F.slice("y.bands", F.lit(1), F.col("y.t")))) == 0
    met = (F.col("x.band") == F.col("y.band")) & (F.col("x.c") != F.col("y.c")) & once & (estimate(F.col("x.sig"), F.col("y.sig")) >= least) & first
    pairs = x.join(y, met).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"))
    return component.toDF("a", "b").union(confirm(pairs, full, group, threshold))


def _between(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs whose two sides are in different components."""
    of = lambda side: component.select(F.col("id").alias(side), F.col("component_id").alias(f"c{side}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "e")


def keep_one(df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `df` with one document of each group of near duplicates: that with the smallest doc_id."""
    drop = components(df.select("doc_id", "text"), threshold).where("not kept").select(F.col("doc_id").alias("_drop")).distinct()
    return df.join(drop, df["doc_id"] == drop["_drop"], "left_anti")
