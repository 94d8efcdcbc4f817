"""Near-duplicate vectors by lattice hashing.

In each table a random projection takes the unit vector to eight dimensions; the nearest point of the
E8 lattice is its cell. A vector resides in its cell and visits the neighbouring cells
nearest to it (by the lattice's 240 shortest vectors). Larger inputs get smaller cells and more
tables (`TIERS`). At a cosine of 0.9 a pair meets in no table with a chance of about 5 in 10,000; above it, less.

Vectors don't go to their cells: only (cell, id, a sketch of 255 signs) does, for a few tables
at a time, so what is stored at once doesn't depend on the number of tables or on the size of cells.
Members of a cell whose sketches are close become candidates, one edge for each member. Each component of
candidates then gets its vectors once, and all its pairs are compared by cosine in double precision.
A component of more than BLOCK vectors is cut into blocks, and each round compares every block with
one other. Pairs don't become rows: a task returns for each vector how
many links it found, and one edge to the smallest vector that it is connected with there.

Equal vectors are one class from the start, with its size.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and neither do vectors of different dimensions; rows that repeat an
id are one vector (the least); rows without an id are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import connected_components, mix, written
from cloakframe.llm.vectors import by_dimension, one_row_each, random_matrix, repeated, usable

#: Up to how many vectors: (width, tables, probes). Width is the unit vector's cell: larger cells find more and
#: compare more. Two random vectors share a cell of width 2 with a chance of 1 in 213, of 1.5 in 1,780, of 1.25 in 6,440, of 1 in 33,200.
TIERS = [(200_000, (2.0, 7, 4)), (3_000_000, (1.5, 21, 2)), (20_000_000, (1.25, 35, 2)), (None, (1.0, 80, 2))]
#: Rows of a vector that are dealt to cells at once.
AT_ONCE = 14
BLOCK = 8192
TILE = 1024
THRESHOLD = 0.9


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two components of 1, or all of a half with an even number of minuses."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_d8(y: np.ndarray) -> np.ndarray:
    point = np.round(y)
    rest = y - point
    odd = np.flatnonzero(point.sum(1).astype(np.int64) % 2)
    worst = np.abs(rest[odd]).argmax(1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return point


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest lattice point: of D8, or of D8 moved by a half."""
    a, b = nearest_d8(y), nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def _key(points: np.ndarray, table: int, d: int) -> np.ndarray:
    h = np.full(len(points), (table << 32) + d, np.uint64)
    for column in (points * 2).astype(np.int64).astype(np.uint64).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def cells(unit: np.ndarray, width: float, tables: range, probes: int) -> np.ndarray:
    """Keys [vector, table, probe] of unit vectors; probe 0 is the cell they reside in."""
    n, d = unit.shape
    steps = shortest()
    out = np.empty((n, len(tables), probes), np.int64)
    for k, t in enumerate(tables):
        y = (unit @ random_matrix(100 + t, d, 8)) / width
        home = nearest_e8(y)
        out[:, k, 0] = _key(home, t, d)
        near = (y - home) @ steps.T
        for p in range(1, probes):
            best = near.argmax(1)
            out[:, k, p] = _key(home + steps[best], t, d)
            near[np.arange(n), best] = -np.inf
    return out


def sketches(unit: np.ndarray) -> np.ndarray:
    """[vector, 4]: signs of 255 random projections; the last bit of the second number is 0."""
    signs = unit @ random_matrix(99, unit.shape[1], 256) > 0
    signs[:, 127] = False
    return np.packbits(signs, axis=1).view(">i8").astype(np.int64)


def most_apart(threshold: float, bits: int) -> int:
    """Signs in which two vectors linked at the threshold hardly ever differ: 4.4 standard deviations above the mean."""
    p = float(np.arccos(np.clip(threshold, -1, 1))) / np.pi
    return int(np.ceil(bits * p + 4.4 * np.sqrt(bits * p * (1 - p))))


def members(classes: DataFrame, width: float, tables: range, probes: int) -> DataFrame:
    """(cell, id, s0, s1, s2, s3): a row for each table and probe of `id, embedding`; the last bit of s1 tells that it resides there."""
    times = len(tables) * probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for _, rows, matrix in by_dimension(batch.column(0), batch.column(1)):
                for lo in range(0, len(rows), 1024):
                    x = matrix[lo : lo + 1024]
                    unit = x / np.linalg.norm(x, axis=1)[:, None]
                    keys, sketch = cells(unit, width, tables, probes), np.repeat(sketches(unit), times, axis=0)
                    home = np.tile(np.arange(probes) == 0, len(tables) * len(x))
                    sketch[:, 1] |= home
                    columns = [keys.ravel(), np.repeat(ids[rows[lo : lo + 1024]], times), *sketch.T]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["cell", "id", "s0", "s1", "s2", "s3"])

    return classes.select("id", "embedding").mapInArrow(run, "cell long, id long, s0 long, s1 long, s2 long, s3 long")


def _turns(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Rows whose first columns differ from those of the row before."""
    turn = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in range(keys):
        column = batch.column(k).to_numpy(zero_copy_only=False)
        turn |= column[1:] != column[:-1]
    return np.flatnonzero(turn) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of sorted rows cut anew, so that no group of equal first columns is in two; with the bounds of the groups."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        batch = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return batch, np.concatenate([[0], _turns(batch, keys), [batch.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            yield joined(held)
            held = []
        turns = _turns(batch, keys)
        if len(turns):
            yield joined([*held, batch.slice(0, int(turns[-1]))])
            held = [batch.slice(int(turns[-1]))]
        else:
            held.append(batch)
    if held:
        yield joined(held)


class Sets:
    """Positions joined in sets, each known by its smallest one."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up


def candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each member of a cell with close ones there, and the smallest id that closeness leads to in the cell."""
    half, limit = most_apart(threshold, 127), most_apart(threshold, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, 1):
            ids, s0, s1, s2, s3 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 6))
            home = (s1 & 1).astype(bool)
            sketch = [s.view(np.uint64) for s in (s0, s1 & ~1, s2, s3)]  # bits of signed numbers are counted without the sign
            living = np.concatenate([[0], np.cumsum(home)])[bounds]
            out = []
            for g in np.flatnonzero((np.diff(bounds) > 1) & (np.diff(living) > 0)):
                a, b = bounds[g], bounds[g + 1]
                order = a + np.argsort(ids[a:b], kind="stable")
                x, y, z, w = (s[order] for s in sketch)
                sets, at = Sets(b - a), np.flatnonzero(home[order])
                for lo in range(0, len(at), TILE):
                    h = at[lo : lo + TILE]
                    for left in range(0, b - a, TILE):
                        apart = np.bitwise_count(x[h][:, None] ^ x[left : left + TILE]) + np.bitwise_count(y[h][:, None] ^ y[left : left + TILE])
                        i, j = np.nonzero(apart <= half)
                        apart = apart[i, j].astype(np.int64)
                        i, j = h[i], j + left
                        close = (i != j) & (apart + np.bitwise_count(z[i] ^ z[j]) + np.bitwise_count(w[i] ^ w[j]) <= limit)
                        if close.any():
                            sets.join(i[close], j[close])
                moved = np.flatnonzero(sets.label != np.arange(b - a))
                if len(moved):
                    out.append((ids[order[moved]], ids[order[sets.label[moved]]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def linked(raw: np.ndarray, side: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted number of links of each row, and the smallest row that it is connected with. Rows of side 0 meet those of side 1, or each other if all are of side 0."""
    norm = np.sqrt((raw * raw).sum(1))
    unit = (raw / norm[:, None]).astype(np.float32)
    margin = 1e-6 + 2e-7 * raw.shape[1]  # more than single precision can be off
    links, sets = np.zeros(len(raw), np.int64), Sets(len(raw))
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(second)
    for lo in range(0, len(first), TILE):
        a = first[lo : lo + TILE]
        others = first[lo:] if alone else second
        for left in range(0, len(others), TILE):
            b = others[left : left + TILE]
            near = unit[a] @ unit[b].T
            if alone and not left:
                near[np.tril_indices(len(a), 0, len(b))] = -2
            i, j = np.nonzero(near >= threshold - margin)
            close = np.flatnonzero(near[i, j] <= threshold + margin)
            sure = np.ones(len(i), bool)
            for k in range(0, len(close), TILE):
                c = close[k : k + TILE]
                x, y = a[i[c]], b[j[c]]
                sure[c] = (raw[x] * raw[y]).sum(1) / (norm[x] * norm[y]) >= threshold
            i, j = a[i[sure]], b[j[sure]]
            if len(i):
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                sets.join(i, j)
    return links, sets.label


def _compared(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, links, root) of the groups of component_id, d, lo, hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, 4):
            sides, ids, weights = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4, 7))
            crossed = batch.column(2).to_numpy(zero_copy_only=False) != batch.column(3).to_numpy(zero_copy_only=False)
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                side = sides[a:b]
                if b - a < 2 or (crossed[a] and not 0 < side.sum() < b - a):
                    continue
                order = np.argsort(ids[a:b], kind="stable")
                raw = batch.column(7).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)[order]
                links, root = linked(raw, side[order], weights[a:b][order], threshold)
                hit = np.flatnonzero(links)
                if len(hit):
                    sorted_ids = ids[a:b][order]
                    out.append((sorted_ids[hit], links[hit], sorted_ids[root[hit]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "links", "root"])

    keys = ["component_id", "d", "lo", "hi"]
    return rows.select(*keys, "side", "id", "weight", "embedding").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "id long, links long, root long")


def compare(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, links, root): links found of each of n vectors in a group, weighted by the class, and the smallest id it's connected with there."""
    width, tables, probes = next(tier for most, tier in TIERS if most is None or n <= most)
    edges, each = None, max(1, AT_ONCE // probes)
    for t in range(0, tables, each):
        found = candidates(members(classes, width, range(t, min(t + each, tables)), probes), threshold).distinct()
        found = written(found)
        edges = found if edges is None else edges.union(found)
    component = written(connected_components(edges))
    big = component.groupBy("component_id").count().where(F.col("count") > BLOCK).select("component_id", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    most = big.agg(F.max("blocks")).first()[0] or 1
    rows = classes.join(component, "id").withColumn("d", F.size("embedding"))
    none = F.lit(0)
    if most == 1:
        return written(_compared(rows.select("*", none.alias("lo"), none.alias("hi"), none.alias("side")), threshold))
    blocks = F.coalesce("blocks", F.lit(1))
    rows = written(rows.join(big, "component_id", "left").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int")))
    out = written(_compared(rows.select("*", F.col("mine").alias("lo"), F.col("mine").alias("hi"), none.alias("side")), threshold))
    for step in range(1, most // 2 + 1):
        # Each block meets the one `step` further on; half of a ring of even length away, it meets it once.
        there = rows.where(F.col("blocks") >= 2 * step)
        once, half = 2 * step < F.col("blocks"), F.col("mine") < step
        as_first = there.where(once | half).select("*", F.col("mine").alias("lo"), F.pmod(F.col("mine") + step, "blocks").alias("hi"), none.alias("side"))
        as_second = there.where(once | ~half).select("*", F.pmod(F.col("mine") - step, "blocks").alias("lo"), F.col("mine").alias("hi"), F.lit(1).alias("side"))
        out = out.union(written(_compared(as_first.union(as_second), threshold)))
    return out


def digests(good: DataFrame) -> DataFrame:
    """(vec_id, digest) of the vectors' components, the same for equal vectors only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, matrix in by_dimension(batch.column(0), batch.column(1)):
                hashes = pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in matrix + 0.0], pa.binary())  # -0.0 + 0.0 is 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), hashes], names=["vec_id", "digest"])

    return good.select("vec_id", "embedding").mapInArrow(run, "vec_id long, digest binary")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector of `vec_id, embedding`."""
    rows = one_row_each(df, "vec_id", "embedding", narrow=True)
    if repeated(df, "vec_id"):
        rows = written(rows)
    good = rows.where(usable("embedding"))
    hashed = digests(good)
    several = written(hashed.groupBy("digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).where("weight > 1"))
    copies = several.agg(F.coalesce(F.sum(F.col("weight") - 1), F.lit(0))).first()[0]
    classes, out = good.select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("weight"), "embedding"), rows.select("vec_id")
    if copies:
        own = written(hashed.join(several, "digest").select("vec_id", "id", "weight"))
        classes = written(good.join(own, "vec_id", "left").where("id is null or id = vec_id").select(F.col("vec_id").alias("id"), F.coalesce("weight", F.lit(1)).cast("long").alias("weight"), "embedding"))
        out = out.join(own, "vec_id", "left").withColumn("id", F.coalesce("id", "vec_id"))
    else:
        out = out.select("vec_id", F.col("vec_id").alias("id"), F.lit(1).alias("weight"))
    found = compare(classes, good.count() - copies, threshold)
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    summary = found.groupBy("id").agg(F.sum("links").alias("links")).join(component, "id", "left")
    out = out.join(summary, "id", "left")
    component = F.coalesce("component_id", "id")
    links = F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
