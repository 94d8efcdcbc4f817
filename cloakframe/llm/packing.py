"""Best-fit packing of tokenised documents after a Martello-Toth dominance reduction.

Only the lengths of the pieces matter, so the bins are planned on the histogram of
lengths: at most `capacity` numbers, however many documents there are. The reduction
(Martello & Toth, 1990) fixes the sets that dominate every other set with the same
largest piece, for all copies of the lengths at once:

* a piece that nothing else fits beside;
* a pair that fills a sequence exactly, or a piece with the largest that fits beside it
  when no two others do;
* a triple whose members dominate every pair that could stand there.

What is left is packed best fit, longest first, again by whole groups of equal bins.
The plan (a few thousand bin patterns) is sent to the tasks; each piece finds its place
from its rank among the pieces of its length.

Defined results: null text is empty and gives the single closing id; a longer document is cut
into whole pieces of `capacity` with the first piece the shorter one; repeated rows are
packed each for itself; an empty table gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import cut, text_chunks
from cloakframe.llm.wordtable import UnitTable, code_points, per_text

CAPACITY = 2048
#: Ranks within a length are counted in this many groups, so that no length is one task's work.
SALTS = 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- tokens

LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 0


class ByteTokens:
    """Byte-level BPE by the tokenizers library, asked once for each distinct pre-token."""

    def __init__(self, path: str) -> None:
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, everything):
                lo, hi = ord(everything[m.start()]), ord(everything[m.end() - 1])
                self.kind[lo : hi + 1] = kind
        self.table = UnitTable(lambda units: [e.ids for e in self.library.encode_batch(units, add_special_tokens=False)])

    def pre_tokens(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First positions of the pre-tokens: runs of letters, of numbers, of others and of white space,
        a plain space going with the run after it, and English contractions by themselves."""
        n = len(points)
        kind = self.kind[points]
        run = np.ones(n, bool)
        run[1:] = kind[1:] != kind[:-1]
        text_start = offsets[:-1][offsets[:-1] < n]
        run[text_start] = True
        begins = np.zeros(n + 1, bool)
        begins[text_start] = True
        begins[n] = True
        first = run.copy()
        # The last white space before something else: a plain space joins it, another stands alone.
        last = np.zeros(n, bool)
        last[:-1] = (kind[:-1] == WHITE) & run[1:] & ~begins[1:n]
        first[last] = True
        joins = np.flatnonzero(last & (points == 32))
        first[joins + 1] = False
        # 's 't 'm 'd 're 've 'll, where the apostrophe is a run of its own without a space.
        quote = np.flatnonzero((points == 39) & first & run)
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == LETTER) & ~begins[quote + 1]]
        if len(quote):
            a = points[quote + 1]
            b = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
            b = np.where(begins[np.minimum(quote + 2, n)], 0, b)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            size = np.where(one, 1, np.where(two, 2, 0))
            quote, size = quote[size > 0], size[size > 0]
            first[quote + 1] = False
            after = quote + 1 + size
            first[after[after < n]] = True
        return np.flatnonzero(first)

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            return self._by_text(raw, offsets)
        points, offsets = code_points(data, offsets)
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        first = self.pre_tokens(points, offsets)
        ids, sizes = self.table.ids(points, first)
        return ids, per_text(sizes, first, offsets)

    def _by_text(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that hold the string of a special token: text by text."""
        ids = [self.library.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.array([i for x in ids for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])])


@cache
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


def token_pieces(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids) of `doc_id, text`: ids as packed little-endian unsigned 32-bit numbers."""
    path = tokenizer or default_tokenizer()
    schema = T.StructType([df.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_tokens(path)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                ids, at = tokens.encode_chunk(data, offsets)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                size = np.diff(at) + 1
                end = np.cumsum(size)
                n = -(-size // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = size - (n - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                begin = (end - size)[row] + start
                # Pieces follow each other without gaps, so they are the slices of one buffer.
                column = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.append(begin, end[-1]).astype(np.int32) * np.int32(4)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), column], names=schema.names)

    return df.select("doc_id", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- plan


class Counts:
    """Lengths with how many pieces have them, and the next length there is, either way."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.count = {w: n for w, n in histogram.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, w: int, n: int) -> None:
        self.count[w] -= n
        if not self.count[w]:
            del self.count[w]
            del self.sizes[bisect_left(self.sizes, w)]

    def at_most(self, w: int, without: tuple = ()) -> int:
        """The largest length up to w, of which a piece is left besides `without`; 0 if none."""
        i = bisect_left(self.sizes, w + 1) - 1
        while i >= 0 and self.count[self.sizes[i]] <= without.count(self.sizes[i]):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest pieces besides one of length `without` (fewer, if there aren't as many)."""
        out: list[int] = []
        for w in self.sizes:
            out += [w] * min(n - len(out), self.count[w] - (w == without))
            if len(out) >= n:
                break
        return out


def dominant(left: Counts, j: int, capacity: int) -> tuple | None:
    """The lengths of a set with j that dominates every other set with j, by the criterion; None if there is none."""
    room = capacity - j
    k = left.at_most(room, (j,))
    if not k:
        return (j,)
    if k == room:
        return (j, k)
    small = left.smallest(3, j)
    if len(small) < 2 or small[0] + small[1] > room:
        return (j, k)
    if len(small) >= 3 and sum(small) <= room:
        return None
    # Two pieces at most stand beside j. The larger member of any such pair is at most k.
    # d is the largest smaller member: two pieces of at least d fit.
    d = 0
    i = bisect_left(left.sizes, room // 2 + 1) - 1
    while i >= 0:
        w = left.sizes[i]
        if left.count[w] > (w == j) and any(left.count[x] > (x == j) + (x == w) for x in left.sizes[i : bisect_left(left.sizes, room - w + 1)]):
            d = w
            break
        i -= 1
    s = left.at_most(room - k, (j, k))
    if s and d <= s:
        return (j, k, s)
    # The pair's sum never exceeds the room, so a single k dominates pairs only if k holds them whole.
    best = 0
    for w in left.sizes[: bisect_left(left.sizes, room)]:
        if left.count[w] > (w == j) and (x := left.at_most(room - w, (j, w))):
            best = max(best, w + x)
    return (j, k) if k >= best else None


def reduce(left: Counts, capacity: int) -> list[tuple[int, tuple]]:
    """Fix dominating sets, until no length has one: [(times, lengths)]."""
    fixed = []
    again = True
    while again:
        again = False
        for j in sorted(left.sizes, reverse=True):
            while j in left.count and (found := dominant(left, j, capacity)):
                need = {w: found.count(w) for w in found}
                times = min(left.count[w] // n for w, n in need.items())
                for w, n in need.items():
                    left.take(w, n * times)
                fixed.append((times, tuple((w, need[w]) for w in need)))
                again = True
    return fixed


def best_fit(left: Counts, capacity: int) -> list[tuple[int, tuple]]:
    """Longest first, each into the fullest bin that takes it; equal bins move as one group."""
    groups: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, content: tuple) -> None:
        if room not in groups:
            groups[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        groups[room].append((times, content))

    for w in sorted(left.sizes, reverse=True):
        n = left.count[w]
        while n:
            i = bisect_left(rooms, w)
            if i < len(rooms):
                room = rooms[i]
                times, content = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, times, content = capacity, -(-n // (capacity // w)), ()
            each = min(room // w, n)
            full = min(times, n // each)
            n -= full * each
            put(room - each * w, full, (*content, (w, each)))
            rest = times - full
            if rest and n:  # fewer than `each` are left for the next of these bins
                put(room - n * w, 1, (*content, (w, n)))
                n, rest = 0, rest - 1
            if rest and content:
                put(room, rest, content)
    return [g for room in rooms for g in groups[room]]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2, over all thresholds."""
    sizes = np.zeros(capacity + 1, np.int64)
    for w, n in histogram.items():
        sizes[w] += n
    number, weight = np.cumsum(sizes), np.cumsum(sizes * np.arange(capacity + 1))
    best = -(-int(weight[-1]) // capacity)
    for a in range(capacity // 2 + 1):
        large = int(number[-1] - number[capacity - a])
        middle = int(number[capacity - a] - number[capacity // 2])
        room = middle * capacity - int(weight[capacity - a] - weight[capacity // 2])
        small = int(weight[capacity // 2] - (weight[a - 1] if a else 0))
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple]]:
    """[(number of sequences, ((length, copies), ...))] that hold every piece."""
    left = Counts(histogram)
    fixed = reduce(left, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[tuple[int, tuple]]) -> dict[int, tuple]:
    """For each length: first ranks of its stretches, and of each stretch the first sequence, copies and place in the sequence."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, content in patterns:
        at = 0
        for w, copies in content:
            out.setdefault(w, []).append((ranks.get(w, 0), sequence, copies, at))
            ranks[w] = ranks.get(w, 0) + times * copies
            at += w * copies
        sequence += times
    return {w: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for w, rows in out.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, and what else they have).

    The plan is made from the histogram of lengths. A piece's rank is its number within its
    length and salt, plus the pieces of that length under smaller salts. `pieces` is read
    twice; pass a table that is written or checkpointed.
    """
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = cut(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    if any(not 0 < w <= capacity for w in histogram):
        raise ValueError(f"a piece is empty or longer than {capacity}")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", *[c for c in pieces.columns if c not in ("doc_id", "piece", "length")])
    # `ahead` has at most capacity * SALTS rows.
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(F.broadcast(ahead), ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_ahead")).alias("_rank"))
    table = pieces.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = table.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at, batch.num_columns - 1))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                w = int(length[rows[0]])
                first, begin, copies, place = where[w]
                k = np.searchsorted(first, rank[rows], "right") - 1
                r = rank[rows] - first[k]
                sequence[rows] = begin[k] + r // copies[k]
                offset[rows] = place[k] + r % copies[k] * w
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def packed(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Place of every piece of every document, with the checksum of its ids in their stead."""
    pieces = token_pieces(df, tokenizer, capacity)
    narrow = cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(narrow, capacity)
