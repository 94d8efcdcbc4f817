"""SentencePiece encoding and decoding for merge-type vocabularies with byte fallback.

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the piece
they make and then from the left, and merges the best until no pair makes a piece.
Texts are first cut into units no piece can reach across (two neighbouring characters
that are not neighbours in any piece), so the agenda of a unit is the whole agenda of
that stretch of text. Units of the same length share one vectorised agenda; long units
and those with characters outside the vocabulary use a heap. Every unit is compared,
when first met, with the sentencepiece library; a difference is an error.

Defined results: null text encodes and decodes like an empty one (no ids, empty text);
a text of any length is encoded whole; other columns pass through unchanged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import text_chunks
from cloakframe.llm.wordtable import UnitTable, code_points, per_text

SPACE = 0x2581
DENSE = 0x250
LONG = 40


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    def __init__(self, model: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.get_piece_size()
        self.unknown = lib.unk_id()
        self.bytes_at, pieces = {}, {}
        self.text = [b""] * n
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif lib.is_unknown(i):
                self.text[i] = " ⁇ ".encode()
            elif not lib.is_control(i):
                pieces[piece] = i
                self.text[i] = piece.replace("▁", " ").encode()
        self.pieces, self.score = pieces, [lib.get_score(i) for i in range(n)]
        # Symbols that are part of a piece without being one get ids from n on.
        symbols = dict(pieces)
        for piece in pieces:
            for c in piece:
                symbols.setdefault(c, len(symbols) + n)
        self.symbols = symbols
        pairs = {}
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        # The pair table as open addressing: most pairs looked up make no piece.
        self.slots = 1 << (2 * len(pairs) - 1).bit_length() if pairs else 2
        self.hash_keys, self.hash_ids = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32)
        for k, v in pairs.items():
            s = self._slot(k)
            while self.hash_keys[s] >= 0:
                s = (s + 1) % self.slots
            self.hash_keys[s], self.hash_ids[s] = k, v
        self.scores = np.array(self.score + [0.0], np.float64)
        self.joined = np.zeros(0x110000, bool)
        self.near = np.zeros((DENSE, DENSE), bool)
        for piece in pieces:
            for a, b in zip(piece, piece[1:], strict=False):
                a, b = ord(a), ord(b)
                self.joined[[a, b]] = True
                if a < DENSE and b < DENSE:
                    self.near[a, b] = True
        self.single = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.single[ord(s)] = i
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece with a space inside: units can't be cut at spaces")
        self.newline_alone = not self.joined[10] and len(lib.encode("\n")) == 2
        sizes = np.array([len(t) for t in self.text], np.int64)
        self.text_start, self.text_size = np.cumsum(sizes) - sizes, sizes
        self.text_flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.table = UnitTable(self.encode_units)

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 12) % self.slots

    # ------------------------------------------------------------ agenda

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that each pair makes, -1 for none."""
        key = (a.astype(np.int64) << 20) | b
        key[(a < 0) | (b < 0)] = -2
        out, slot = np.full(len(key), -1, np.int32), self._slot(key) % self.slots
        todo = np.arange(len(key))
        while len(todo):
            there = self.hash_keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.hash_ids[slot[hit]]
            on = ~hit & (there >= 0)
            todo, slot = todo[on], (slot[on] + 1) % self.slots
        return out

    def _agenda(self, chars: np.ndarray) -> list[np.ndarray]:
        """Units of one length, a row each, all characters being symbols."""
        m, width = chars.shape
        sym = self.single[chars]
        made = self._merged(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(m, width - 1)
        score = np.where(made >= 0, self.scores[made], -np.inf)
        out: list = [None] * m
        rows = np.arange(m)
        while True:
            best = score.argmax(1)
            top = score[np.arange(len(rows)), best]
            if (done := top == -np.inf).any():
                for r, s in zip(rows[done], sym[done], strict=True):
                    out[r] = s
                rows, sym, made, score, best = (x[~done] for x in (rows, sym, made, score, best))
            if not len(rows):
                return out
            width = sym.shape[1]
            at = np.arange(len(rows))
            sym[at, best] = made[at, best]
            if width == 2:
                for r, s in zip(rows, sym[:, :1], strict=True):
                    out[r] = s
                return out
            keep = np.ones(sym.shape, bool)
            keep[at, best + 1] = False
            sym = sym[keep].reshape(len(rows), width - 1)
            # The pair at `best` goes, with its neighbours' pairs made anew.
            keep = np.ones(made.shape, bool)
            keep[at, best] = False
            made, score = made[keep].reshape(len(rows), width - 2), score[keep].reshape(len(rows), width - 2)
            for ok, column in ((best > 0, best - 1), (best < width - 2, best)):
                i, c = at[ok], column[ok]
                new = self._merged(sym[i, c], sym[i, c + 1])
                made[i, c], score[i, c] = new, np.where(new >= 0, self.scores[new], -np.inf)

    def _heap(self, unit: str) -> list[int]:
        """One unit of any length and any characters."""
        symbol: list = list(unit)
        after, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        agenda: list = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(unit) and (p := self.pieces.get(symbol[i] + symbol[after[i]])) is not None:
                heapq.heappush(agenda, (-self.score[p], i, symbol[i], symbol[after[i]]))

        for i in range(len(unit) - 1):
            offer(i)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if symbol[i] != left or j >= len(unit) or symbol[j] != right:
                continue
            symbol[i], symbol[j], after[i] = left + right, "", after[j]
            if after[i] < len(unit):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        ids, i = [], 0
        while i < len(unit):
            p = self.pieces.get(symbol[i])
            ids += [p] if p is not None else [self.bytes_at.get(b, self.unknown) for b in symbol[i].encode()]
            i = after[i]
        return ids

    def encode_units(self, units: list[str]) -> list:
        out: list = [None] * len(units)
        by_length: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            by_length.setdefault(len(u), []).append(k)
        for length, members in by_length.items():
            if length > LONG:
                slow = members
            else:
                chars = np.frombuffer("".join([units[k] for k in members]).encode("utf-32-le"), np.uint32).reshape(-1, length)
                first = self.single[chars]
                plain = ((first >= 0) & (first < len(self.text))).all(1)
                slow = [k for k, p in zip(members, plain, strict=True) if not p]
                fast = [k for k, p in zip(members, plain, strict=True) if p]
                found = list(first[plain]) if length == 1 else self._agenda(chars[plain]) if fast else []
                for k, ids in zip(fast, found, strict=True):
                    out[k] = ids
            for k in slow:
                out[k] = self._heap(units[k])
        if self.newline_alone:
            lead = self.library.encode("\n")
            for unit, ids, known in zip(units, out, self.library.encode(["\n" + u for u in units], num_threads=1), strict=True):
                if lead + list(map(int, ids)) != known:
                    raise RuntimeError(f"encoding differs from the library on a unit of {len(unit)} characters")
        return out

    # ------------------------------------------------------------ texts

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's)."""
        texts = [] if self.newline_alone else [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points, offsets = code_points(data, offsets)
        full = offsets[1:] > offsets[:-1]
        starts = offsets[:-1][full]
        points = np.insert(np.where(points == 32, SPACE, points), starts, SPACE)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        a, b = points[:-1], points[1:]
        # Rare or special neighbours stay together only if some piece could join both; ordinary ones if a piece has just this pair.
        low = (a < DENSE) & (b < DENSE)
        together = self.joined[a] & self.joined[b] & ((b != SPACE) | (a == SPACE))
        together[low] = self.near[a[low], b[low]]
        cut = np.ones(len(points), bool)
        cut[1:] = ~together
        cut[offsets[:-1][full]] = True
        first = np.flatnonzero(cut)
        ids, sizes = self.table.ids(points, first)
        at = per_text(sizes, first, offsets)
        if not self.newline_alone:  # units can't be compared one by one, so whole texts are
            for text, lo, hi in zip(texts, at[:-1], at[1:], strict=True):
                if ids[lo:hi].tolist() != self.library.encode(text):
                    raise RuntimeError(f"encoding differs from the library on a text of {len(text)} characters")
        return ids, at

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of consecutive lists of ids: pieces joined, without the space put before the first."""
        sizes = self.text_size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.text_flat[np.repeat(self.text_start[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()
        at = np.concatenate([[0], ends])[offsets]
        out = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            part = raw[lo:hi]
            out.append((part[1:] if part[:1] == b" " else part).decode("utf-8", "replace"))
        if out and out != self.library.decode([ids[lo:hi].tolist() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)], num_threads=1):
            raise RuntimeError("decoding differs from the library")
        return out


@cache
def codec(model: str) -> PieceCodec:
    return PieceCodec(model)


def _free_name(df: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has a column {name}")


def encode(df: DataFrame, model: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """Add `out` (array of ids) for the whole of `text`; the other columns stay.

    Raises ValueError if a column `out` is there already.
    """
    _free_name(df, out)
    model = model or default_model()
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    index = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(index)):
                ids, at = c.encode_chunk(data, offsets)
                column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in range(batch.num_columns)), column], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add `out`, the text that the ids in `ids` stand for; null ids give an empty text."""
    _free_name(df, out)
    model = model or default_model()
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)])
    index = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                column = part.column(index)
                sizes = np.array(column.value_lengths().fill_null(0))
                texts = c.decode_flat(np.array(column.flatten()), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text."""
    both = decode(encode(df.select("doc_id", "text"), model).drop("text"), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
