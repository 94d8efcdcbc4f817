"""Piece codec, packing and chat formatting against the libraries, brute force and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakframe.llm import chat, packing, piece_codec
from cloakframe.llm.common import text_chunks

ODD = ["a  b", "  x", "\n\ty", "", " ", "a\r\nb", "ﬁ½ x　y", "\x00a", "<s>a</s>", "é😀<0x0A>", "▁▁a ▁", None, "x" * 500 + " 日本語テキスト  !!", " " * 70 + "z", "don't 'tis I'll we've'd 's ''s q'", "<|endoftext|>z"]


def encoded(coder, texts):
    out = []
    for lo, hi, data, offsets in text_chunks(pa.array(texts, pa.string()), 40):
        ids, at = coder.encode_chunk(data, offsets)
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    return out


def test_codecs_match_the_libraries():
    pieces, tokens = piece_codec.codec(piece_codec.default_model()), packing.byte_tokens(packing.default_tokenizer())
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("ab's tlervd  \n\t1½²Ⅷ!.’日́\xa0 ▁") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    got = encoded(pieces, texts)
    assert got == pieces.library.encode([t or "" for t in texts], num_threads=1)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])])
    assert pieces.decode_flat(np.array([i for x in got for i in x], np.int64), offsets) == [pieces.library.decode(x) for x in got]
    assert encoded(tokens, texts) == [tokens.library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_differences_from_the_library_are_errors():
    right, c = piece_codec.codec(piece_codec.default_model()), piece_codec.PieceCodec(piece_codec.default_model())
    ids = np.array(right.library.encode("hello there"), np.int64)
    c.newline_alone = False
    assert encoded(c, ODD) == right.library.encode([t or "" for t in ODD], num_threads=1)
    c.table.clear()
    c.scores = -c.scores
    with pytest.raises(RuntimeError, match="encoding differs"):
        encoded(c, ["hello there, international understanding"])
    c.text_flat = c.text_flat ^ 1
    with pytest.raises(RuntimeError, match="decoding differs"):
        c.decode_flat(ids, np.array([0, len(ids)]))


def test_a_small_table_changes_nothing():
    tokens = packing.ByteTokens(packing.default_tokenizer())
    want = encoded(tokens, ["one two three", "two four five six", "one"])
    tokens.table.limit = 2
    tokens.table.clear()
    assert encoded(tokens, ["one two three", "two four five six", "one"]) == want


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 90), st.lists(st.integers(1, 90), min_size=1, max_size=200))
def test_plan_holds_every_piece(capacity, sizes):
    histogram = Counter(min(s, capacity) for s in sizes)
    plan = packing.plan(histogram, capacity)
    back = Counter()
    for times, content in plan:
        assert times > 0 and sum(w * n for w, n in content) <= capacity
        for w, n in content:
            back[w] += times * n
    assert back == histogram
    bins, least = sum(t for t, _ in plan), packing.lower_bound(histogram, capacity)
    assert least <= bins <= max(least + 1, 1.25 * least)


def test_packed_sequences(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randint(0, 999)}" for _ in range(r.choice([0, 1, 5, 60, 300, 2000])))) for i in range(200)] + [(500, None), (500, "x"), (500, "x"), (None, "y")]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    tokens = packing.byte_tokens(packing.default_tokenizer()).library
    want = Counter()
    for d, t in rows:
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 0]
        head = (len(ids) - 1) % 2048 + 1
        starts = [0, *range(head, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    sequences = {}
    for g in got:
        sequences.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= packing.lower_bound(Counter(g.length for g in got), 2048) + 1
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab\\<|>[]/ \n", *chat.CONTROL]), max_size=30))
def test_escape_round_trip(parts):
    text = "".join(parts)
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_chat_examples(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "a </s>"), (1, 2, "assistant", "b\\"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "end"), (2, 0, "user", "alone"), (None, 0, "assistant", "z"), (3, 1, "assistant", "second"), (3, None, "user", "first")]
    df = spark.createDataFrame([(*x, 7) for x in rows], "conv_id long, turn long, role string, text string, example int").repartition(3)
    made = chat.examples(df).collect()
    of = {}
    for m in sorted(made, key=lambda m: (m.conv_id is not None, m.conv_id, m.example)):
        of.setdefault(m.conv_id, []).append((chat.turns_of(m.text), chat.unescape(m.text[m.loss_start : m.loss_end])))
    first = [("system", "be"), ("user", "a </s>"), ("assistant", "b\\")]
    assert [t for t, _ in of[1]] == [first, [*first, ("user", ""), ("assistant", "")], [*first, ("user", ""), ("assistant", ""), ("user", "end")]]
    assert [x for _, x in of[1]] == ["b\\", "", ""] and of[2] == [([("user", "alone")], "")] and of[3] == [([("user", "first"), ("assistant", "second")], "second")]
    back = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    assert back[1].n_turns == 6 and back[1].loss_chars == 2 and back[1].loss_sha256 == hashlib.sha256(b"b\\").hexdigest()
    assert back[None].n_turns == 1 and back[2].loss_chars == 0
    assert chat.read_back(chat.examples(df.limit(0))).collect() == []


def test_codec_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 6)], "doc_id long, text string, decoded2 int")
    both = piece_codec.decode(piece_codec.encode(df))
    assert sorted((r.doc_id, r.decoded, r.decoded2) for r in both.collect()) == [(1, "a b", 5), (2, "", 6)]
    assert piece_codec.digests(df.limit(0)).collect() == []
