"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and
only that reply under the loss mask. Turns after the last reply form one more example
without a target, so that nothing is lost. The template marks turns with control strings;
the same strings inside texts or roles are escaped with a backslash, reversibly.

The turns of a conversation are brought together by one shuffle and sorted by turn; the
examples are then made as the rows stream past. The text kept is that of one
conversation's context (the examples are, by their definition, as long as their context).

Defined results: null text or role counts as empty; rows of the same conversation and
turn are ordered by role and text; a null conv_id is a conversation of its own;
a conversation without assistant turns gives the one example without a target; an empty
table gives no examples; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (BEGIN, MIDDLE, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(BEGIN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(END)}\n", re.DOTALL)

SCHEMA = "conv_id long, example int, text string, loss_start int, loss_end int"


def escape(text: str) -> str:
    """No control string is left, and `unescape` gives the text back."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted example."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about `limit` characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): code points from loss_start to loss_end are trained on.

    The rows of a conversation stay together and in order in their partition.
    """

    def expand(rows: Iterator[tuple]) -> Iterator[tuple]:
        current, context, number, pending = object(), [], 0, False

        def tail() -> Iterator[tuple]:
            if pending:
                text = "".join(context)
                yield current, number, text, len(text), len(text)

        for conv, _, role, text in rows:
            if conv != current:
                yield from tail()
                current, context, number, pending = conv, [], 0, False
            head = f"{BEGIN}{escape(role or '')}{MIDDLE}"
            body = escape(text or "")
            if role == "assistant":
                before = "".join(context)
                start = len(before) + len(head)
                whole = f"{before}{head}{body}{END}\n"
                yield conv, number, whole, start, start + len(body)
                context, number, pending = [whole], number + 1, False
            else:
                context.append(f"{head}{body}{END}\n")
                pending = True
        yield from tail()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(expand(_rows(batches)), ["conv_id", "example", "text", "loss_start", "loss_end"], [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()])

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


def read_back(expanded: DataFrame) -> DataFrame:
    """What the examples hold, for each conversation; `expanded` straight from `examples`, still in order."""

    def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
        current, last, loss, chars, total, begun = None, "", hashlib.sha256(), 0, 0, False

        def done() -> Iterator[tuple]:
            if begun:
                turns, whole = turns_of(last), hashlib.sha256()
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                yield current, len(turns), whole.hexdigest(), chars, loss.hexdigest(), total

        for conv, _, text, start, end in rows:
            if not begun or conv != current:
                yield from done()
                current, loss, chars, total, begun = conv, hashlib.sha256(), 0, 0, True
            trained = unescape(text[start:end])
            loss.update(trained.encode())
            chars, total, last = chars + len(trained), total + len(text), text
        yield from done()

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(digest(_rows(batches)), names, types)

    return expanded.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
