"""Conversations as a stream: detection is stateless, the thread's memory is keyed state with a time to live.

The state of a thread is its entities in order of first mention with their surface forms
and tokens, as JSON. Turns of one micro-batch are taken in order of turn.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloakframe.operators.placeholders import LabelCounter, check_identity
from cloakframe.plans.conversation import Thread
from cloakframe.plans.pipeline import Pipeline

OUTPUT = "thread string, turn long, anonymized_text string, known int"
STATE = "memory string"


def remember(memory: list[dict], found: list[tuple[str, str, str]]) -> list[dict]:
    """Take (text, label, canonical) mentions into the memory: new entities get the next number of their label."""
    index = {(m["canonical"], m["label"]): m for m in memory}
    for text, label, canonical in found:
        m = index.get((canonical, label))
        if m is None:
            number = 1 + sum(x["label"] == label for x in memory)
            m = index[(canonical, label)] = {"label": label, "canonical": canonical, "token": f"<<{label}:{number}>>", "forms": []}
            memory.append(m)
        if text not in m["forms"]:
            m["forms"].append(text)
    return memory


def rewrite(text: str | None, memory: list[dict]) -> str | None:
    tokens: dict[str, str] = {}
    for m in memory:
        for form in m["forms"]:
            if form:
                tokens.setdefault(form, m["token"])
    if text is None or not tokens:
        return text
    return re.sub("|".join(map(re.escape, sorted(tokens, key=len, reverse=True))), lambda m: tokens[m[0]], text)


def anonymize(turns: DataFrame, pipeline: Pipeline, names: Thread | None = None, ttl: str = "30 days") -> DataFrame:
    """(thread, turn, anonymized_text, known): `known` is the number of entities the thread has by then. Append mode."""
    names = names or Thread()
    check_identity(pipeline.factory)
    if not isinstance(pipeline.factory, LabelCounter):
        raise ValueError("the stream keeps label counters; hashes need no state, use the batch plan's tokens")
    found = pipeline.with_(text=names.text).find(turns)
    flat = F.flatten(F.transform("entities", lambda e: F.transform(e["detections"], lambda d: F.struct(d["text"].alias("text"), e["label"].alias("label"), e["canonical"].alias("canonical")))))
    rows = found.select(F.col(names.thread).cast("string").alias("thread"), F.col(names.turn).cast("long").alias("turn"), F.col(names.text).alias("text"), F.to_json(flat).alias("found"))
    millis = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory = json.loads(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(list(parts)).sort_values("turn", kind="stable").itertuples():
            mentions = [(d["text"], d["label"], d["canonical"]) for d in json.loads(row.found or "[]")]
            memory = remember(memory, mentions)
            out.append((key[0], row.turn, rewrite(row.text, memory), len(memory)))
        state.update((json.dumps(memory),))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame(out, columns=["thread", "turn", "anonymized_text", "known"])

    return rows.groupBy("thread").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def anonymize_texts(texts: DataFrame, pipeline: Pipeline) -> DataFrame:
    """Single texts of a stream need no state: the batch plan itself."""
    return pipeline.anonymize(texts)
