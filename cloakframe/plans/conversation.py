"""Conversations: every turn is anonymised with what its thread has said before.

First-seen order (the default) is a relational plan: mentions are grouped to the
thread's entities, numbered by their first mention, and each turn gets the surface forms
known by then. Aggregations combine before the shuffle; the turns meet their
thread's forms in a join that adaptive execution can split, so a thread isn't one task's work.

Reference order folds each thread turn by turn. Its numbers follow the smallest offset of an
entity in any turn, so a token can change its meaning between turns; it is there
for parity, and takes a thread's turns into one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.operators import replace as replacing
from cloakframe.operators.placeholders import LabelCounter, RedactCounter, check_identity
from cloakframe.plans.pipeline import Pipeline
from cloakframe.schema import free, held
from cloakframe.sources.tables import stored

FORMS = "array<struct<source:string,token:string,canonical:string,label:string,turn:long>>"


@dataclass(frozen=True)
class Thread:
    """Names of the columns of a table of turns."""

    thread: str = "thread_id"
    turn: str = "turn"
    text: str = "text"


def mentions(found: DataFrame, names: Thread) -> DataFrame:
    """(thread, turn, ord, label, canonical, form, source): a row for each different surface form of an entity in a turn."""
    e = found.select(F.col(names.thread).alias("thread"), F.col(names.turn).cast("long").alias("turn"), F.posexplode("entities").alias("ord", "e"))
    return e.select("thread", "turn", "ord", F.col("e.label").alias("label"), F.col("e.canonical").alias("canonical"), F.posexplode(F.array_distinct(F.transform("e.detections", lambda d: d["text"]))).alias("form", "source"))


def memory(found: DataFrame, names: Thread) -> DataFrame:
    """(thread, label, canonical, first_turn, first_ord, number, overall): the entities of each thread, numbered by first mention, in their label and over all."""
    first = mentions(found, names).groupBy("thread", "label", "canonical").agg(F.min(F.struct("turn", "ord")).alias("first"))
    own = Window.partitionBy("thread", "label").orderBy("first.turn", "first.ord", "canonical")
    every = Window.partitionBy("thread").orderBy("first.turn", "first.ord", "label", "canonical")
    return first.select("thread", "label", "canonical", F.col("first.turn").alias("first_turn"), F.col("first.ord").alias("first_ord"), F.row_number().over(own).alias("number"), F.row_number().over(every).alias("overall"))


def _token(pipeline: Pipeline) -> Column:
    """The token of a row of `memory`."""
    factory = pipeline.factory
    if isinstance(factory, LabelCounter):
        return factory.numbered(F.col("label"), F.col("number").cast("string"))
    if isinstance(factory, RedactCounter):
        return F.concat(F.lit(f"<<{factory.prefix}:"), F.col("overall").cast("string"), F.lit(">>"))
    # Factories that go by the entity alone; a numbering one sees as many entities as the number says.
    entity = F.struct("label", "canonical", F.array(F.struct(F.col("canonical").alias("text"))).alias("detections"))
    peers = F.transform(F.sequence(F.lit(1), "number"), lambda _: entity)
    return factory.token(entity, F.col("number") - 1, peers)


def forms(found: DataFrame, pipeline: Pipeline, names: Thread) -> DataFrame:
    """(thread, forms): for each thread all surface forms, with their token and the turn they are known from. As large as the thread's vocabulary."""
    tokens = memory(found, names).select("thread", "label", "canonical", "number", "overall", _token(pipeline).alias("token"))
    known = mentions(found, names).groupBy("thread", "label", "canonical", "source").agg(F.min(F.struct("turn", "ord", "form")).alias("known"))
    rows = known.join(tokens, ["thread", "label", "canonical"])
    form = F.struct("overall", F.col("known.turn").alias("turn"), F.col("known.ord").alias("ord"), F.col("known.form").alias("form"), "source", "token", "canonical", "label")
    ordered = F.array_sort(F.collect_list(form))
    return rows.groupBy("thread").agg(F.transform(ordered, lambda f: F.struct(f["source"].alias("source"), f["token"].alias("token"), f["canonical"].alias("canonical"), f["label"].alias("label"), f["turn"].alias("turn"))).alias("forms"))


def anonymize(df: DataFrame, pipeline: Pipeline, names: Thread | None = None, word_boundary: bool = False) -> DataFrame:
    """Add `entities`, `forms` (known by the turn), `anonymized_text`, `residual`, `passed`.

    Surface forms learned in earlier turns are replaced even where nothing is detected now. What is
    detected is used three times, so it is written once to the shared folder first.
    """
    names = names or Thread()
    check_identity(pipeline.factory)
    found = stored(pipeline.with_(text=names.text).find(df), "found")
    (thread,) = free(found, "_thread")
    known = forms(found, pipeline, names).withColumnRenamed("thread", thread)
    out = found.join(known, found[names.thread] == known[thread], "left").drop(thread)
    visible = F.filter(F.coalesce("forms", F.array().cast(FORMS)), lambda f: f["turn"] <= F.col(names.turn))
    out = out.withColumn("forms", visible)
    out = out.withColumn("anonymized_text", held(replacing.replace_all(F.col(names.text), F.transform("forms", lambda f: F.struct(f["source"], f["token"])), word_boundary)))
    out = out.withColumn("residual", held(F.when(F.col("anonymized_text").isNotNull(), pipeline.guard.residual(F.col("anonymized_text")))))
    return out.withColumn("passed", F.coalesce(F.size("residual"), F.lit(0)) <= 0)


def mapping(anonymized: DataFrame, names: Thread | None = None) -> DataFrame:
    """(thread, sha, original): of each output that passed, the original; of equal outputs, the earliest turn's."""
    names = names or Thread()
    rows = anonymized.where("passed and anonymized_text is not null")
    sha = F.sha2(F.col("anonymized_text").cast("binary"), 256).alias("sha")
    return rows.groupBy(names.thread, sha).agg(F.min_by(F.col(names.text), F.col(names.turn)).alias("original"))


def restore_tokens(df: DataFrame, known: DataFrame, text: str = "text", thread: str = "thread_id") -> DataFrame:
    """Add `restored`: every token of the thread by the text its entity was first seen as, wherever it stands."""
    joined = df.join(known.select(F.col("thread").alias("_thread"), "forms"), df[thread] == F.col("_thread"), "left")
    # Of an entity's surface forms the first stands first, and the first of equal sources counts.
    back = F.transform(F.coalesce("forms", F.array().cast(FORMS)), lambda f: F.struct(f["token"].alias("source"), f["source"].alias("token")))
    return joined.withColumn("restored", replacing.replace_all(F.col(text), back)).drop("_thread", "forms")


# ---------------------------------------------------------------- reference order


def anonymize_in_reference_order(df: DataFrame, pipeline: Pipeline, names: Thread | None = None) -> DataFrame:
    """(thread, turn, anonymized_text) with counters by the smallest offset in the thread so far. Label counters only."""
    import re

    names = names or Thread()
    if not isinstance(pipeline.factory, LabelCounter):
        raise ValueError("reference order is for label counters; other identities don't depend on the order")
    found = pipeline.with_(text=names.text).find(df)
    flat = F.transform("entities", lambda e: F.transform(e["detections"], lambda d: F.struct(d["text"], e["label"], e["canonical"], d["start"])))
    rows = found.select(F.col(names.thread).alias("thread"), F.col(names.turn).alias("turn"), F.col(names.text).alias("text"), F.flatten(flat).alias("found"))
    schema = T.StructType([T.StructField("thread", rows.schema["thread"].dataType), T.StructField("turn", rows.schema["turn"].dataType), T.StructField("anonymized_text", T.StringType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        memory: dict[tuple, dict] = {}
        out = []
        for row in group.sort_values("turn", kind="stable").itertuples():
            for d in row.found if row.found is not None else []:
                text, label, canonical, start = d.values() if isinstance(d, dict) else tuple(d)
                m = memory.setdefault((canonical, label), {"start": start, "forms": []})
                if text not in m["forms"]:
                    m["forms"].append(text)
                    m["start"] = min(m["start"], start)
            numbers: dict[str, int] = {}
            tokens: dict[str, str] = {}
            for (_, label), m in sorted(memory.items(), key=lambda kv: kv[1]["start"]):
                numbers[label] = numbers.get(label, 0) + 1
                for form in m["forms"]:
                    tokens.setdefault(form, f"<<{label}:{numbers[label]}>>")
            either = "|".join(map(re.escape, sorted(filter(None, tokens), key=len, reverse=True)))
            out.append((row.thread, row.turn, row.text if not either or row.text is None else re.sub(either, lambda m: tokens[m[0]], row.text)))
        return pd.DataFrame(out, columns=["thread", "turn", "anonymized_text"])

    return rows.groupBy("thread").applyInPandas(run, schema)

