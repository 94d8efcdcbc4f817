"""Putting tokens into texts, and taking them out again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions import regex
from cloakframe.schema import empty, let

SPANS = "array<struct<start:int,end:int,token:string>>"


def spans(entities: Column, tokens: Column) -> Column:
    """Each detection's span with its entity's token."""
    pairs = F.transform(entities, lambda e, i: F.transform(e["detections"], lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), tokens[i].alias("token"))))
    return F.when(F.size(entities) == 0, empty(SPANS)).otherwise(F.flatten(pairs))


def splice(text: Column, entities: Column, tokens: Column) -> Column:
    """The text with tokens in place of the detections, put in from the right."""
    ordered = F.array_sort(F.transform(spans(entities, tokens), lambda s, i: F.struct((-s["start"]).alias("k"), i.alias("i"), s.alias("s"))))
    put = F.aggregate(ordered, text, lambda acc, x: F.concat(F.substring(acc, F.lit(1), x["s"]["start"]), x["s"]["token"], F.substring(acc, x["s"]["end"] + 1, F.length(acc))))
    return F.when(F.size(entities) == 0, text).otherwise(put)


def restore(anonymized: Column, entities: Column, tokens: Column) -> Column:
    """struct<text, error>: tokens replaced from left to right by what stood there, in order of the original places.

    A token that isn't found leaves an error, and the text as far as it came.
    """
    detections = F.transform(entities, lambda e, i: F.transform(e["detections"], lambda d, j: F.struct(d["start"].alias("s"), i.alias("i"), j.alias("j"), d["text"].alias("text"), tokens[i].alias("token"))))
    ordered = F.when(F.size(entities) == 0, empty("array<struct<s:int,i:int,j:int,text:string,token:string>>")).otherwise(F.array_sort(F.flatten(detections)))
    start = F.struct(anonymized.alias("text"), F.lit(1).alias("at"), F.lit(None).cast("string").alias("error"))

    def step(acc: Column, x: Column) -> Column:
        found = F.call_function("locate", x["token"], acc["text"], acc["at"])
        done = F.struct(
            F.concat(F.substring(acc["text"], F.lit(1), found - 1), x["text"], F.substring(acc["text"], found + F.length(x["token"]), F.length(acc["text"]))).alias("text"),
            (found + F.length(x["text"])).alias("at"),
            acc["error"].alias("error"),
        )
        failed = F.struct(acc["text"].alias("text"), acc["at"].alias("at"), F.concat(F.lit("token not found: "), x["token"]).alias("error"))
        return F.when(acc["error"].isNotNull(), acc).when(found > 0, done).otherwise(failed)

    return F.aggregate(ordered, start, step, lambda acc: F.struct(acc["text"].alias("text"), acc["error"].alias("error")))


def replace_all(text: Column, mapping: Column, word_boundary: bool = False) -> Column:
    """Every source of `mapping` (array<struct<source,token>>) by its token, in one pass, the longest source first.

    The first of equal sources counts; empty ones don't. Sources are found inside words too,
    unless `word_boundary`.
    """
    return let(mapping, lambda known: _replace_known(text, known, word_boundary))


def _replace_known(text: Column, mapping: Column, word_boundary: bool) -> Column:
    usable = F.filter(mapping, lambda m, i: (m["source"] != "") & ~F.exists(F.slice(mapping, F.lit(1), i), lambda o: o["source"] == m["source"]))
    ranked = F.array_sort(F.transform(usable, lambda m, i: F.struct((-F.length(m["source"])).alias("n"), i.alias("i"), m["source"].alias("source"), m["token"].alias("token"))))
    return let(ranked, lambda ordered: F.when(F.coalesce(F.size(ordered), F.lit(0)) <= 0, text).otherwise(_replaced(text, ordered, word_boundary)))


def _replaced(text: Column, ordered: Column, word_boundary: bool) -> Column:
    either = F.array_join(F.transform(ordered, lambda m: regex.escaped(m["source"])), "|")
    if word_boundary:
        either = F.concat(F.lit(f"(?<![{regex.WORD}])(?:"), either, F.lit(f")(?![{regex.WORD}])"))
    found = let(either, lambda pattern: regex.find_all(text, pattern))

    def add(acc: Column, m: Column) -> Column:
        token = F.element_at(F.filter(ordered, lambda o: o["source"] == m["text"]), 1)["token"]
        return F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), token).alias("out"), m["end"].alias("at"))

    return F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def surface_forms(entities: Column, tokens: Column) -> Column:
    """The mapping from every detected text to its entity's token."""
    pairs = F.transform(entities, lambda e, i: F.transform(e["detections"], lambda d: F.struct(d["text"].alias("source"), tokens[i].alias("token"))))
    return F.when(F.size(entities) == 0, empty("array<struct<source:string,token:string>>")).otherwise(F.flatten(pairs))


def canonical_forms(entities: Column, tokens: Column) -> Column:
    """The mapping from every token to the text that its entity was first found as."""
    pairs = F.transform(entities, lambda e, i: F.struct(tokens[i].alias("source"), e["detections"][0]["text"].alias("token")))
    return F.when(F.size(entities) == 0, empty("array<struct<source:string,token:string>>")).otherwise(pairs)
