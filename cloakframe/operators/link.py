"""From detections to entities: find further mentions, group them, and join what earlier texts knew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions import regex
from cloakframe.functions.similarity import jaro_winkler
from cloakframe.schema import ENTITIES, detection, empty, let, overlaps

EXPANSIONS = ("skip", "reference")


def expand(text: Column, detections: Column, min_length: int = 1, overlap: str = "skip", ignore_case: bool = True) -> Column:
    """Add every bounded occurrence of each detected text, with the label of the first that found it and confidence 1.

    `overlap`: "skip" leaves out occurrences that overlap a span there is; "reference" only those
    that have the same span.
    """
    if overlap not in EXPANSIONS:
        raise ValueError(f"overlap is one of {EXPANSIONS}")

    def taken(acc: Column, m: Column) -> Column:
        return F.exists(acc, lambda d: overlaps(d, m) if overlap == "skip" else (d["start"] == m["start"]) & (d["end"] == m["end"]))

    def add(acc: Column, seed: Column) -> Column:
        found = F.filter(regex.find_all(text, regex.bounded(seed["text"], ignore_case)), lambda m: ~taken(acc, m))
        return F.concat(acc, F.transform(found, lambda m: detection(m["text"], seed["label"], m["start"], m["end"], F.lit(1.0))))

    def fresh(seeds: Column) -> Column:
        """A text that was a seed already finds nothing new."""
        return F.filter(seeds, lambda d, i: ~F.exists(F.slice(seeds, F.lit(1), i), lambda o: o["text"] == d["text"]))

    def all_of(found: Column) -> Column:
        seeds = let(F.filter(found, lambda d: F.length(d["text"]) >= min_length), fresh)
        return F.when(F.size(found) == 0, found).otherwise(F.aggregate(seeds, found, add))

    return let(detections, all_of)


def _by_first(entities: Column) -> Column:
    """In the order of their smallest start, otherwise as they are."""
    keyed = F.transform(entities, lambda e, i: F.struct(F.array_min(F.transform(e["detections"], lambda d: d["start"])).alias("s"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def group(detections: Column) -> Column:
    """An entity for each lower-case text and label, in order of the first mention."""
    return let(detections, _group)


def _group(detections: Column) -> Column:
    keys = F.array_distinct(F.transform(detections, lambda d: F.struct(F.lower(d["text"]).alias("canonical"), d["label"].alias("label"))))
    entities = F.transform(
        keys,
        lambda k: F.struct(
            k["label"].alias("label"),
            k["canonical"].alias("canonical"),
            F.filter(detections, lambda d: (F.lower(d["text"]) == k["canonical"]) & (d["label"] == k["label"])).alias("detections"),
        ),
    )
    return F.when(F.size(detections) == 0, empty(ENTITIES)).otherwise(_by_first(entities))


def link(text: Column, detections: Column, min_length: int = 1, overlap: str = "skip") -> Column:
    return group(expand(text, detections, min_length, overlap))


def unlinked(detections: Column) -> Column:
    """One entity for each detection."""
    return F.transform(detections, lambda d: F.struct(d["label"].alias("label"), F.lower(d["text"]).alias("canonical"), F.array(d).alias("detections")))


def link_known(entities: Column, known: Column) -> Column:
    """Entities of this text with the earlier detections of the same text and label put first; known ones that aren't here don't appear."""

    def join(e: Column) -> Column:
        same = F.filter(known, lambda k: (k["canonical"] == e["canonical"]) & (k["label"] == e["label"]))
        earlier = F.flatten(F.transform(same, lambda k: k["detections"]))
        return F.struct(e["label"].alias("label"), e["canonical"].alias("canonical"), F.concat(earlier, e["detections"]).alias("detections"))

    return let(entities, lambda own: F.when((F.size(own) == 0) | (F.size(known) == 0), own).otherwise(_by_first(F.transform(own, join))))


# ---------------------------------------------------------------- conflicts between entities


def _absorb(entities: Column, alike: Callable[[Column, Column], Column], grows: bool) -> Column:
    """Fold: an entity joins the first earlier one that is alike, and (if sets grow) all others that are."""

    def add(acc: Column, e: Column) -> Column:
        return let(F.filter(F.transform(acc, lambda a, i: F.when(alike(a, e), i)), lambda i: i.isNotNull()), lambda hits: put(acc, e, hits))

    def put(acc: Column, e: Column, hits: Column) -> Column:
        first = hits[0]
        parts = F.transform(hits, lambda i: acc[i]["detections"]) if grows else F.array(acc[first]["detections"])
        joined = F.struct(acc[first]["label"].alias("label"), acc[first]["canonical"].alias("canonical"), F.array_distinct(F.concat(F.flatten(parts), e["detections"])).alias("detections"))
        merged = let(joined, lambda one: F.transform(acc, lambda a, i: F.when(i == first, one).otherwise(a)))
        if grows:
            merged = F.transform(F.filter(F.transform(merged, lambda a, i: F.struct(a.alias("a"), i.alias("i"))), lambda x: (x["i"] == first) | ~F.array_contains(hits, x["i"])), lambda x: x["a"])
        return F.when(F.size(hits) == 0, F.concat(acc, F.array(e))).otherwise(merged)

    # One entity, the usual case, has nothing to be compared with.
    return let(entities, lambda own: F.when(F.size(own) <= 1, own).otherwise(_by_first(F.aggregate(own, empty(ENTITIES), add))))


def merge_shared(entities: Column) -> Column:
    """Entities that share an equal detection become one, transitively."""
    return _absorb(entities, lambda a, e: F.exists(a["detections"], lambda x: F.exists(e["detections"], lambda y: x == y)), grows=True)


def merge_similar(entities: Column, similarity: Callable[[Column, Column], Column] = jaro_winkler, threshold: float = 0.85) -> Column:
    """Entities of one label join the first earlier leader whose canonical text is similar; leaders don't change, so this isn't transitive."""
    return _absorb(entities, lambda a, e: (a["label"] == e["label"]) & (similarity(a["canonical"], e["canonical"]) >= threshold), grows=False)


def unmerged(entities: Column) -> Column:
    return entities

