"""Conflicts between detections: who stays where spans overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.schema import DETECTIONS, empty, let, overlaps


def above(detections: Column, threshold: float) -> Column:
    """Detections of at least this confidence; a threshold of 0 or less keeps all."""
    return detections if threshold <= 0 else F.filter(detections, lambda d: d["confidence"] >= threshold)


def by_confidence(detections: Column, threshold: float = 0.0) -> Column:
    """Accept greedily, most confident first (of equals the first emitted), what overlaps nothing accepted; by start.

    What lost to a loser doesn't come back.
    """
    return let(above(detections, threshold), _greedy)


def _greedy(kept: Column) -> Column:
    ranked = F.array_sort(F.transform(kept, lambda d, i: F.struct((-d["confidence"]).alias("c"), i.alias("i"), d.alias("d"))))
    chosen = F.aggregate(ranked, empty(DETECTIONS), lambda acc, x: F.when(F.exists(acc, lambda a: overlaps(a, x["d"])), acc).otherwise(F.concat(acc, F.array(x["d"]))))
    ordered = F.array_sort(F.transform(chosen, lambda d, i: F.struct(d["start"].alias("s"), i.alias("i"), d.alias("d"))))
    return F.when(F.size(kept) <= 1, kept).otherwise(F.transform(ordered, lambda x: x["d"]))


def unresolved(detections: Column, threshold: float = 0.0) -> Column:
    return above(detections, threshold)
