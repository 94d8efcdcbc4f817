"""Row types. Offsets are code points, `start` inclusive and `end` exclusive, as Spark's own string functions count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETECTION = "struct<text:string,label:string,start:int,end:int,confidence:double>"
DETECTIONS = f"array<{DETECTION}>"
ENTITY = f"struct<label:string,canonical:string,detections:{DETECTIONS}>"
ENTITIES = f"array<{ENTITY}>"
SPAN = "struct<text:string,start:int,end:int>"

#: The common labels.
LABELS = ("PERSON", "LOCATION", "ORGANIZATION", "EMAIL", "PHONE", "DATE", "ADDRESS", "IBAN", "CREDIT_CARD", "IP_ADDRESS", "URL", "API_KEY")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often and however deep in lambdas the body uses it.

    Putting a Column into an expression twice computes it twice; a lambda's variable isn't.
    """
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def held(value: Column) -> Column:
    """The value, kept by the optimiser as a column of its own.

    A filter or generator on a computed column is otherwise pushed below the projection, with the
    whole expression copied into it. Nothing is moved past a value that isn't deterministic, so filters
    on other columns belong before this one.
    """
    return F.when(~F.isnan(F.rand(0)), value)  # always so, but not foreseeable


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where `df` has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def detection(text: Column, label: Column, start: Column, end: Column, confidence: Column) -> Column:
    return F.struct(text.alias("text"), label.alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"), confidence.cast("double").alias("confidence"))


def detection_hash(d: Column) -> Column:
    """``text:label:start:end:confidence``."""
    return F.concat_ws(":", d["text"], d["label"], d["start"].cast("string"), d["end"].cast("string"), d["confidence"].cast("string"))


def overlaps(a: Column, b: Column) -> Column:
    """Half-open spans; neighbours that only touch don't overlap."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def detections_json(detections: Column) -> Column:
    flat = F.transform(detections, lambda d: F.struct(d["text"].alias("text"), d["label"].alias("label"), d["start"].alias("start_pos"), d["end"].alias("end_pos"), d["confidence"].alias("confidence")))
    return F.to_json(flat)


def detections_from_json(text: Column) -> Column:
    rows = F.from_json(text, "array<struct<text:string,label:string,start_pos:int,end_pos:int,confidence:double>>")
    return F.transform(rows, lambda d: detection(d["text"], d["label"], d["start_pos"], d["end_pos"], d["confidence"]))


def entities_json(entities: Column) -> Column:
    """``[{"detections": [...]}, ...]``."""
    return F.to_json(
        F.transform(
            entities,
            lambda e: F.struct(
                F.transform(e["detections"], lambda d: F.struct(d["text"].alias("text"), d["label"].alias("label"), d["start"].alias("start_pos"), d["end"].alias("end_pos"), d["confidence"].alias("confidence"))).alias("detections")
            ),
        )
    )
