"""Observation: what each stage saw, with the personal data replaced by tokens, and where it goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cloakframe.operators.placeholders import Factory, Redact


def detection_payload(entities: Column, factory: Factory | None = None) -> Column:
    """JSON of the detections: label, position, confidence, and a token in place of the text."""
    tokens = (factory or Redact()).tokens(entities)
    rows = F.flatten(
        F.transform(
            entities,
            lambda e, i: F.transform(
                e["detections"],
                lambda d: F.struct(d["label"].alias("label"), F.array(d["start"], d["end"]).alias("position"), d["confidence"].alias("confidence"), tokens[i].alias("text")),
            ),
        )
    )
    return F.to_json(rows)


def entity_payload(entities: Column, factory: Factory | None = None) -> Column:
    """JSON of the entities: label, and their detections as above."""
    tokens = (factory or Redact()).tokens(entities)
    rows = F.transform(
        entities,
        lambda e, i: F.struct(
            e["label"].alias("label"),
            F.transform(
                e["detections"],
                lambda d: F.struct(d["label"].alias("label"), F.array(d["start"], d["end"]).alias("position"), d["confidence"].alias("confidence"), tokens[i].alias("text")),
            ).alias("detections"),
        ),
    )
    return F.to_json(rows)


def audit(df: DataFrame, key: str, entities: str = "entities", anonymized: str = "anonymized_text", factory: Factory | None = None) -> DataFrame:
    """(key, stage, payload), a row for each stage; no personal data in it."""
    e = F.col(entities)
    stages = F.array(
        F.struct(F.lit("detect").alias("stage"), detection_payload(e, factory).alias("payload")),
        F.struct(F.lit("link").alias("stage"), entity_payload(e, factory).alias("payload")),
        F.struct(F.lit("replace").alias("stage"), F.to_json(F.struct(F.col(anonymized).alias("output"), F.size(e).alias("entities"))).alias("payload")),
    )
    return df.select(key, F.explode(stages).alias("s")).select(key, "s.stage", "s.payload")


def counted(df: DataFrame, entities: str = "entities", name: str = "pii") -> tuple[DataFrame, Observation]:
    """`df` with metrics gathered while it runs: texts, texts with entities, entities, detections."""
    seen = Observation(name)
    size = F.size(entities)
    found = F.aggregate(F.col(entities), F.lit(0), lambda n, e: n + F.size(e["detections"]))
    return df.observe(seen, F.count("*").alias("texts"), F.sum((size > 0).cast("long")).alias("texts_with_entities"), F.sum(size).alias("entities"), F.sum(found).alias("detections")), seen


class Sink:
    """Takes audit rows; this one drops them."""

    def write(self, rows: DataFrame) -> None:
        return None

    def flush(self) -> None:
        return None


class TableSink(Sink):
    """Appends to a Parquet table."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


class ClientSink(Sink):
    """Sends rows from the tasks to a tracing service: `connect()` makes the client in the worker, `send(client, row)` sends one."""

    def __init__(self, connect: Callable[[], object], send: Callable[[object, dict], None]) -> None:
        self.connect, self.send = connect, send

    def write(self, rows: DataFrame) -> None:
        connect, send = self.connect, self.send

        def run(part) -> None:
            client = connect()
            for row in part:
                send(client, row.asDict(recursive=True))
            if hasattr(client, "flush"):
                client.flush()

        rows.foreachPartition(run)


def report_by_label(df: DataFrame, by: str, entities: str = "entities") -> DataFrame:
    """Entities and mentions for each value of `by` and label, with totals (nulls)."""
    rows = df.select(by, F.explode(entities).alias("e")).select(by, F.col("e.label").alias("label"), F.size("e.detections").alias("n"))
    return rows.rollup(by, "label").agg(F.count("*").alias("entities"), F.sum("n").alias("mentions"))
