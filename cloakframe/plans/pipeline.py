"""The pipeline over a table of texts: detect, resolve spans, link, resolve entities, replace, guard.

With native detectors it is one map stage: detections and entities stay array columns of
the text's row, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.errors import MappingMissing, RestorationFailed
from cloakframe.operators import link as linking
from cloakframe.operators import replace as replacing
from cloakframe.operators import resolve
from cloakframe.operators.detect import Detector, detect_distinct
from cloakframe.operators.guard import Guard, NoGuard
from cloakframe.operators.placeholders import Factory, LabelCounter
from cloakframe.schema import DETECTIONS, ENTITIES, empty, free, held, let


@dataclass(frozen=True)
class Pipeline:
    """Immutable; `with_` makes a changed copy."""

    detector: Detector
    factory: Factory = field(default_factory=LabelCounter)
    guard: Guard = field(default_factory=NoGuard)
    spans: Callable[[Column], Column] = resolve.by_confidence
    link: Callable[[Column, Column], Column] = linking.link
    entities: Callable[[Column], Column] = linking.merge_shared
    text: str = "text"
    #: Detect once for each distinct text, at the price of a shuffle: for models.
    distinct: bool = False
    #: The table has its `detections` already (from `with_overrides`, say).
    detected: bool = False

    def with_(self, **changes) -> Pipeline:
        return replace(self, **changes)

    def detect(self, df: DataFrame) -> DataFrame:
        """Add `detections`, as they are emitted."""
        return detect_distinct(df, self.detector, self.text) if self.distinct else self.detector.add(df, self.text)

    def find(self, df: DataFrame) -> DataFrame:
        """Add `detections` and `entities`; nothing is stored."""
        found = df if self.detected else self.detect(df)
        text = F.coalesce(F.col(self.text), F.lit(""))
        some = F.size("detections") > 0
        stages = let(F.col("detections"), lambda d: let(self.spans(d), lambda r: let(self.link(text, r), self.entities)))
        return found.withColumn("entities", held(F.when(some, stages).otherwise(empty(ENTITIES))))

    def anonymize(self, df: DataFrame) -> DataFrame:
        """Add `entities`, `tokens`, `anonymized_text`, `residual` and `passed`. A null text stays null and has no entities."""
        out = self.find(df)
        out = out.withColumn("tokens", held(self.factory.tokens(F.col("entities"))))
        out = out.withColumn("anonymized_text", held(replacing.splice(F.col(self.text), F.col("entities"), F.col("tokens"))))
        out = out.withColumn("residual", held(F.when(F.col("anonymized_text").isNotNull(), self.guard.residual(F.col("anonymized_text"))).otherwise(empty(DETECTIONS))))
        return out.withColumn("passed", F.size("residual") == 0)

    def mapping(self, anonymized: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """What restoring needs, for rows that passed the guard: keys, sha, original, entities, tokens; one row for each output."""
        rows = anonymized.where("passed and anonymized_text is not null").select(*keys, F.sha2(F.col("anonymized_text").cast("binary"), 256).alias("sha"), F.col(self.text).alias("original"), "entities", "tokens")
        return rows.dropDuplicates([*keys, "sha"])


def restore(df: DataFrame, mapping: DataFrame, text: str = "anonymized_text", keys: tuple[str, ...] = ()) -> DataFrame:
    """Add (or replace) `restored` and `error` ("missing" where there is no mapping), by the text's hash."""
    entities, tokens, known, done = free(df, "_entities", "_tokens", "_known", "_done")
    joined = _known(df, mapping, text, keys, F.col("entities").alias(entities), F.col("tokens").alias(tokens), F.lit(True).alias(known))
    joined = joined.withColumn(done, held(F.when(F.col(known), replacing.restore(F.col(text), F.col(entities), F.col(tokens)))))
    out = joined.withColumn("restored", F.col(done)["text"]).withColumn("error", F.when(F.col(known).isNull(), "missing").otherwise(F.col(done)["error"]))
    return out.drop(entities, tokens, known, done)


def _known(df: DataFrame, mapping: DataFrame, text: str, keys: tuple[str, ...], *values: Column) -> DataFrame:
    """`df` with values of the mapping's row for its keys and its text's hash, null where there is none."""
    sha, *own = free(df, "_sha", *(f"_{k}" for k in keys))
    rows = mapping.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col("sha").alias(sha), *values)
    same = F.sha2(df[text].cast("binary"), 256) == rows[sha]
    for k, o in zip(keys, own, strict=True):
        same = same & (df[k] == rows[o])
    return df.join(rows, same, "left").drop(sha, *own)


def restore_strict(df: DataFrame, mapping: DataFrame, text: str = "anonymized_text", keys: tuple[str, ...] = ()) -> DataFrame:
    """As `restore`, but the first error is raised on the driver."""
    out = restore(df, mapping, text, keys)
    for row in out.where("error is not null").select("error", "restored").take(1):
        raise MappingMissing("a text has no stored mapping") if row.error == "missing" else RestorationFailed(row.error, row.restored)
    return out


def with_originals(df: DataFrame, mapping: DataFrame, text: str = "anonymized_text", keys: tuple[str, ...] = ("thread_id",)) -> DataFrame:
    """Add (or replace) `restored`: the stored original, null where there is none."""
    (original,) = free(df, "_stored")
    return _known(df, mapping, text, keys, F.col("original").alias(original)).withColumn("restored", F.col(original)).drop(original)
