"""Checks of the output: does a detector still find something?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.errors import ResidualFound
from cloakframe.operators.detect import Detector
from cloakframe.schema import DETECTIONS, empty, held


class Guard:
    """`residual` gives what remains in a text; a text passes if that is nothing."""

    def residual(self, text: Column) -> Column:
        raise NotImplementedError

    def add(self, df: DataFrame, text: str, out: str = "residual") -> DataFrame:
        """Add the residual detections and `passed`."""
        return df.withColumn(out, held(self.residual(F.col(text)))).withColumn("passed", F.size(out) == 0)


class NoGuard(Guard):
    def residual(self, text: Column) -> Column:
        return empty(DETECTIONS)


class DetectorGuard(Guard):
    """By any detector; one on a language model takes a `CallableDetector`."""

    def __init__(self, detector: Detector) -> None:
        self.detector = detector

    def residual(self, text: Column) -> Column:
        return self.detector.column(text)


def enforce(df: DataFrame, residual: str = "residual", report: int = 20) -> DataFrame:
    """`df` if every row passed; otherwise an error with the detections of up to `report` rows."""
    failed = df.where(F.size(residual) > 0).select(residual).take(report)
    if failed:
        raise ResidualFound([d.asDict() for r in failed for d in r[0]])
    return df
