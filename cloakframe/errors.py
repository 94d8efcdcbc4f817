"""Errors that the driver raises; on rows they are columns (`passed`, `error`)."""

from __future__ import annotations


class CloakError(Exception):
    pass


class MappingMissing(CloakError):
    """A text that is to be restored has no stored mapping."""


class RestorationFailed(CloakError):
    """A token wasn't found again; `partial` is the text as far as it came."""

    def __init__(self, message: str, partial: str) -> None:
        super().__init__(message)
        self.partial = partial


class ResidualFound(CloakError):
    """The guard found something in the output; `detections` lists it."""

    def __init__(self, detections: list) -> None:
        super().__init__(f"{len(detections)} detections remain in the output")
        self.detections = detections


class ConfigWarning(UserWarning):
    """A setting that works but is likely not meant."""
