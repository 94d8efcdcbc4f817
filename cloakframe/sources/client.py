"""A remote detection service over HTTP, called from the tasks with one session for each partition."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cloakframe.errors import MappingMissing

#: (method, url, body) -> (status, body)
Transport = Callable[[str, str, dict | None], tuple[int, dict]]


def http(method: str, url: str, body: dict | None, timeout: float = 30.0) -> tuple[int, dict]:
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, json.loads(answer.read() or b"{}")
    except urllib.error.HTTPError as error:
        return error.code, {}


class Client:
    def __init__(self, base_url: str, transport: Transport = http) -> None:
        self.base, self.transport = base_url.rstrip("/"), transport

    def _call(self, method: str, path: str, body: dict | None = None) -> dict:
        status, answer = self.transport(method, self.base + path, body)
        if status == 404:
            raise MappingMissing(path)
        if status >= 400:
            raise OSError(f"{method} {path}: status {status}")
        return answer

    # The service's paths.

    def config(self) -> dict:
        return self._call("GET", "/v1/config")

    def detect(self, text: str, thread_id: str = "default") -> list[dict]:
        """Entities; those without detections are left out."""
        found = self._call("POST", "/v1/detect", {"text": text, "thread_id": thread_id}).get("entities", [])
        return [e for e in found if e.get("detections")]

    def override(self, text: str, detections: list[dict], thread_id: str = "default") -> dict:
        return self._call("PUT", "/v1/detect", {"text": text, "thread_id": thread_id, "detections": detections})

    def anonymize(self, text: str, thread_id: str = "default") -> dict:
        return self._call("POST", "/v1/anonymize", {"text": text, "thread_id": thread_id})

    def deanonymize(self, text: str, thread_id: str = "default") -> dict:
        return self._call("POST", "/v1/deanonymize", {"text": text, "thread_id": thread_id})

    def deanonymize_entities(self, text: str, thread_id: str = "default") -> dict:
        return self._call("POST", "/v1/deanonymize/entities", {"text": text, "thread_id": thread_id})


def call_for_each(df: DataFrame, connect: Callable[[], Client], method: str, text: str = "text", out: str = "response") -> DataFrame:
    """Add the JSON answer of a method for each row's text; errors give ``{"error": ...}``."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                return json.dumps(getattr(client, method)(t))
            except (MappingMissing, OSError) as error:
                return json.dumps({"error": str(error)})

        for part in parts:
            yield part.assign(**{out: part[text].map(one)})

    return df.mapInPandas(run, schema)
