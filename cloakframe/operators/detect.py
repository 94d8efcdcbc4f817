"""Detectors: from a text column to an array of detections in the order they are emitted.

Detectors of patterns and words are expressions without a shuffle or Python. Models and
user callables run in Arrow batches, once for each distinct text if asked (`detect_distinct`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import regex
from cloakframe.schema import DETECTIONS, detection, empty, free, held, let


class Detector:
    """`column` gives the detections of a text column; `in_python` tells that it can't stand inside a lambda."""

    in_python = False

    def column(self, text: Column) -> Column:
        raise NotImplementedError

    def add(self, df: DataFrame, text: str = "text", out: str = "detections") -> DataFrame:
        return df.withColumn(out, held(self.column(F.col(text))))


def _checked(valid: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: valid(m["text"])


def _labelled(matches: Column, label: str) -> Column:
    return F.transform(matches, lambda m: detection(m["text"], F.lit(label), m["start"], m["end"], F.lit(1.0)))


class PatternDetector(Detector):
    """Python patterns by label, each scanned on its own: matches of different labels may overlap.

    `validators`: label -> predicate on a column; matches for which it is false go.
    """

    def __init__(self, patterns: dict[str, str], validators: dict[str, Callable[[Column], Column]] | None = None) -> None:
        self.patterns = {label: (regex.to_java(p), regex.needed(p)) for label, p in patterns.items()}
        self.validators = validators or {}

    def column(self, text: Column) -> Column:
        parts = []
        for label, (pattern, hint) in self.patterns.items():
            found = regex.find_all(text, pattern, hint)
            if (valid := self.validators.get(label)) is not None:
                found = F.filter(found, _checked(valid))
            parts.append(_labelled(found, label))
        return F.concat(*parts) if parts else empty(DETECTIONS)


class WordDetector(Detector):
    """Words of a bag, in its order: every occurrence that no word character stands next to."""

    def __init__(self, bag: Iterable[tuple[str, str]], ignore_case: bool = True) -> None:
        self.bag, self.ignore_case = list(bag), ignore_case

    def column(self, text: Column) -> Column:
        parts = [_labelled(regex.find_all(text, regex.bounded_literal(word, self.ignore_case)), label) for word, label in self.bag if word]
        return F.concat(*parts) if parts else empty(DETECTIONS)


class CompositeDetector(Detector):
    """All detections of several detectors, one after the other."""

    def __init__(self, detectors: Sequence[Detector]) -> None:
        self.detectors = list(detectors)
        self.in_python = any(d.in_python for d in self.detectors)

    def column(self, text: Column) -> Column:
        return F.concat(*(d.column(text) for d in self.detectors)) if self.detectors else empty(DETECTIONS)


def check_chunks(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("the chunk size must be positive and the overlap from 0 to less than it")


def chunk_starts(length: Column, size: int, overlap: int) -> Column:
    """First positions of chunks, up to the first that reaches the end."""
    stride = size - overlap
    last = F.ceil((length - size) / stride).cast("int") * stride
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.lit(stride)))


def deduplicated(detections: Column) -> Column:
    """One detection for each span and label, the most confident (the first of equals); by start, otherwise in order."""
    return let(F.transform(detections, lambda d, i: F.struct(d.alias("d"), i.alias("i"))), _deduplicated)


def _deduplicated(numbered: Column) -> Column:
    def better(a: Column, b: Column) -> Column:
        same = (a["d"]["start"] == b["d"]["start"]) & (a["d"]["end"] == b["d"]["end"]) & (a["d"]["label"] == b["d"]["label"])
        return same & ((a["d"]["confidence"] > b["d"]["confidence"]) | ((a["d"]["confidence"] == b["d"]["confidence"]) & (a["i"] < b["i"])))

    def first_seen(x: Column) -> Column:
        same = F.filter(numbered, lambda o: (o["d"]["start"] == x["d"]["start"]) & (o["d"]["end"] == x["d"]["end"]) & (o["d"]["label"] == x["d"]["label"]))
        return F.array_min(F.transform(same, lambda o: o["i"]))

    kept = F.filter(numbered, lambda x: ~F.exists(numbered, lambda o: better(o, x)))
    keyed = F.transform(kept, lambda x: F.struct(x["d"]["start"].alias("s"), first_seen(x).alias("i"), x["d"].alias("d")))
    return F.transform(F.array_sort(keyed), lambda x: x["d"])


class ChunkedDetector(Detector):
    """A detector over overlapping chunks of long texts; texts of one chunk go through untouched."""

    def __init__(self, detector: Detector, size: int = 512, overlap: int = 128) -> None:
        check_chunks(size, overlap)
        self.detector, self.size, self.overlap = detector, size, overlap
        self.in_python = detector.in_python

    def column(self, text: Column) -> Column:
        if self.in_python:
            return self.detector.chunked(self.size, self.overlap).column(text)
        whole = self.detector.column(text)

        def one(start: Column) -> Column:
            found = let(F.substring(text, start + 1, F.lit(self.size)), self.detector.column)
            return F.transform(found, lambda d: detection(F.substring(text, d["start"] + start + 1, d["end"] - d["start"]), d["label"], d["start"] + start, d["end"] + start, d["confidence"]))

        many = deduplicated(F.flatten(F.transform(chunk_starts(F.length(text), self.size, self.overlap), one)))
        return F.when(F.length(text) <= self.size, whole).when(text.isNotNull(), many).otherwise(empty(DETECTIONS))


# ---------------------------------------------------------------- models and callables


def label_map(labels: Sequence[str] | dict[str, str] | None) -> dict[str, str]:
    """Outside label -> ours. A list maps each to itself; two outside labels for one of ours are refused."""
    if not labels:
        return {}
    mapped = dict(labels) if isinstance(labels, dict) else {x: x for x in labels}
    if len(set(mapped.values())) != len(mapped):
        raise ValueError("two labels of the model are mapped to one")
    return mapped


class CallableDetector(Detector):
    """`load()` makes, once in each worker, a function from a text to (text, label, start, end, confidence) rows.

    With labels, outside labels are mapped and others dropped.
    """

    in_python = True

    def __init__(self, load: Callable[[], Callable[[str], Iterable[tuple]]], labels: Sequence[str] | dict[str, str] | None = None, size: int = 0, overlap: int = 0) -> None:
        self.load, self.labels, self.size, self.overlap = load, label_map(labels), size, overlap

    def chunked(self, size: int, overlap: int) -> CallableDetector:
        check_chunks(size, overlap)
        return CallableDetector(self.load, self.labels, size, overlap)

    def detect(self, text: str | None, function: Callable[[str], Iterable[tuple]]) -> list[dict]:
        if not text:
            return []
        if not self.size or len(text) <= self.size:
            return [r for r in (self._row(*x) for x in function(text)) if r]
        best: dict[tuple, dict] = {}
        start = 0
        while True:
            for x in function(text[start : start + self.size]):
                r = self._row(*x)
                if r is None:
                    continue
                r["start"], r["end"] = r["start"] + start, r["end"] + start
                r["text"] = text[r["start"] : r["end"]]
                key = (r["start"], r["end"], r["label"])
                if key not in best or r["confidence"] > best[key]["confidence"]:
                    best[key] = r
            if start + self.size >= len(text):
                return sorted(best.values(), key=lambda r: r["start"])
            start += self.size - self.overlap

    def _row(self, text: str, label: str, start: int, end: int, confidence: float = 1.0) -> dict | None:
        if self.labels:
            label = self.labels.get(label)
        return None if label is None else {"text": text, "label": label, "start": int(start), "end": int(end), "confidence": float(confidence)}

    def column(self, text: Column) -> Column:
        key, load, detect = uuid.uuid4().hex, self.load, self.detect

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            if key not in _LOADED:
                _LOADED[key] = load()
            function = _LOADED[key]
            return texts.map(lambda t: json.dumps(detect(t, function)))

        return F.coalesce(F.from_json(run(text), DETECTIONS), empty(DETECTIONS))


#: In a worker: what `load` made, by column.
_LOADED: dict[str, Callable] = {}


def rows_of_spacy(doc) -> list[tuple]:
    return [(e.text, e.label_, e.start_char, e.end_char, 1.0) for e in doc.ents]


def rows_of_transformers(text: str, found: Iterable[dict]) -> list[tuple]:
    return [(text[x["start"] : x["end"]], x.get("entity_group") or x.get("entity") or "UNKNOWN", x["start"], x["end"], x["score"]) for x in found]


def rows_of_gliner(found: dict[str, Iterable[dict]]) -> list[tuple]:
    """Output grouped by label."""
    return [(x["text"], label, x["start"], x["end"], x.get("confidence", 1.0)) for label, group in found.items() for x in group]


def rows_of_pairs(text: str, pairs: Iterable[tuple[str, str]]) -> list[tuple]:
    """(text, label) pairs, as a language model gives them: every bounded occurrence; what isn't there vanishes."""
    import re

    out = []
    for fragment, label in pairs:
        if fragment:
            out += [(m[0], label, m.start(), m.end(), 1.0) for m in re.finditer(rf"(?<!\w){re.escape(fragment)}(?!\w)", text, re.IGNORECASE)]
    return out


#: Which adapter reads which library's output.
ADAPTERS = {"spacy": rows_of_spacy, "transformers": rows_of_transformers, "gliner": rows_of_gliner, "pairs": rows_of_pairs}


def model_detector(kind: str, load: Callable[[], Callable], labels: Sequence[str] | dict[str, str] | None = None) -> CallableDetector:
    """Detector on a model's call: `load` makes, in the worker, the callable whose output `kind` names."""
    adapt = ADAPTERS[kind]
    with_text = kind in ("transformers", "pairs")

    def make() -> Callable[[str], list[tuple]]:
        model = load()
        return (lambda t: adapt(t, model(t))) if with_text else (lambda t: adapt(model(t)))

    return CallableDetector(make, labels)


# ---------------------------------------------------------------- plans


def detect_distinct(df: DataFrame, detector: Detector, text: str = "text", out: str = "detections") -> DataFrame:
    """Detect once for each distinct text. For detectors that cost more than a shuffle of the texts."""
    sha, found = free(df, "_sha", "_found")
    key = F.sha2(F.col(text).cast("binary"), 256)
    once = df.where(F.col(text).isNotNull()).groupBy(key.alias(sha)).agg(F.first(text).alias("_text")).select(sha, held(detector.column(F.col("_text"))).alias(found))
    joined = df.join(once, F.sha2(df[text].cast("binary"), 256) == once[sha], "left")
    return joined.withColumn(out, F.coalesce(found, empty(DETECTIONS))).drop(sha, found)


def detect_words_joined(df: DataFrame, bag: DataFrame, key: str = "doc_id", text: str = "text", largest_broadcast: int = 200_000) -> DataFrame:
    """(key, detections) for a bag too large for patterns: words are joined on their lower-case form.

    `bag` has word, label of single words. It is broadcast if it has at most `largest_broadcast` rows.
    """
    words = bag.select(F.lower("word").alias("_word"), "label").distinct()
    if words.count() <= largest_broadcast:
        words = F.broadcast(words)
    listed = df.select(key, held(regex.find_all(F.col(text), f"[{regex.WORD}]+")).alias("_tokens"))
    tokens = listed.select(key, F.explode("_tokens").alias("m")).select(key, "m", F.lower("m.text").alias("_word"))
    found = tokens.join(words, "_word").select(key, detection(F.col("m.text"), F.col("label"), F.col("m.start"), F.col("m.end"), F.lit(1.0)).alias("d"))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("d.start").alias("s"), F.col("d.label").alias("l"), "d"))), lambda x: x["d"]).alias("detections"))


def with_overrides(df: DataFrame, detector: Detector, overrides: DataFrame, keys: Sequence[str] = ("thread_id",), text: str = "text", out: str = "detections") -> DataFrame:
    """Rows whose keys and text's hash are in `overrides` (keys, sha, detections) take those; only the others are detected."""
    sha, theirs, *own = free(df, "_sha", "_given", *(f"_{k}" for k in keys))
    given = overrides.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.col("sha").alias(sha), F.col("detections").alias(theirs))
    same = F.sha2(df[text].cast("binary"), 256) == given[sha]
    for k, o in zip(keys, own, strict=True):
        same = same & (df[k] == given[o])
    joined = df.join(given, same, "left")
    kept = F.when(F.col(theirs).isNull(), F.col(text))
    return joined.withColumn(out, held(F.coalesce(F.col(theirs), detector.column(kept), empty(DETECTIONS)))).drop(sha, theirs, *own)
